"""Call and dependency graphs: neighbours, name resolution, noise filters, bounded reachability, coupling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stopnames import GROUPS

STRONG = 0.7


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, to cut an iteration's lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-graph-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/lodestar-walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def dropped_cuts(cuts: list[DataFrame]) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for c in cuts:
        spark = c.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(c.cut_at)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def callers(symbols: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """The symbols that call one of this name."""
    targets = symbols.filter(F.lower("name") == name.lower()).select(F.col("id").alias("target_id"))
    sources = relations.filter("kind = 'calls'").join(targets, "target_id").select(F.col("source_id").alias("id")).distinct()
    return symbols.join(sources, "id", "left_semi")


def callees(symbols: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """The symbols that one of this name calls."""
    sources = symbols.filter(F.lower("name") == name.lower()).select(F.col("id").alias("source_id"))
    targets = relations.filter("kind = 'calls'").join(sources, "source_id").select(F.col("target_id").alias("id")).distinct()
    return symbols.join(targets, "id", "left_semi")


def no_callers_because(symbols: DataFrame, relations: DataFrame, name: str, dropped: list[str], stop_list: tuple[str, ...] = ()) -> str:
    """Why a callers list is empty, the first of six causes that holds."""
    if not relations.filter("kind = 'calls'").head(1):
        return "call_graph_not_indexed"
    if name in stop_list:
        return "filtered_ubiquitous"
    if name in dropped:
        return "frequency_filtered"
    own = symbols.filter((F.lower("name") == name.lower()) & F.col("kind").isin("function", "method")).count()
    return "symbol_not_found" if own == 0 else "ambiguous_target" if own > 1 else "no_edges"


def unique_by(symbols: DataFrame, *keys: str) -> DataFrame:
    """The symbols that are alone with their keys: counts first, so that a common name is a count, not a group."""
    alone = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    return alone.drop("n")


def resolve_calls(calls: DataFrame, symbols: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, kind, weight) from calls (path, caller_id, callee, is_method).

    A free call means the one definition of its name in its file, else the one in the tree; a method call the latter.
    Nothing calls itself. Names in stop (name, or name and language group, null for all) are left out.
    """
    own = calls if stop is None else not_stopped(calls, stop)
    callable_ = symbols.filter(F.col("kind").isin("function", "method"))
    here = unique_by(callable_, "path", "name").select("path", F.col("name").alias("callee"), F.col("id").alias("here"))
    anywhere = unique_by(callable_, "name").select(F.col("name").alias("callee"), F.col("id").alias("anywhere"))
    rows = own.join(here, ["path", "callee"], "left").join(anywhere, "callee", "left")
    target = F.when(F.col("is_method"), F.col("anywhere")).otherwise(F.coalesce("here", "anywhere"))
    rows = rows.select(F.col("caller_id").alias("source_id"), target.alias("target_id")).filter("target_id is not null and source_id <> target_id")
    return rows.distinct().select("source_id", "target_id", F.lit("calls").alias("kind"), F.lit(1.0).cast("float").alias("weight"))


def not_stopped(calls: DataFrame, stop: DataFrame) -> DataFrame:
    """calls without those whose callee is a stop name in the language of the calling file; an unknown one counts as any."""
    if "language" not in stop.columns:
        return calls.join(F.broadcast(stop.select(F.col("name").alias("callee")).distinct()), "callee", "left_anti")
    language = C.language_of(F.col("path"))
    shared = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    rows = calls.withColumn("_group", F.coalesce(F.try_element_at(shared, language), language))
    held = F.broadcast(stop.select(F.col("name").alias("_name"), F.col("language").alias("_language")))
    fits = (F.col("callee") == F.col("_name")) & (F.col("_language").isNull() | (F.col("_language") == F.col("_group")) | (F.col("_group") == "unknown"))
    return rows.join(held, fits, "left_anti").drop("_group")


def without_noise(calls: DataFrame, paths: DataFrame, most: int = 25, cross_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped calls: cross-file ones only, callees with more than `most` calling files dropped (0: none)."""
    rows = calls.join(paths.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id").join(paths.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id")
    rows = rows.filter("source_path <> target_path") if cross_file else rows
    if not most:
        return rows.select(calls.columns), rows.select(calls.columns).limit(0)
    busy = rows.groupBy("target_id").agg(F.countDistinct("source_path").alias("n")).filter(F.col("n") > most).select("target_id")
    return rows.join(busy, "target_id", "left_anti").select(calls.columns), rows.join(busy, "target_id", "left_semi").select(calls.columns)


def dependency_edges(relations: DataFrame) -> DataFrame:
    """(source, target) edges that carry a change: strong calls, imports, tests."""
    strong = (F.col("kind") == "calls") & (F.round(F.col("weight").cast("double"), 6) >= STRONG)
    return relations.filter(strong | F.col("kind").isin("imports", "test_for")).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def affected(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, id, depth): what reaches a seed over at most `depth` edges backwards, with the least depth.

    All seeds walk in one pass, level by level; each level is one join with the edges and one anti join with what is
    known, cut off by a table in the shared folder; the levels go when the result's own table is written.
    """
    front = cut(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)))
    known, levels = front, [front]
    for level in range(1, depth + 1):
        step = front.select("seed", "id").join(edges, F.col("id") == F.col("target")).select("seed", F.col("source").alias("id")).distinct()
        front = cut(step.join(known.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)))
        known = known.unionByName(front)
        levels.append(front)
        if not front.head(1):
            break
    out = cut(known.filter("depth > 0"))
    dropped_cuts(levels)
    return out


def blast_radius(edges: DataFrame, seeds: DataFrame, tests: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, entries, test_files, risk) of affected(); tests: (id) of test code."""
    hit = affected(edges, seeds, depth).join(tests.select("id").distinct().withColumn("test", F.lit(1)), "id", "left")
    out = hit.groupBy("seed").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("test"), F.lit(0)).alias("test_files"))
    return out.withColumn("risk", C.risk_level(F.col("entries"), F.col("test_files")))


def test_subjects(relations: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, id, hops): what tests call directly, and what that calls in turn, without the direct ones and tests."""
    calls = relations.filter("kind = 'calls'").select("source_id", "target_id")
    test_ids = tests.select(F.col("id").alias("test_id"))
    first = calls.join(test_ids, F.col("source_id") == F.col("test_id"), "left_semi").select(F.col("source_id").alias("test"), F.col("target_id").alias("id")).join(test_ids, F.col("id") == F.col("test_id"), "left_anti").distinct()
    second = first.join(calls, F.col("id") == F.col("source_id")).select("test", F.col("target_id").alias("id")).join(test_ids, F.col("id") == F.col("test_id"), "left_anti").distinct().join(first, ["test", "id"], "left_anti")
    return first.withColumn("hops", F.lit(1)).unionByName(second.withColumn("hops", F.lit(2)))


def test_symbols(symbols: DataFrame, levels: int = 32) -> DataFrame:
    """Symbols on test paths or inside a test module, found level by level down the parents."""
    module = F.lower("name").rlike(r"^(tests?|test_.*|.*_tests?)$") & F.col("kind").isin("module", "class")
    found = cut(symbols.filter(C.is_test_path(F.col("path")) | module).select("id").distinct())
    front = found
    for _ in range(levels):
        children = symbols.select("id", "parent_symbol_id").join(front.withColumnRenamed("id", "parent_symbol_id"), "parent_symbol_id", "left_semi").select("id")
        front = cut(children.join(found, "id", "left_anti").distinct())
        if not front.head(1):
            break
        found = found.unionByName(front)
    return symbols.join(found, "id", "left_semi")


def coupling(edges: DataFrame, co_changes: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out, co_change_count, risk_score) from path edges (source, target) and partners (path, partners)."""
    cross = edges.filter("source <> target")
    out = cross.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = cross.groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    rows = into.join(out, "path", "full").join(co_changes.select("path", F.col("partners").alias("co")), "path", "left").na.fill(0, ["fan_in", "fan_out", "co"])
    risk = F.col("fan_in") * 0.4 + F.col("fan_out") * 0.3 + F.col("co") * 0.3
    return rows.select("path", "fan_in", "fan_out", F.col("co").alias("co_change_count"), F.round(risk, 6).alias("risk_score"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of (source, target)."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def rank_by_place(rows: DataFrame, by: str, *order, most: int) -> DataFrame:
    """The first `most` rows of each value of `by`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)
