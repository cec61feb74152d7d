"""Looking around: outlines, a symbol with its surroundings, snippets, traces, diffs and commits as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import top_k
from ..operators import change, graph, ranking, reports, search
from . import ask as asking

SNIPPET_LINES = 40


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """(id, name, kind, start_line, end_line, depth) of a file's symbols in order; depth 1 for members."""
    own = symbols.filter(F.col("path") == path)
    depth = F.when(F.col("parent_symbol_id").isNotNull(), 1).otherwise(0)
    return own.select("id", "name", "kind", F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line"), depth.alias("depth")).orderBy("start_line", "id")


def explore_symbol(symbols: DataFrame, name: str, budget: str = "small") -> DataFrame:
    """(role, id, name, path): the best definition, its siblings (exported first, longest first), other definitions."""
    k = top_k(budget)
    wanted = symbols.sparkSession.createDataFrame([(name,)], "wanted string")
    best = search.best_definition(symbols, wanted).select("id", "name", "path")
    held = F.broadcast(best.select(F.col("id").alias("best_id"), F.col("path").alias("best_path")))  # one row
    others = symbols.join(held, F.col("id") != F.col("best_id"))
    size = F.col("span.end_line") - F.col("span.start_line")
    siblings = others.filter("path = best_path").orderBy(F.desc("exported"), F.desc(size), "ordinal").limit(k).select(F.lit("sibling").alias("role"), "id", "name", "path")
    same = others.filter((F.col("name_lower") == name.lower()) & (F.col("path") != F.col("best_path"))).orderBy("ordinal").limit(k).select(F.lit("other").alias("role"), "id", "name", "path")
    return best.select(F.lit("best").alias("role"), "id", "name", "path").unionByName(siblings).unionByName(same)


def snippet(lines: DataFrame, path, start: int, end: int, most: int = SNIPPET_LINES) -> DataFrame:
    """(path, text, lines, cut): a span's lines as one text, at most `most` of them."""
    own = lines.filter((F.col("path") == path) & F.col("line").between(start, min(end, start + most - 1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return own.groupBy("path").agg(text.alias("text"), F.count(F.lit(1)).alias("lines")).withColumn("cut", F.lit(end - start + 1 > most))


def investigate(symbols: DataFrame, files: DataFrame, relations: DataFrame, changed: DataFrame, text: str, budget: str = "small") -> DataFrame:
    """ask() with a flag for items of changed paths (path)."""
    packet = asking.ask(symbols, files, relations, text, budget)
    return packet.join(changed.select("path").distinct().withColumn("c", F.lit(True)), "path", "left").withColumn("changed", F.coalesce("c", F.lit(False))).drop("c")


def debug_trace(traces: DataFrame, symbols: DataFrame, files: DataFrame, budget: str = "small") -> DataFrame:
    """(query_id, rank, path, name, score) for traces (id, text): the innermost symbols of frames by appearance, then their siblings.

    A frame's path fits a file if either is a tail of the other; of several files the longest counts. Tails are exploded,
    so that this is an equi join.
    """
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    frames = change.stack_frames(traces, "id", "text").withColumn("frame", F.regexp_replace("path", r"^\./", "")).drop("path")
    by_tail = files.select("path", F.explode(tails(F.col("path"))).alias("tail"))
    whole = files.select("path", F.col("path").alias("tail"))
    hit = frames.join(by_tail, F.col("frame") == F.col("tail")).select("id", "place", "line", "path").unionByName(
        frames.withColumn("t", F.explode(tails(F.col("frame")))).join(whole, F.col("t") == F.col("tail")).select("id", "place", "line", "path")
    )
    hit = hit.distinct().withColumn("best", F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc(F.length("path")), "path"))).filter("best = 1").drop("best")
    spans = symbols.select(F.col("id").alias("symbol"), "path", "name", F.col("span.start_line").alias("start"), F.col("span.end_line").alias("end"), "ordinal")
    inside = hit.join(spans, "path").filter(F.col("line").between(F.col("start"), F.col("end")))
    inside = inside.withColumn("in", F.row_number().over(Window.partitionBy("id", "place").orderBy(F.col("end") - F.col("start"), F.desc("start")))).filter("in = 1")
    seeds = inside.select(F.col("id").alias("query_id"), "path", "name", change.frame_weight(F.col("place")).alias("score"), "ordinal")
    near = spans.join(seeds.select("query_id", "path").distinct(), "path").select("query_id", "path", "name", F.lit(0.4).alias("score"), "ordinal")
    return ranking.diverse(seeds.unionByName(near), top_k(budget))


def diff_context(hunks: DataFrame, symbols: DataFrame, budget: str = "small", label: str = "diff") -> DataFrame:
    """(query_id, rank, path, name, score): symbols that hunks (path, start, end) touch, all at 0.9."""
    spans = symbols.withColumns({"start": F.col("span.start_line"), "end": F.col("span.end_line")})
    touched = change.overlapping(spans, hunks.select("path", F.col("start").alias("h_start"), F.col("end").alias("h_end")))
    rows = touched.dropDuplicates(["id"]).select(F.lit(label).alias("query_id"), "path", "name", F.lit(0.9).alias("score"), "ordinal")
    return ranking.diverse(rows, top_k(budget))


def test_pattern(files: DataFrame) -> DataFrame:
    """One row: where tests are: directories, beside the code, or none."""
    test = C.is_test_path(F.col("path"))
    in_dir = C.any_of([F.lower("path").rlike(f"(^|/){d}/") for d in C.TEST_DIRS])
    n = files.agg(F.sum(F.when(test, 1).otherwise(0)).alias("tests"), F.sum(F.when(test & in_dir, 1).otherwise(0)).alias("apart"))
    name = F.when(F.coalesce("tests", F.lit(0)) == 0, "no tests").when(F.col("apart") * 2 >= F.col("tests"), "test directories").otherwise("beside the code")
    return n.select(name.alias("pattern"), F.coalesce("tests", F.lit(0)).cast("long").alias("tests"))


def onboard(files: DataFrame, symbols: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(section, key, value): languages, directories, build, naming, tests, key symbols, vocabulary."""
    text = lambda d, section, key, value: d.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    key_symbols = symbols.join(graph.degrees(edges), "id").orderBy(F.desc("degree"), "id").limit(k)
    parts = [
        text(reports.language_histogram(files), "language", "language", "files"), text(reports.top_dirs(files, 15), "dir", "dir", "files"),
        text(reports.architecture(files).withColumn("k", F.lit("architecture")), "build", "k", "architecture"), text(reports.naming_style(symbols).withColumn("k", F.lit("naming")), "style", "k", "naming"),
        text(test_pattern(files), "tests", "pattern", "tests"), text(key_symbols, "key symbol", "name", "degree"), text(reports.glossary(symbols, k), "term", "term", "symbols"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
