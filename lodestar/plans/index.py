"""Building an index: files, symbols, imports, calls, tests and configs as relations, memories; full and incremental.

Raw imports and calls are kept, so that every edge can be derived again from the rows of all files: an incremental run
parses the changed files alone and derives edges from kept and new rows together, and equals a full run.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CODE, IndexConfig
from ..operators import graph
from ..sources import parsers, records, trees

SCHEMA_VERSION = 2
NEAR_STEM, MOST_STEMS, MOST_TESTED = 4, 3, 5
PROXIMITY = ((0, 1.0), (1, 0.9), (2, 0.8), (3, 0.6))
CONFIG_FILE = r"(?i)(^|/)(config|settings)[^/]*\.(py|js|ts|json|ya?ml|toml)$|(^|/)[^/]*\.(toml|ya?ml|ini|env|cfg)$|(^|/)(package|tsconfig)\.json$"


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    raw: DataFrame
    relations: DataFrame
    dropped: DataFrame
    memories: DataFrame

    def write(self, path: str) -> Index:
        """All tables into a new snapshot below path; a reader sees it once its `ready` mark is there, and the old one until then."""
        spark = self.files.sparkSession
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{name}/{f.name}")
        spark.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").coalesce(1).write.json(f"{path}/{name}/ready")
        return load(spark, path)


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Complete snapshots below path, the newest last: the committed mark is written after all tables."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/ready/_SUCCESS")) or []
    return sorted(m.getPath().getParent().getParent().getName() for m in marks)


def load(spark: SparkSession, path: str) -> Index:
    """The newest complete snapshot below path."""
    found = snapshots(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    version = spark.read.schema("schema_version int").json(f"{path}/{found[-1]}/ready").first()[0]
    if version != SCHEMA_VERSION:
        raise ValueError(f"the index at {path} has schema {version}, not {SCHEMA_VERSION}: index the tree again")
    return Index(*[spark.read.parquet(f"{path}/{found[-1]}/{f.name}") for f in fields(Index)])


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(C.file_name(path), r"\.[^.]*$", ""))


def suffixes(path: Column) -> Column:
    """All tails of a path without its extension: a/b/c -> a/b/c, b/c, c."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, weight): each import's best stage: relative file, dotted path, package, unique stem.

    Candidates of an import are an array, so that a stage is one equi join; the lowest stage with a hit counts.
    """
    ids = files.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    tails = ids.select("target_id", "target_path", F.explode(suffixes(F.col("target_path"))).alias("key"))
    tails = tails.join(tails.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    raw = F.regexp_replace(F.col("import_path"), r"::|(?<=\w)\.(?=\w)", "/")
    clean = F.regexp_replace(F.regexp_replace(raw, r"^(crate|self|super)/", ""), r"\.(js|ts|tsx|jsx|h|hpp)$", "")
    relative = F.regexp_replace(clean, r"^(\./|\.+)", "")
    here = F.concat_ws("/", F.nullif(C.dir_of(F.col("path")), F.lit("")), relative)
    up = F.concat_ws("/", F.nullif(C.dir_of(C.dir_of(F.col("path"))), F.lit("")), F.regexp_replace(clean, r"^\.\./", ""))
    named = F.transform(F.col("names"), lambda n: F.concat_ws("/", F.nullif(relative, F.lit("")), n))
    parent = F.regexp_replace(relative, "/[^/]*$", "")
    stages = [F.array(here, F.concat(here, F.lit("/index")), F.concat(here, F.lit("/mod")), F.concat(here, F.lit("/__init__"))), F.array(up), F.array(relative), named, F.array(parent)]
    keyed = imports.withColumn("keys", F.flatten(F.array(*[at_stage(s, i) for i, s in enumerate(stages)])))
    keyed = keyed.select(F.col("file_id").alias("source_id"), "path", "import_path", "line", F.explode("keys").alias("k")).select("source_id", "path", "import_path", "line", "k.stage", "k.key").filter("key <> ''")
    hits = keyed.join(tails, "key").filter((F.col("stage") < 2) & (F.col("key") == F.regexp_replace("target_path", r"\.[^./]*$", "")) | (F.col("stage") >= 2) & (F.col("n") <= MOST_STEMS) & (F.length("key") >= NEAR_STEM))
    best = hits.withColumn("least", F.min("stage").over(Window.partitionBy("source_id", "import_path", "line"))).filter("stage = least")
    return best.filter("source_id <> target_id").select("source_id", "target_id").distinct().select("source_id", "target_id", F.lit("imports").alias("kind"), F.lit(1.0).cast("float").alias("weight"))


def at_stage(keys: Column, stage: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(stage).alias("stage"), k.alias("key")))


def test_edges(files: DataFrame) -> DataFrame:
    """Test file to the files of its stem, by nearness of their directories; over MOST_TESTED of them say nothing."""
    base = F.regexp_replace(stem(F.col("path")), r"^test_|(_test|_tests|_unittest|_spec|\.test|\.spec)$|(?<=.)tests?$", "")
    tests = files.filter(C.is_test_path(F.col("path"))).select(F.col("id").alias("source_id"), F.col("path").alias("test_path"), base.alias("stem")).filter("stem <> ''")
    code = files.filter(~C.is_test_path(F.col("path"))).select(F.col("id").alias("target_id"), "path", stem(F.col("path")).alias("stem"))
    rows = tests.join(code, "stem").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_id"))).filter(F.col("n") <= MOST_TESTED)
    a, b = F.split(C.dir_of(F.col("test_path")), "/"), F.split(C.dir_of(F.col("path")), "/")
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    weight = F.lit(PROXIMITY[-1][1])
    for steps, w in reversed(PROXIMITY):
        weight = F.when(apart <= steps, w).otherwise(weight)
    return rows.select("source_id", "target_id", F.lit("test_for").alias("kind"), weight.cast("float").alias("weight"))


def config_edges(files: DataFrame) -> DataFrame:
    """Config files to the code beside them, outside the root."""
    own = files.withColumn("dir", C.dir_of(F.col("path"))).filter("dir <> ''")
    config = own.filter(F.col("path").rlike(CONFIG_FILE)).select(F.col("id").alias("source_id"), "dir")
    code = own.filter(~F.col("path").rlike(CONFIG_FILE) & F.col("language").isin(*CODE)).select(F.col("id").alias("target_id"), "dir")
    return config.join(code, "dir").select("source_id", "target_id", F.lit("config_for").alias("kind"), F.lit(0.5).cast("float").alias("weight"))


def derived(files: DataFrame, raw: DataFrame, config: IndexConfig, stop: DataFrame | None = None) -> Index:
    """An index from the files table and parsed() rows of all files."""
    symbols = parsers.symbol_rows(raw, files, config.max_symbols_per_file)
    imports = raw.select("path", "file_id", F.explode("imports").alias("i")).select("path", "file_id", "i.import_path", "i.names", "i.line")
    called = raw.select("path", "file_id", F.explode("calls").alias("c")).select("path", "c.caller_line", "c.callee", "c.is_method")
    at = symbols.filter(F.col("kind").isin("function", "method")).select("path", F.col("span.start_line").alias("caller_line"), F.col("id").alias("caller_id"))
    calls = graph.resolve_calls(called.join(at, ["path", "caller_line"]), symbols, stop)
    kept, dropped = graph.without_noise(calls, symbols.select("id", "path"), config.max_caller_files, config.cross_file_calls_only)
    relations = import_edges(files, imports).unionByName(test_edges(files)).unionByName(config_edges(files)).unionByName(kept)
    return Index(files, symbols, raw, relations.dropDuplicates(["source_id", "target_id", "kind"]), dropped, parsers.comment_memories(raw))


def with_docs(files: DataFrame, raw: DataFrame) -> DataFrame:
    """files with the header doc of a module as its purpose."""
    docs = raw.select("path", "module_doc")
    said = files.drop("purpose", "purpose_source").join(docs, "path", "left")
    return said.withColumns({"purpose": F.col("module_doc"), "purpose_source": F.when(F.col("module_doc").isNotNull(), "doc")}).select(*files.columns)


def full(spark: SparkSession, root: str, config: IndexConfig | None = None, stop: DataFrame | None = None) -> Index:
    config = config or IndexConfig()
    rows = trees.read_tree(spark, root, config)
    files = trees.file_entries(rows)
    raw = parsers.parsed(rows.join(files.select("path", "id", "language"), "path"))
    return derived(with_docs(files, raw), raw, config, stop)


def incremental(spark: SparkSession, old: Index, root: str, config: IndexConfig | None = None, stop: DataFrame | None = None) -> Index:
    """The index of root's present state: only files whose content differs from the old index are parsed."""
    config = config or IndexConfig()
    rows = trees.read_tree(spark, root, config)
    files = trees.file_entries(rows)
    dirty = files.join(old.files.select("path", F.col("hash").alias("known")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("known"))).select("path")
    fresh = parsers.parsed(rows.join(files.select("path", "id", "language"), "path").join(dirty, "path", "left_semi"))
    kept = old.raw.join(dirty, "path", "left_anti").join(files.select("path"), "path", "left_semi")
    raw = kept.unionByName(fresh)
    return derived(with_docs(files, raw), raw, config, stop)


def targeted(spark: SparkSession, old: Index, root: str, paths: list[str], config: IndexConfig | None = None, stop: DataFrame | None = None) -> Index:
    """old with the given files (relative to root) read again: new ones added, vanished ones gone, no other file opened.

    Edges are derived from the rows of all files, so that the result equals a full index if no other file has changed.
    A path outside root is an error, and nothing is indexed.
    """
    config = config or IndexConfig()
    rel = [records.pathless(p, root) for p in paths]
    if outside := [p for p, r in zip(paths, rel, strict=True) if r is None]:
        raise ValueError(f"outside {root}: {', '.join(outside)}")
    named = spark.createDataFrame([(r,) for r in sorted(set(rel))], "path string")
    rows = trees.read_tree(spark, root, config, paths=rel)
    fresh_files = trees.file_entries(rows)
    files = old.files.join(F.broadcast(named), "path", "left_anti").select(*old.files.columns).unionByName(fresh_files)
    fresh = parsers.parsed(rows.join(fresh_files.select("path", "id", "language"), "path"))
    raw = old.raw.join(F.broadcast(named), "path", "left_anti").unionByName(fresh)
    return derived(with_docs(files, raw), raw, config, stop)


def changed(spark: SparkSession, old: Index, root: str, config: IndexConfig | None = None, stop: DataFrame | None = None) -> Index:
    """targeted() for what git says has changed, is staged or untracked; old itself where nothing has."""
    paths = [r["path"] for r in records.changed_paths(spark, root).collect()]
    return targeted(spark, old, root, paths, config, stop) if paths else old
