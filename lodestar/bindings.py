"""The driver's tables as logical tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.search import with_search_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: a part is a symbol, its brand the file, its type the kind, its size the lines of its span."""
    part = table(spark, sf_dir, "part")
    span = F.struct(F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("path"),
        F.lit(None).cast("string").alias("signature"), span.alias("span"), F.lit(None).cast("string").alias("parent_symbol_id"), (F.col("p_size") > 25).alias("exported"), F.col("p_partkey").alias("ordinal"),
    )
    return with_search_columns(rows)


def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.sum("p_size").alias("size")).select(F.col("path").alias("id"), "path", F.lit("rust").alias("language"), "size")


def brand_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: a brand imports, tests or configures another by each of its parts' numbers."""
    other = F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))
    kind = F.when(F.col("p_size") % 3 == 0, "imports").when(F.col("p_size") % 3 == 1, "test_for").otherwise("config_for")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), other.alias("target_id"), kind.alias("kind")).filter("source_id <> target_id").distinct()
    return rows.withColumn("weight", F.lit(1.0).cast("float"))


def project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, relations): suppliers are files in seven folders, every fifth a test of the next; parts are their functions.

    Each line item makes its part call another one.
    """
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    path = F.concat(F.lit("m"), (F.col("k") % 7).cast("string"), F.when(F.col("k") % 5 == 0, "/test_s").otherwise("/s"), F.col("k").cast("string"), F.lit(".py"))
    files = s.select(F.col("s_suppkey").alias("k")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("id"), path.alias("path"), F.lit("python").alias("language"), F.lit(100).cast("long").alias("size"))
    n_files, n_parts = s.count(), p.count()
    own = p.withColumn("k", F.col("p_partkey") % n_files)
    start = F.col("p_partkey") % 40 * 10 + 1
    span = F.struct(start.cast("int").alias("start_line"), (start + F.col("p_size") % 9).cast("int").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    symbols = own.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_id"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), path.alias("path"),
        F.lit(None).cast("string").alias("signature"), span.alias("span"), F.lit(None).cast("string").alias("parent_symbol_id"), (F.col("p_size") > 25).alias("exported"), F.col("p_partkey").alias("ordinal"),
    )
    other = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % n_parts
    key = lambda c, kind="p": F.concat(F.lit(kind), c.cast("string"))
    calls = table(spark, sf_dir, "lineitem").select(key(F.col("l_partkey")).alias("source_id"), key(other).alias("target_id")).filter("source_id <> target_id").distinct().withColumn("kind", F.lit("calls"))
    tests = s.filter("s_suppkey % 5 = 0").select(key(F.col("s_suppkey"), "f").alias("source_id"), key((F.col("s_suppkey") + 1) % n_files, "f").alias("target_id"), F.lit("test_for").alias("kind"))
    return files, symbols, calls.unionByName(tests).withColumn("weight", F.lit(1.0).cast("float"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: path source/lang/doc_id, language, size, hash of the text."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return d.select(F.sha2("text", 256).alias("hash"), path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), "doc_id", "text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a supplier calls the parts it ships."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")).distinct()
    return pairs.select("source_id", "target_id", F.lit("calls").alias("kind"), F.lit(1.0).cast("float").alias("weight"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an order is a commit, its parts are the files."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path")).distinct()


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): orders hang on customers, these and suppliers on nations, nations on regions."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("nation").select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("source"), key("n", "c_nationkey").alias("target")))
        .unionByName(t("supplier").select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target")))
        .unionByName(t("orders").select(key("o", "o_orderkey").alias("source"), key("c", "o_custkey").alias("target")))
    )


def project_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: one entry each, its turns in order; kind, pin and tags by its number."""
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = c.groupBy("conv_id").agg(F.array_join(turns, "\n").alias("content"), F.count(F.lit(1)).alias("n_turns"))
    kind = F.element_at(F.array(*map(F.lit, ("note", "decision", "warning", "context"))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    return rows.select(
        F.col("conv_id").alias("id"), kind.alias("kind"), F.lit(None).cast("string").alias("title"), "content", F.array(F.concat(F.lit("t"), F.pmod("conv_id", F.lit(5)).cast("string"))).alias("tags"),
        F.array(F.concat(F.lit("src"), F.pmod("conv_id", F.lit(20)).cast("string"))).alias("related_files"), F.array(F.pmod("conv_id", F.lit(11)).cast("string")).alias("related_symbols"),
        (F.pmod("conv_id", F.lit(7)) == 0).alias("pinned"), F.when(F.pmod("conv_id", F.lit(9)) == 0, "archived").otherwise("active").alias("status"),
        F.when(F.pmod("conv_id", F.lit(13)) == 0, F.col("conv_id") - 11).alias("supersedes"), F.col("n_turns").alias("updated_at"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("path"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_type").alias("command"), F.floor("value").cast("long").alias("bytes_served"), F.when(raw % 5 != 4, raw).alias("raw_baseline"), "ts")
