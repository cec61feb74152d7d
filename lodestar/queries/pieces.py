"""Queries over single predicates, scores and gates that the larger ones are made of, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import columns as C
from ..functions.text import Token, expand
from ..model import CODE, IndexConfig
from ..operators import graph, memory, reports, search, vectors
from ..plans import index
from ..sources import trees
from .changes import PROJECT
from .code import ORACLES, QUERIES, query, tiers

__all__ = ["ORACLES", "QUERIES"]


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\pL\pN])the([^\pL\pN]|$)') AS word, regexp_matches(lower(text), '(^|[^\pL\pN])tion([^\pL\pN]|$)') AS part FROM documents")
def whole_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("text")
    return B.table(spark, d, "documents").select("doc_id", C.contains_word(text, "the").alias("word"), C.contains_word(text, "tion").alias("part"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(t, 'thent') THEN 1.0 WHEN contains(t, 'ation') THEN 0.95 WHEN contains(t, 'thely') THEN 0.72 ELSE 0.0 END::DOUBLE AS long_token,
 CASE WHEN regexp_matches(t, '(^|[^\pL\pN])the([^\pL\pN]|$)') THEN 1.0 ELSE 0.0 END::DOUBLE AS short_token FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def text_strengths(spark: SparkSession, d: str) -> DataFrame:
    """A token in a text: itself, its stems and synonyms of four letters or more, short ones as whole words."""
    text = F.lower("text")
    return B.table(spark, d, "conversations").select("conv_id", "turn", C.text_strength(Token("thent", ("ation", "the"), ("thely",)), text).alias("long_token"), C.text_strength(Token("the", ("er",), ("on",)), text).alias("short_token"))


@query("""WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part), v AS (SELECT id, greatest(CASE WHEN contains(n, 'bolt') THEN 0.3 + least(4.0::DOUBLE / strlen(n), 1.0) * 0.35 ELSE 0 END, CASE WHEN contains(n, 'gear') THEN 0.3 + least(4.0::DOUBLE / strlen(n), 1.0) * 0.35 ELSE 0 END) AS score FROM s)
SELECT id, round(score, 6)::DOUBLE AS score FROM v WHERE score > 0""")
def synonym_scores(spark: SparkSession, d: str) -> DataFrame:
    score = C.single_score(Token("qqqq", (), ("bolt", "gear")), F.col("name_lower"), F.col("name_words"))
    return B.symbols(spark, d).select("id", F.round(score, 6).alias("score")).filter("score > 0")


@query("""WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n, string_split(lower(p_name), ' ') AS w FROM part)
SELECT id, CASE WHEN contains(n, 'ring') THEN 1.0 WHEN list_contains(w, 'hot') THEN 0.95 WHEN contains(n, 'bolt') THEN 0.72 ELSE 0.0 END::DOUBLE AS strength FROM s""")
def name_strengths(spark: SparkSession, d: str) -> DataFrame:
    """A token in a name: short variants as whole words, longer ones anywhere."""
    return B.symbols(spark, d).select("id", C.name_strength(Token("ring", ("hot",), ("bolt",)), F.col("name_lower"), F.col("name_words")).alias("strength"))


@query("SELECT p_partkey AS id, concat_ws(' ', lower(p_type), array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), ' '), p_brand) AS text, sha256(concat_ws(' ', lower(p_type), array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), ' '), p_brand)) AS digest FROM part")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    return vectors.embed_text(B.symbols(spark, d).withColumn("doc_summary", F.lit(None).cast("string")))


@query("""WITH s AS (SELECT s_suppkey AS k, count(*) OVER () AS n FROM supplier) SELECT DISTINCT 'f' || k AS source_id, 'f' || ((k + 1) % n) AS target_id FROM s WHERE n > 1""")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each file names the next one: by its dotted path, beside it, or from the folder above."""
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    n = s.count()
    name = lambda k: F.concat(F.lit("supplier"), k.cast("string"))
    files = s.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("pkg/"), name(F.col("k")), F.lit(".py")).alias("path"))
    following = name((F.col("k") + 1) % n)
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("pkg."), following)).when(F.col("k") % 3 == 1, F.concat(F.lit("."), following)).otherwise(F.concat(F.lit("crate::pkg::"), following))
    imports = s.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_id"), F.concat(F.lit("pkg/"), name(F.col("k")), F.lit(".py")).alias("path"), said.alias("import_path"), F.array().cast("array<string>").alias("names"), F.lit(1).alias("line"))
    return index.import_edges(files, imports).select("source_id", "target_id")


@query("""SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'missing' ELSE 'touched' END AS why
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 5 END AS size, CASE WHEN o_orderkey % 7 = 0 THEN 200 ELSE 50 END AS t FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, 5 AS size FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.size <> b.size OR a.t >= 100""")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """A listing against a known one: new, missing, of another size, touched since the scan."""
    k = F.col("o_orderkey")
    o = B.table(spark, d, "orders")
    listing = o.filter(k % 3 != 0).select(k.alias("path"), F.when(k % 4 == 0, 7).otherwise(5).alias("size"), F.when(k % 7 == 0, 200.0).otherwise(50.0).alias("mtime"))
    known = o.filter(k % 5 != 0).select(k.alias("path"), F.lit(5).alias("size"))
    return trees.staleness(listing, known, 100.0)


STATES = "CASE WHEN doc_id % 5 = 0 THEN 'asset' WHEN n_chars > 2000 THEN 'oversize' WHEN text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'binary' ELSE 'full' END"


def gated_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: pictures, long ones, some with a zero byte in front."""
    i = F.col("doc_id")
    path = F.concat(F.lit("d/"), i.cast("string"), F.when(i % 5 == 0, ".PNG").otherwise(".py"))
    body = F.when(i % 7 == 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    return trees.gated(B.table(spark, d, "documents").select(i, path.alias("path"), F.col("n_chars").alias("size"), body.cast("binary").alias("content")), IndexConfig(max_file_bytes=2000))


@query(f"SELECT doc_id, {STATES} AS state, CASE WHEN {STATES} = 'full' THEN length(text) END AS chars FROM documents")
def read_gates(spark: SparkSession, d: str) -> DataFrame:
    return gated_docs(spark, d).select("doc_id", "state", F.length("content").cast("long").alias("chars"))


@query(f"""WITH g AS (SELECT 'd/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.PNG' ELSE '.py' END AS path, {STATES} AS state, n_chars, text, doc_id FROM documents)
SELECT path, 'f:' || substr(CASE WHEN state = 'full' THEN sha256(text) ELSE sha256(path) END, 1, 12) AS id, CASE WHEN state = 'full' THEN sha256(text) ELSE 'skip:' || n_chars END AS hash, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'python' END AS language FROM g""")
def file_entries(spark: SparkSession, d: str) -> DataFrame:
    return trees.file_entries(gated_docs(spark, d)).select("path", "id", "hash", "language")


@query("SELECT p_brand, p_partkey AS id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part) WHERE place <= 3")
def top_of_each(spark: SparkSession, d: str) -> DataFrame:
    return graph.rank_by_place(B.table(spark, d, "part"), "p_brand", F.desc("p_size"), "p_partkey", most=3).select("p_brand", F.col("p_partkey").alias("id"), "place")


@query(f"""WITH {PROJECT}, v AS (SELECT ordinal AS id, lower(name) AS n, test FROM s), tt AS (SELECT id, {tiers('gear')} * CASE WHEN test THEN 0.5 ELSE 1.0 END AS score FROM v WHERE {tiers('gear')} > 0)
SELECT id, round(score, 6) AS score FROM tt ORDER BY tt.score DESC, id LIMIT 20""")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    """The keyword form of a concept search, test code at half."""
    symbols = search.with_search_columns(B.project(spark, d)[1])
    return search.semantic_keyword(symbols, expand("gear").text, 20).select(F.col("ordinal").alias("id"), F.round("score", 6).alias("score"))


@query("SELECT conv_id % 10 AS id, CASE conv_id % 10 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.7 WHEN 5 THEN 0.7 WHEN 6 THEN 0.6 ELSE 0.5 END::DOUBLE AS weight, count(*) AS n FROM conversations GROUP BY 1, 2")
def kind_weights(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("fixme", "decision", "todo", "note", "hack", "xxx", "doc", "doc_section", "other", "more")))
    rows = B.table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("id"))
    return rows.groupBy("id", C.kind_weight(F.get(kinds, F.col("id").cast("int"))).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT s_suppkey, ['rust', 'typescript', 'javascript', 'python', 'go', 'java', 'csharp', 'kotlin', 'c', 'cpp', 'markdown', 'json'][s_suppkey % 12 + 1] AS language FROM supplier) SELECT s_suppkey AS id, language NOT IN ('markdown', 'json') AS code FROM v")
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    language = F.get(F.array(*map(F.lit, ("rust", "typescript", "javascript", "python", "go", "java", "csharp", "kotlin", "c", "cpp", "markdown", "json"))), (F.col("s_suppkey") % 12).cast("int"))
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), language.isin(*CODE).alias("code"))


@query("SELECT o_custkey AS key, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place <= 2")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return reports.per_key(B.table(spark, d, "orders"), "o_custkey", F.col("o_orderkey"), 2).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))


@query("""WITH f AS (SELECT ['a/src' || n_nationkey || '.py', 'src' || n_nationkey || '.py', 'other.py'] AS files, n_nationkey AS id FROM nation) SELECT id, len(list_filter(files, lambda x: ends_with(x, 'src3.py') OR ends_with('src3.py', x))) > 0 AS hit FROM f""")
def related_file_overlap(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    rows = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.concat(F.lit("a/src"), k, F.lit(".py")), F.concat(F.lit("src"), k, F.lit(".py")), F.lit("other.py")).alias("related_files"))
    return rows.select("id", memory.overlaps("src3.py").alias("hit"))


@query("SELECT '{\"type\":\"relation\",\"source_id\":' || l_suppkey || ',\"target_id\":' || l_partkey || ',\"kind\":\"calls\",\"weight\":1.0}' AS line FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT '{\"type\":\"file\",\"id\":\"' || p_brand || '\",\"path\":\"' || p_brand || '\",\"language\":\"rust\",\"size\":' || CAST(sum(p_size) AS BIGINT) || '}' FROM part GROUP BY p_brand")
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.jsonl(file=B.brand_files(spark, d), relation=B.calls(spark, d))
