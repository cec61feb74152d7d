"""Queries over documents, memories, vectors, events and packets, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import columns as C
from ..functions.text import INTENTS, STOP_WORDS
from ..operators import graph, history, memory, ranking, reports, search, vectors
from ..plans import ask as plans
from ..plans import explore
from .code import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

LINES = "SELECT doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"""WITH l AS ({LINES}), t AS (SELECT path, line, trim(text, ' ') AS t FROM l), s AS (SELECT *, sum(starts_with(t, '#')::INT) OVER (PARTITION BY path ORDER BY line) AS section FROM t),
g AS (SELECT path, CAST(section AS BIGINT) AS section, coalesce(string_agg(t, ' ' ORDER BY line) FILTER (WHERE NOT starts_with(t, '#') AND t <> ''), '') AS body, CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line FROM s GROUP BY path, section)
SELECT path, section, CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE body END AS body, start_line, end_line FROM g WHERE strlen(body) >= 10""")
def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    found = memory.doc_sections(docs, "path", "text")
    return found.select(F.col("path").cast("long").alias("path"), "section", "body", "start_line", "end_line")


@query(f"""WITH l AS ({LINES}), k AS (SELECT CASE WHEN starts_with(upper(trim(text, ' ')), 'TODO') THEN 'todo' WHEN starts_with(upper(trim(text, ' ')), 'FIXME') THEN 'fixme' WHEN starts_with(upper(trim(text, ' ')), 'NOTE') THEN 'note' WHEN starts_with(upper(trim(text, ' ')), 'HACK') THEN 'hack' WHEN starts_with(upper(trim(text, ' ')), 'XXX') THEN 'xxx' ELSE 'regular' END AS kind FROM l)
SELECT kind, count(*) AS lines FROM k GROUP BY kind""")
def comment_markers(spark: SparkSession, d: str) -> DataFrame:
    return B.doc_lines(spark, d).groupBy(C.comment_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^\\pL\\pN_]+'), lambda w: lower(w)), lambda w: strlen(w) >= 3 AND w NOT IN ({STOPS})))) AS anchors FROM benchmark""")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").select("item_id", memory.anchors(F.col("text")).alias("anchors"))


@query(f"""WITH m AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'decision' ELSE 'doc_section' END AS kind, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^\\pL\\pN_]+'), lambda w: lower(w)), lambda w: strlen(w) >= 3 AND w NOT IN ({STOPS})))) AS a FROM benchmark),
s AS (SELECT id, kind, (len(list_filter(a, lambda x: contains(x, 'thent') OR contains('thent', x))) > 0)::INT + (len(list_filter(a, lambda x: contains(x, 'erbl') OR contains('erbl', x))) > 0)::INT AS t FROM m)
SELECT id, kind, round((t / 2 + CASE WHEN kind = 'decision' THEN 0.2 ELSE 0 END) * CASE WHEN kind = 'decision' THEN 0.9 ELSE 0.5 END, 6)::DOUBLE AS relevance FROM s WHERE t > 0 ORDER BY relevance DESC, id LIMIT 8""")
def rationale_match(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("item_id") % 3 == 0, "decision").otherwise("doc_section")
    rows = B.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), kind.alias("kind"), memory.anchors(F.col("text")).alias("anchors"), C.kind_weight(kind).alias("weight"))
    return memory.rationale(rows, ["thent", "erbl"], 8).select("id", "kind", "relevance")


@query("""WITH s AS (SELECT doc_id, trim(string_split(text, '. ')[1], ' ') AS one FROM documents) SELECT doc_id, CASE WHEN length(one) > 80 THEN substr(one, 1, 77) || '...' ELSE one END AS sentence FROM s""")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", C.first_sentence(F.col("text"), 80).alias("sentence"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS head FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", C.truncate(F.col("text"), 100).alias("head"))


@query(f"WITH l AS ({LINES}) SELECT path, count(*) AS lines FROM l WHERE regexp_matches(lower(text), 'licen[cs]e|copyright') GROUP BY path")
def license_header(spark: SparkSession, d: str) -> DataFrame:
    return B.doc_lines(spark, d).filter(F.lower("text").rlike("licen[cs]e|copyright")).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


ENTRIES = """SELECT conv_id AS id, ['note', 'decision', 'warning', 'context'][conv_id % 4 + 1] AS kind, string_agg(text, chr(10) ORDER BY turn) AS content, 't' || (conv_id % 5) AS tag, 'src' || (conv_id % 20) AS file, CAST(conv_id % 11 AS VARCHAR) AS symbol,
 conv_id % 7 = 0 AS pinned, CASE WHEN conv_id % 9 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN conv_id % 13 = 0 THEN conv_id - 11 END AS supersedes, count(*) AS updated_at FROM conversations GROUP BY conv_id"""


@query(f"""WITH e AS ({ENTRIES}), h AS (SELECT *, (contains(lower(content), 'thent'))::INT + (contains(tag, 'thent'))::INT + (contains(lower(content), 'queu'))::INT + (contains(tag, 'queu'))::INT AS hits FROM e WHERE status = 'active')
SELECT id, kind, round(hits / 2 + CASE WHEN kind = 'warning' THEN 0.15 WHEN kind = 'decision' THEN 0.1 ELSE 0 END + CASE WHEN pinned THEN 0.2 ELSE 0 END + CASE WHEN file = 'src3' THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score FROM h WHERE hits > 0 OR file = 'src3' ORDER BY score DESC, id LIMIT 25""")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return memory.search(B.project_memory(spark, d), "thent queu", 25, files=["src3"]).select("id", "kind", "score")


@query(f"""WITH e AS ({ENTRIES}), t AS (SELECT id, unnest(regexp_split_to_array(lower(content), '[^\\pL\\pN_]+')) AS term FROM e) SELECT DISTINCT id FROM t WHERE strlen(term) >= 3 AND term NOT IN ({STOPS}) AND (starts_with(term, 'schau') OR starts_with(term, 'ingou'))""")
def memory_candidates_prefix(spark: SparkSession, d: str) -> DataFrame:
    return memory.candidates(memory.postings(B.project_memory(spark, d)), "schau ingou")


@query(f"""WITH e AS ({ENTRIES}), a AS (SELECT * FROM e WHERE status = 'active'), b AS (SELECT symbol, content, min(id) AS id FROM a WHERE id NOT IN (SELECT supersedes FROM a WHERE supersedes IS NOT NULL) GROUP BY 1, 2)
SELECT 'symbol:' || symbol AS signal, list_sort(list(id)) AS ids FROM b GROUP BY symbol HAVING count(*) >= 2""")
def memory_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return memory.conflicts(B.project_memory(spark, d))


@query(f"WITH e AS ({ENTRIES}) SELECT id, pinned, updated_at FROM e ORDER BY pinned DESC, updated_at DESC, id LIMIT 20")
def memory_listing(spark: SparkSession, d: str) -> DataFrame:
    return memory.listing(B.project_memory(spark, d), 20).select("id", "pinned", "updated_at")


@query(f"WITH e AS ({ENTRIES}) SELECT status, count(*) AS entries FROM e GROUP BY status")
def memory_doctor(spark: SparkSession, d: str) -> DataFrame:
    return B.project_memory(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("entries"))


COSINE = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id AS id, {COSINE} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY cosine DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    return vectors.top_k(v, v.filter("id = 0").first()["embedding"], 10)


@query(f"SELECT * FROM (SELECT q.vec_id AS query, e.vec_id AS id, {COSINE} AS cosine, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS INTEGER) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE place <= 5")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    return vectors.top_k_batch(v, v.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q")), 5)


@query(f"""WITH c AS (SELECT e.vec_id AS id, label AS path, {COSINE} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q), v AS (SELECT *, 0.2 + greatest(0, least(1, (cosine - 0.05) / 0.95)) * 0.7 AS ramp FROM c WHERE cosine >= 0.05),
s AS (SELECT *, CASE WHEN cosine < 0.75 THEN least(ramp, 0.48) ELSE ramp END AS score FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, id) AS place FROM s WHERE score > 0)
SELECT id, CAST(path AS VARCHAR) AS path, round(score, 6)::DOUBLE AS score FROM f WHERE place = 1 ORDER BY cosine DESC, id LIMIT 10""")
def vector_blend(spark: SparkSession, d: str) -> DataFrame:
    from ..model import Weights

    v = B.vectors(spark, d)
    hits = vectors.top_k(v, v.filter("id = 1").first()["embedding"], 1 << 20).join(v.select("id", "path"), "id")
    known = spark.createDataFrame([], "id long, score double")
    return vectors.blend(hits, known, 0.5, Weights(vector_min_score=0.05, vector_score=0.2)).select("id", "path", "score")


@query(f"SELECT e.vec_id AS id, round({COSINE} * CASE WHEN label % 2 = 0 THEN 0.7 ELSE 1.0 END, 6)::DOUBLE AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q ORDER BY score DESC, id LIMIT 10")
def vector_test_demotion(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d).withColumn("test", F.col("path").cast("int") % 2 == 0)
    hits = vectors.top_k(v, v.filter("id = 2").first()["embedding"], 1 << 20).join(v.select("id", "test"), "id")
    return hits.select("id", F.round(F.col("cosine") * F.when(F.col("test"), 0.7).otherwise(1.0), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("SELECT CAST(label AS VARCHAR) AS path, count(*) AS vectors FROM embeddings GROUP BY 1")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return B.vectors(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("vectors"))


INTENT_CASE = " ".join(f"WHEN w IN ({', '.join(repr(w) for w in own)}) THEN '{k}'" for k, own in INTENTS.items())


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), 1) AS i FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, i, CASE {INTENT_CASE} END AS intent FROM t), f AS (SELECT conv_id, turn, arg_min(intent, i) FILTER (WHERE intent IS NOT NULL) AS intent FROM k GROUP BY 1, 2) SELECT conv_id, turn, coalesce(intent, 'lookup') AS intent FROM f""")
def intent_detect(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", C.intent_of(F.col("text")).alias("intent"))


@query(f"SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda w: strlen(w) >= 3 AND w NOT IN ({STOPS}))).len() AS terms FROM conversations")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.size(C.memory_terms(F.col("text"), STOP_WORDS)).cast("long").alias("terms"))


@query("""WITH o AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path""")
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    old = docs.filter("path % 5 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    new = docs.filter("path % 11 <> 0").select("path", F.when(F.col("path") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return reports.fingerprint_diff(old, new)


@query("SELECT sha256(text) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedupe_by_digest(spark: SparkSession, d: str) -> DataFrame:
    return B.doc_files(spark, d).groupBy(F.col("hash").alias("id")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("SELECT sha256(text) AS id, min(concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id)) AS path FROM documents GROUP BY 1")
def canonical_path(spark: SparkSession, d: str) -> DataFrame:
    return reports.canonical_paths(B.doc_files(spark, d).withColumnRenamed("hash", "id"))


USAGE = """SELECT event_type AS command, CAST(floor(value) AS BIGINT) AS b, CASE WHEN k % 5 <> 4 THEN k END AS raw FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
MEASURES = """count(*) AS calls, CAST(sum(b) AS BIGINT) AS bytes_served, CAST(coalesce(sum(raw), 0) AS BIGINT) AS raw_baseline, CAST(sum(CASE WHEN raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS file_backed, CAST(sum(CASE WHEN raw = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pathless,
 CAST(sum((raw IS NULL)::INT) AS BIGINT) AS unmeasured, CAST(coalesce(sum(CASE WHEN raw IS NOT NULL THEN b END), 0) AS BIGINT) AS measured"""
RATIO = "CASE WHEN raw_baseline > 0 AND measured > 0 THEN round(raw_baseline / measured, 6) END AS ratio"


@query(f"WITH e AS ({USAGE}), g AS (SELECT command, {MEASURES} FROM e GROUP BY command) SELECT *, {RATIO} FROM g")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.usage(B.usage_events(spark, d))


@query(f"WITH e AS ({USAGE}), g AS (SELECT command, {MEASURES} FROM e GROUP BY ROLLUP (command)) SELECT *, {RATIO} FROM g")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.usage(B.usage_events(spark, d), rollup=True)


@query(f"WITH l AS ({LINES}) SELECT path, CAST(min(line) AS BIGINT) AS line, arg_min(text, line) AS text FROM l WHERE contains(lower(text), 'token') OR contains(lower(text), 'scum') GROUP BY path ORDER BY path LIMIT 50")
def grep_first_line(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(B.doc_lines(spark, d), ["token", "scum"], 50)


@query(f"""WITH l AS ({LINES}), h AS (SELECT *, max(contains(lower(text), 'pathetic')::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l), n AS (SELECT * FROM h WHERE near = 1)
SELECT path, CAST(line AS BIGINT) AS line, text, coalesce(line - lag(line) OVER (PARTITION BY path ORDER BY line) > 1, false) AS gap FROM n""")
def keyword_snippet(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_lines(B.doc_lines(spark, d), ["pathetic"])


@query("""WITH l AS (SELECT l_orderkey AS path, l_linenumber AS line, l_partkey, l_returnflag AS hash FROM lineitem), u AS (SELECT path, line, min(hash) AS hash FROM l GROUP BY 1, 2), b AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY line) AS before FROM u) SELECT path, line, hash FROM b WHERE before IS NULL OR hash <> before""")
def blame_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("hash"))
    return history.first_of_runs(rows, "path", "line", "hash")


@query()
def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = B.symbols(spark, d).select(F.col("kind").alias("query_id"), F.concat_ws("/", "kind", "path").alias("path"), "name", (F.col("span.end_line") / 50).alias("score"), "ordinal")
    return ranking.diverse(rows, 8)


@query()
def ask_packet(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    hits = vectors.top_k(v, v.filter("id = 7").first()["embedding"], 20, 0.2).join(v.select("id", "path"), "id")
    return plans.ask(B.symbols(spark, d), B.brand_files(spark, d), B.brand_relations(spark, d), "where is the small gear ring", "full", hits=hits)


@query()
def export_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return reports.jsonl(file=B.brand_files(spark, d), symbol=B.symbols(spark, d).select("id", "name", "path", "kind"), relation=B.calls(spark, d))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    g = B.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "value")


@query("""WITH g AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 1800000000, true) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    g = B.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), "events")


@query("SELECT p_partkey AS id, p_name AS name, lower(p_type) AS kind, 1 AS start_line, p_size AS end_line, 0 AS depth FROM part WHERE p_brand = 'Brand#7'")
def file_outline(spark: SparkSession, d: str) -> DataFrame:
    return explore.file_outline(B.symbols(spark, d), "Brand#7")


@query("""WITH m AS (SELECT *, CASE WHEN lower(p_type) IN ('struct') THEN 0 ELSE 2 END AS r FROM part WHERE lower(p_name) = 'red bolt'),
b AS (SELECT p_partkey, p_name, p_brand FROM m ORDER BY (p_name = 'red bolt') DESC, p_size - 1 DESC, (p_size > 25) DESC, p_partkey LIMIT 1),
s AS (SELECT 'sibling' AS role, p.p_partkey AS id, p.p_name AS name, p.p_brand AS path FROM part p, b WHERE p.p_brand = b.p_brand AND p.p_partkey <> b.p_partkey ORDER BY (p_size > 25) DESC, p_size DESC, p.p_partkey LIMIT 8),
o AS (SELECT 'other' AS role, p.p_partkey AS id, p.p_name AS name, p.p_brand AS path FROM part p, b WHERE lower(p.p_name) = 'red bolt' AND p.p_brand <> b.p_brand ORDER BY p.p_partkey LIMIT 8)
SELECT 'best' AS role, p_partkey AS id, p_name AS name, p_brand AS path FROM b UNION ALL SELECT * FROM s UNION ALL SELECT * FROM o""")
def explore_symbol(spark: SparkSession, d: str) -> DataFrame:
    return explore.explore_symbol(B.symbols(spark, d), "red bolt", "medium")


@query(f"WITH l AS ({LINES}) SELECT path, string_agg(text, chr(10) ORDER BY line) AS text, count(*) AS lines, true AS cut FROM l WHERE path = 10 AND line BETWEEN 1 AND 3 GROUP BY path")
def symbol_snippet(spark: SparkSession, d: str) -> DataFrame:
    return explore.snippet(B.doc_lines(spark, d), 10, 1, 50, most=3)


@query("SELECT p_partkey AS id, degree FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1) JOIN part ON p_partkey = l_partkey ORDER BY degree DESC, id LIMIT 10")
def key_symbols_by_degree(spark: SparkSession, d: str) -> DataFrame:
    edges = B.calls(spark, d).select((-1 - F.col("source_id")).alias("source"), F.col("target_id").alias("target"))
    return B.symbols(spark, d).select("id").join(graph.degrees(edges), "id").orderBy(F.desc("degree"), "id").limit(10)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), n AS (SELECT t AS seed, count(*) AS entries, CAST(sum(CASE WHEN s % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS test_files FROM e WHERE t < 200 GROUP BY t)
SELECT seed, entries, test_files, CASE WHEN entries > 20 OR test_files > 5 THEN 'HIGH' WHEN entries > 5 OR test_files > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n""")
def blast_radius_risk(spark: SparkSession, d: str) -> DataFrame:
    edges = B.calls(spark, d).select((-1 - F.col("source_id")).alias("source"), F.col("target_id").alias("target"))
    tests = B.table(spark, d, "supplier").filter("s_suppkey % 10 = 0").select((-1 - F.col("s_suppkey")).alias("id"))
    seeds = B.table(spark, d, "part").filter("p_partkey < 200").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("id"))
    return graph.blast_radius(edges, seeds, tests, 3)


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 2 = 0 THEN 'said ' || doc_id END AS purpose, CASE WHEN doc_id % 3 = 0 THEN 'doc' WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'agent' ELSE 'agent-stale' END END AS purpose_source FROM documents""")
def annotation_merge(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("doc_id") % 3 == 0
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"), F.when(own, "own").alias("purpose"), F.when(own, "doc").alias("purpose_source"))
    said = docs.filter("path % 2 = 0").select("path", F.concat(F.lit("said "), F.col("path").cast("string")).alias("purpose"), F.when(F.col("path") % 4 == 0, F.col("hash")).otherwise("old").alias("content_hash"))
    return reports.apply_annotations(docs, said).drop("hash")


@query("SELECT count(*) AS todo FROM documents WHERE doc_id % 4 <> 0")
def vector_stale(spark: SparkSession, d: str) -> DataFrame:
    live = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    stored = live.filter("id % 4 < 2").withColumn("digest", F.when(F.col("id") % 4 == 1, "old").otherwise(F.col("digest")))
    todo, _ = vectors.stale(stored, live)
    return todo.agg(F.count(F.lit(1)).alias("todo"))


@query(f"WITH e AS ({ENTRIES}), t AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(content), '[^\\pL\\pN_]+')) AS term FROM e) SELECT term, count(*) AS entries FROM t WHERE strlen(term) >= 3 AND term NOT IN ({STOPS}) GROUP BY term")
def memory_postings(spark: SparkSession, d: str) -> DataFrame:
    return memory.postings(B.project_memory(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT 'src' || (doc_id // 40) AS id, CAST(sum(n_chars) AS BIGINT) AS raw_bytes FROM documents GROUP BY 1")
def raw_baseline(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.concat(F.lit("src"), F.expr("doc_id div 40").cast("string")).alias("id"))
    results = docs.groupBy("id").agg(F.to_json(F.array_union(F.collect_list(F.struct("path")), F.collect_list(F.struct("path")))).alias("json"))
    return reports.raw_baseline(results, docs.select("path", "size"))


@query("SELECT count(*) AS files, (SELECT count(*) FROM part) AS symbols FROM documents")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return reports.status(B.doc_files(spark, d), B.symbols(spark, d)).select("files", "symbols")


GENERICS = ", ".join(f"'{w}'" for w in reports.GENERIC)


@query(f"""WITH deg AS (SELECT p AS id, count(*) AS degree FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem) GROUP BY p),
ks AS (SELECT p_name, degree FROM part JOIN deg ON deg.id = p_partkey ORDER BY degree DESC, p_partkey LIMIT 10),
w AS (SELECT DISTINCT p_partkey, p_brand, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS word FROM part), g AS (SELECT * FROM w WHERE strlen(word) >= 3 AND word NOT IN ({GENERICS})), k AS (SELECT DISTINCT word FROM g),
t AS (SELECT p_partkey, p_brand, CASE WHEN word LIKE '%s' AND length(word) > 3 AND substr(word, 1, length(word) - 1) IN (SELECT word FROM k) THEN substr(word, 1, length(word) - 1) ELSE word END AS term FROM g WHERE NOT (word LIKE '%s' AND length(word) > 3 AND substr(word, 1, length(word) - 1) IN ({GENERICS}))),
gl AS (SELECT term, count(*) AS n FROM t GROUP BY term HAVING count(*) >= 3 AND count(DISTINCT p_brand) >= 2 ORDER BY count(*) * count(DISTINCT p_brand) DESC, term LIMIT 10)
SELECT 'language' AS section, lang AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY lang
UNION ALL SELECT 'dir', dir, CAST(n AS VARCHAR) FROM (SELECT coalesce(source, '') AS dir, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, dir LIMIT 15)
UNION ALL SELECT 'build', 'architecture', 'flat' UNION ALL SELECT 'style', 'naming', 'unknown' UNION ALL SELECT 'tests', 'no tests', '0'
UNION ALL SELECT 'key symbol', p_name, CAST(degree AS VARCHAR) FROM ks UNION ALL SELECT 'term', term, CAST(n AS VARCHAR) FROM gl""")
def onboard(spark: SparkSession, d: str) -> DataFrame:
    edges = B.calls(spark, d).select((-1 - F.col("source_id")).alias("source"), F.col("target_id").alias("target"))
    return explore.onboard(B.doc_files(spark, d), B.symbols(spark, d), edges)
