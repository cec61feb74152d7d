"""Queries over changes, tests, edges, timelines and reports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import columns as C
from ..functions import stopnames
from ..operators import change, graph, history, memory, reports, search, vectors
from ..plans import explore, index
from .code import ORACLES, QUERIES, query
from .prose import ENTRIES

__all__ = ["ORACLES", "QUERIES"]

#: bindings.project() in SQL: files, symbols and relations.
PROJECT = """n AS (SELECT count(*) AS files FROM supplier), np AS (SELECT count(*) AS parts FROM part),
f AS (SELECT 'f' || s_suppkey AS id, s_suppkey % 5 = 0 AS test, 'm' || (s_suppkey % 7) AS dir, 'm' || (s_suppkey % 7) || CASE WHEN s_suppkey % 5 = 0 THEN '/test_s' ELSE '/s' END || s_suppkey || '.py' AS path, s_suppkey AS k FROM supplier),
s AS (SELECT 'p' || p_partkey AS id, p_partkey AS ordinal, p_name AS name, f.id AS file_id, f.path, f.dir, f.test, p_partkey % 40 * 10 + 1 AS a, p_partkey % 40 * 10 + 1 + p_size % 9 AS b, p_size > 25 AS exported, p_size FROM part, n, f WHERE f.k = p_partkey % n.files),
c AS (SELECT DISTINCT 'p' || l_partkey AS src, 'p' || ((l_partkey * 7 + l_linenumber) % np.parts) AS dst FROM lineitem, np WHERE l_partkey <> (l_partkey * 7 + l_linenumber) % np.parts),
t AS (SELECT f.path AS test, g.path AS path FROM f, n, f g WHERE f.test AND g.k = (f.k + 1) % n.files),
ch AS (SELECT * FROM s WHERE ordinal % 50 = 0)"""


def changed_parts(symbols: DataFrame) -> DataFrame:
    return symbols.filter("ordinal % 50 = 0")


@query(f"""WITH {PROJECT}, r AS (SELECT src AS source, dst AS target FROM c UNION ALL SELECT 'f' || f.k, 'f' || ((f.k + 1) % n.files) FROM f, n WHERE f.test) SELECT source, target FROM r""")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_edges(B.project(spark, d)[2])


@query(f"""WITH {PROJECT}, r AS (SELECT test AS path, 0 AS o FROM t WHERE path IN (SELECT path FROM ch) UNION ALL SELECT s.path, 1 FROM s WHERE s.test AND s.id IN (SELECT src FROM c WHERE dst IN (SELECT id FROM ch))
 UNION ALL SELECT s.path, 2 FROM s WHERE s.test AND s.dir IN (SELECT dir FROM ch)) SELECT path, ['paired', 'calls', 'beside'][min(o) + 1] AS reason FROM r GROUP BY path""")
def smart_tests(spark: SparkSession, d: str) -> DataFrame:
    files, symbols, relations = B.project(spark, d)
    return change.smart_tests(changed_parts(symbols), symbols, relations, files)


UNTESTED = """SELECT id, path FROM ch WHERE NOT test AND path NOT IN (SELECT path FROM t) AND path NOT IN (SELECT path FROM s WHERE test) AND id NOT IN (SELECT dst FROM c WHERE src IN (SELECT id FROM s WHERE test))"""


@query(f"WITH {PROJECT} {UNTESTED}")
def untested_changes(spark: SparkSession, d: str) -> DataFrame:
    files, symbols, relations = B.project(spark, d)
    return change.untested(changed_parts(symbols), symbols, relations, files).select("id", "path")


@query(f"""WITH {PROJECT}, one AS (SELECT DISTINCT src AS test, dst AS id FROM c WHERE src IN (SELECT id FROM s WHERE test) AND dst NOT IN (SELECT id FROM s WHERE test)),
two AS (SELECT DISTINCT one.test, c.dst AS id FROM one JOIN c ON c.src = one.id WHERE c.dst NOT IN (SELECT id FROM s WHERE test)) SELECT test, id, 1 AS hops FROM one UNION ALL SELECT test, id, 2 FROM two WHERE (test, id) NOT IN (SELECT (test, id) FROM one)""")
def test_subjects(spark: SparkSession, d: str) -> DataFrame:
    _, symbols, relations = B.project(spark, d)
    return graph.test_subjects(relations, graph.test_symbols(symbols))


@query(f"WITH {PROJECT} SELECT id, path FROM s WHERE test")
def test_symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.test_symbols(B.project(spark, d)[1]).select("id", "path")


HUNKS = "h AS (SELECT path, min(a) - 3 AS hs, min(a) + 14 AS he FROM s WHERE ordinal % 50 = 0 GROUP BY path), hit AS (SELECT DISTINCT s.* FROM s JOIN h USING (path) WHERE a <= he AND b >= hs)"
#: The walk of the blast radius, level by level, and the companions that never come: no commits are given.
WALK = """e AS (SELECT src AS source, dst AS target FROM c UNION ALL SELECT 'f' || f.k, 'f' || ((f.k + 1) % n.files) FROM f, n WHERE f.test),
l1 AS (SELECT DISTINCT e.source AS id FROM e JOIN hit ON hit.id = e.target), l2 AS (SELECT DISTINCT e.source AS id FROM e JOIN l1 ON l1.id = e.target), l3 AS (SELECT DISTINCT e.source AS id FROM e JOIN l2 ON l2.id = e.target),
w AS (SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3)"""


def hunks_of(symbols: DataFrame) -> DataFrame:
    low = changed_parts(symbols).groupBy("path").agg(F.min("span.start_line").alias("low"))
    return low.select("path", (F.col("low") - 3).alias("start"), (F.col("low") + 14).alias("end"))


@query(f"WITH {PROJECT}, {HUNKS} SELECT id, name, path FROM hit JOIN h USING (path) WHERE exported AND a BETWEEN hs AND he")
def contract_changes(spark: SparkSession, d: str) -> DataFrame:
    symbols = B.project(spark, d)[1]
    hunks = hunks_of(symbols)
    spans = symbols.withColumns({"start": F.col("span.start_line"), "end": F.col("span.end_line")})
    hit = change.overlapping(spans, hunks.select("path", F.col("start").alias("h_start"), F.col("end").alias("h_end"))).select(*symbols.columns).dropDuplicates(["id"])
    return change.contract_changes(hit, hunks)


@query(f"""WITH {PROJECT}, {HUNKS}, {WALK},
ts AS (SELECT test AS path FROM t WHERE path IN (SELECT path FROM hit) UNION SELECT path FROM s WHERE test AND id IN (SELECT src FROM c WHERE dst IN (SELECT id FROM hit)) UNION SELECT path FROM s WHERE test AND dir IN (SELECT dir FROM hit)),
u AS ({UNTESTED.replace("FROM ch", "FROM hit")}),
k AS (SELECT (SELECT count(*) FROM h) AS files, (SELECT count(*) FROM hit) AS changed, (SELECT count(*) FROM hit JOIN h USING (path) WHERE exported AND a BETWEEN hs AND he) AS contracts,
  (SELECT count(*) FROM w WHERE id NOT IN (SELECT id FROM hit)) AS affected, (SELECT count(*) FROM ts) AS tests, (SELECT count(*) FROM u) AS untested, CAST(0 AS BIGINT) AS missing_co_changes),
r AS (SELECT *, CASE WHEN affected > 20 OR tests > 5 THEN 2 WHEN affected > 5 OR tests > 2 THEN 1 ELSE 0 END + (untested > 0)::INT AS level FROM k),
v AS (SELECT * EXCLUDE level, ['LOW', 'MEDIUM', 'HIGH'][least(level, 2) + 1] AS risk FROM r)
SELECT *, untested = 0 AND missing_co_changes = 0 AND risk <> 'HIGH' AS clean, format('{{}} symbols changed in {{}} files, {{}} affected, {{}} tests to run, {{}} without a test; risk {{}}', changed, files, affected, tests, untested, risk) AS summary FROM v""")
def verify_change(spark: SparkSession, d: str) -> DataFrame:
    files, symbols, relations = B.project(spark, d)
    commits = spark.createDataFrame([], "hash string, path string")
    return change.verify_change(hunks_of(symbols), symbols, relations, files, commits)


@query(f"""WITH RECURSIVE {PROJECT}, e AS (SELECT src AS source, dst AS target, 'calls' AS kind FROM c UNION ALL SELECT 'f' || f.k, 'f' || ((f.k + 1) % n.files), 'test_for' FROM f, n WHERE f.test),
l0 AS (SELECT 'p1' AS id), l1 AS (SELECT DISTINCT source AS id FROM e WHERE target IN (SELECT id FROM l0) AND source NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT source AS id FROM e WHERE target IN (SELECT id FROM l1) AND source NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1)) SELECT 'one' AS seed, id, 1 AS depth, 'calls' AS via FROM l1 UNION ALL SELECT 'one', id, 2, 'calls' FROM l2""")
def affected_provenance(spark: SparkSession, d: str) -> DataFrame:
    return change.affected_with_reasons(B.project(spark, d)[2], spark.createDataFrame([("one", "p1")], "seed string, id string"), 2)


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_partkey AS start, l_linenumber % 4 AS m FROM lineitem) SELECT 'src/' || o || '.py' AS path, CAST(greatest(start, 1) AS INTEGER) AS start, CAST(CASE m WHEN 0 THEN start WHEN 1 THEN greatest(start, 1) ELSE start + m - 2 END AS INTEGER) AS end FROM l""")
def unified_diff(spark: SparkSession, d: str) -> DataFrame:
    """A diff for each order, a hunk for each line item: counts left out, 0, 1 and 2."""
    li = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), "l_linenumber", "l_partkey")
    m = F.col("l_linenumber") % 4
    count = F.when(m == 0, "").otherwise(F.concat(F.lit(","), (m - 1).cast("string")))
    hunks = li.select("source", (F.col("l_linenumber") * 10).alias("n"), F.concat(F.lit("@@ -7,2 +"), F.col("l_partkey").cast("string"), count, F.lit(" @@ fn x()")).alias("text"))
    heads = li.select("source", F.lit(1).alias("n"), F.concat(F.lit("+++ b/src/"), F.col("source").cast("string"), F.lit(".py")).alias("text")).distinct()
    noise = hunks.select("source", (F.col("n") + 1).alias("n"), F.lit("+@@ not a head").alias("text"))
    return change.unified_diff(heads.unionByName(hunks).unionByName(noise))


@query("""WITH l AS (SELECT l_orderkey AS id, 's' || (l_suppkey % 3) || CASE WHEN l_linenumber % 2 = 0 THEN '.py' ELSE '.rs' END AS path, CAST(l_suppkey % 4 + 1 AS INTEGER) AS line, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2, 3)
SELECT id, path, line, CAST(row_number() OVER (PARTITION BY id ORDER BY first, path, line) AS INTEGER) AS place FROM l""")
def stack_frames(spark: SparkSession, d: str) -> DataFrame:
    li = B.table(spark, d, "lineitem")
    base, line = F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")), (F.col("l_suppkey") % 4 + 1).cast("string")
    frame = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('  File "'), base, F.lit('.py", line '), line)).otherwise(F.concat(F.lit("   at call ("), base, F.lit(".rs:"), line, F.lit(")")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", frame.alias("f")))), lambda x: x["f"])
    traces = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(lines, "\n").alias("text"))
    return change.stack_frames(traces, "id", "text").select("id", "path", "line", "place")


@query("SELECT l_orderkey AS id, l_linenumber AS place, 1 - least((l_linenumber - 1) * 0.05::DOUBLE, 0.5::DOUBLE) AS weight FROM lineitem")
def frame_weights(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), change.frame_weight(F.col("l_linenumber")).alias("weight"))


@query("""SELECT 't' || s_suppkey AS source_id, 'f' || s_suppkey AS target_id, 'test_for' AS kind, CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END::FLOAT AS weight FROM supplier""")
def test_edges(spark: SparkSession, d: str) -> DataFrame:
    """A test for each supplier's file: beside it, a folder down, or in another folder."""
    k = F.col("s_suppkey").cast("string")
    folder = F.when(F.col("s_suppkey") % 3 == 0, "src/").when(F.col("s_suppkey") % 3 == 1, "src/tests/").otherwise("other/")
    s = B.table(spark, d, "supplier")
    tests = s.select(F.concat(F.lit("t"), k).alias("id"), F.concat(folder, F.lit("test_s"), k, F.lit("_py.py")).alias("path"))
    return index.test_edges(tests.unionByName(s.select(F.concat(F.lit("f"), k).alias("id"), F.concat(F.lit("src/s"), k, F.lit("_py.py")).alias("path"))))


@query("SELECT 'c' || (a.s_suppkey % 4) AS source_id, 'f' || a.s_suppkey AS target_id, 'config_for' AS kind, 0.5::FLOAT AS weight FROM supplier a")
def config_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = B.table(spark, d, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("d"), (k % 4).cast("string"), F.lit("/s"), k.cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"))
    config = spark.range(4).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/settings.toml")).alias("path"), F.lit("toml").alias("language"))
    return index.config_edges(code.unionByName(config))


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS path, p_name AS name FROM part), one AS (SELECT path, name, min(id) AS id FROM s GROUP BY 1, 2 HAVING count(*) = 1), two AS (SELECT name, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1),
k AS (SELECT p_partkey AS caller, p_brand AS path, 'small ' || p_name AS callee, p_partkey % 2 = 0 AS method FROM part UNION ALL SELECT p_partkey, p_brand, p_name, p_partkey % 2 = 0 FROM part UNION ALL SELECT p_partkey, 'Brand#1', p_name, false FROM part)
SELECT DISTINCT caller AS source_id, CASE WHEN method THEN two.id ELSE coalesce(one.id, two.id) END AS target_id FROM k LEFT JOIN one ON one.path = k.path AND one.name = callee LEFT JOIN two ON two.name = callee WHERE CASE WHEN method THEN two.id ELSE coalesce(one.id, two.id) END <> caller""")
def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    symbols = B.symbols(spark, d).withColumn("kind", F.lit("function"))
    base = symbols.select("path", F.col("id").alias("caller_id"), F.col("name").alias("callee"), (F.col("id") % 2 == 0).alias("is_method"))
    calls = base.unionByName(base.withColumn("callee", F.concat(F.lit("small "), "callee"))).unionByName(base.withColumns({"path": F.lit("Brand#1"), "is_method": F.lit(False)}))
    return graph.resolve_calls(calls, symbols).select("source_id", "target_id")


@query("SELECT p_partkey AS id, NOT (p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_partkey % 3 = 1)) AS kept FROM part WHERE NOT (p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_partkey % 3 = 1))")
def stop_names(spark: SparkSession, d: str) -> DataFrame:
    """Callees by number: one stopped in all languages, one in the unknown ones and Rust alone, one never."""
    name = F.element_at(F.array(F.lit("len"), F.lit("append"), F.lit("unwrap"), F.lit("own_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 3 == 1, "a.rs").otherwise("a.py")
    calls = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("callee"), path.alias("path"))
    return graph.not_stopped(calls, stopnames.stop_table(spark)).select("id", F.lit(True).alias("kept"))


@query("SELECT 'workspace' AS architecture")
def architecture(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("packages/"), "p_name")).otherwise(F.concat(F.lit("src/"), "p_name"))
    return reports.architecture(B.table(spark, d, "part").select(path.alias("path")))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 4 AS mt, least(l_linenumber % 4, l_partkey % 4) AS mf, l_suppkey % 3 AS st, least(l_suppkey % 3, l_partkey % 2) AS sf, l_partkey % 6 AS sel, l_suppkey % 2 AS irr, l_partkey % 2 = 0 AS fw, l_suppkey % 2 = 0 AS bw FROM lineitem)
SELECT id, round(50 * CASE WHEN mt > 0 THEN mf / mt ELSE 1.0 END + 15 * CASE WHEN st > 0 THEN sf / st ELSE 1.0 END + 20 * least(CASE WHEN sel > 0 THEN (mf + sf) / sel ELSE 0.0 END, 1.0) - 10 * irr - CASE WHEN fw THEN 0 ELSE 3 END - CASE WHEN bw THEN 0 ELSE 2 END, 3)::DOUBLE AS score FROM r""")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = B.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), (n % 4).alias("must_include_total"), F.least(n % 4, p % 4).alias("must_include_found"), (s % 3).alias("should_include_total"), F.least(s % 3, p % 2).alias("should_include_found"),
        (p % 6).alias("selected_files"), (s % 2).alias("irrelevant_found"), (p % 2 == 0).alias("files_within_limit"), (s % 2 == 0).alias("bytes_within_limit"),
    )
    return reports.case_scores(rows)


@query("SELECT n_nationkey AS id, r_regionkey AS other, ends_with('a/' || n_name, r_name) OR ends_with(r_name, 'a/' || n_name) OR ends_with(n_name, 'A') AS overlap FROM nation, region WHERE n_regionkey = r_regionkey")
def overlapping_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    either = C.paths_overlap(F.concat(F.lit("a/"), "n_name"), F.col("r_name")) | C.paths_overlap(F.col("n_name"), F.lit("A"))
    return rows.select(F.col("n_nationkey").alias("id"), F.col("r_regionkey").alias("other"), either.alias("overlap"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS p FROM lineitem), g AS (SELECT p, count(*) AS churn FROM f GROUP BY p), m AS (SELECT CAST(sum(churn) AS BIGINT) // count(*) AS mean FROM g),
o AS (SELECT o_orderkey AS h, o_orderdate AS ts, o_orderpriority AS text FROM orders WHERE o_orderkey IN (SELECT h FROM f WHERE p = 3)), b AS (SELECT arg_min(h, (ts, h)) AS first, max(ts) AS last FROM o)
SELECT ts::DATE AS day, CASE WHEN h = first THEN 'introduced' ELSE 'commit' END AS event, text FROM o, b UNION ALL SELECT last::DATE, 'high churn', churn || ' commits' FROM g, m, b WHERE p = 3 AND churn > 2 * mean
UNION ALL SELECT DATE '2000-01-01' + CAST(n_nationkey AS INTEGER), 'decision', n_name FROM nation WHERE n_nationkey % 5 = 3 OR n_nationkey = 7""")
def change_timeline(spark: SparkSession, d: str) -> DataFrame:
    commits = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("message"))
    files = B.commit_files(spark, d).withColumn("path", F.col("path").cast("string"))
    n = F.col("n_nationkey")
    said = B.table(spark, d, "nation").select(F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")).cast("timestamp").alias("ts"), F.col("n_name").alias("text"), F.array(F.when(n == 7, "3").otherwise("zz")).alias("anchors"), (n % 5).cast("string").alias("path"))
    return history.timeline(commits, files, said, "3").select(F.to_date("ts").alias("day"), "event", "text")


@query("""WITH o AS (SELECT o_orderkey AS hash, o_orderdate AS ts FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5)), b AS (SELECT arg_min(hash, (ts, hash)) AS first FROM o) SELECT hash, hash = first AS introduced FROM o, b ORDER BY ts DESC, hash LIMIT 10""")
def file_history(spark: SparkSession, d: str) -> DataFrame:
    commits = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("author"), F.col("o_orderstatus").alias("message"))
    files = B.commit_files(spark, d).withColumn("status", F.lit("A"))
    return history.file_history(commits, files, 5, 10).select("hash", "introduced")


@query("SELECT DISTINCT l_orderkey AS hash, o_orderdate::DATE AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = 2 AND l_linenumber <= 3 AND l_linenumber + 2 >= 3 ORDER BY day DESC, hash LIMIT 20")
def symbol_history(spark: SparkSession, d: str) -> DataFrame:
    commits = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"))
    hunks = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"))
    return history.symbol_history(commits, hunks, 2, 3, 3, 20).select("hash", F.to_date("ts").alias("day"))


@query(f"""WITH e AS ({ENTRIES}), h AS (SELECT *, (contains(lower(content), 'thent'))::INT + (contains(tag, 'thent'))::INT AS hits FROM e WHERE status = 'active'),
k AS (SELECT id, content, round(hits / 1 + CASE WHEN kind = 'warning' THEN 0.15 WHEN kind = 'decision' THEN 0.1 ELSE 0 END + CASE WHEN pinned THEN 0.2 ELSE 0 END + CASE WHEN file = 'src3' THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score FROM h WHERE hits > 0 OR file = 'src3' ORDER BY score DESC, id LIMIT 30)
SELECT id, CASE WHEN score >= 0.45 OR length(content) <= 160 THEN content ELSE substr(content, 1, 160) || '...' END AS content FROM k""")
def shaped_memories(spark: SparkSession, d: str) -> DataFrame:
    return memory.shaped(memory.search(B.project_memory(spark, d), "thent", 30, files=["src3"])).select("id", "content")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN (SELECT count(*) FROM part) > 7 THEN 'showing 7 of ' || (SELECT count(*) FROM part) END AS note FROM part ORDER BY p_size DESC, p_partkey LIMIT 7")
def capped_list(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return reports.capped(rows, 7, F.desc("p_size"), "id").select("id", "name", "note")


@query("SELECT 'file' AS type, count(DISTINCT p_brand) AS rows FROM part UNION ALL SELECT 'symbol', count(*) FROM part UNION ALL SELECT 'relation', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem")
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.export_counts(file=B.brand_files(spark, d), symbol=B.symbols(spark, d), relation=B.calls(spark, d))


@query("SELECT 'symbol' AS type, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL SELECT 'file', p_brand, NULL FROM (SELECT DISTINCT p_brand FROM part)")
def export_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = reports.jsonl(file=B.brand_files(spark, d), symbol=B.symbols(spark, d).select("id", "name", "path", "kind"))
    return lines.select(*[F.get_json_object("line", f"$.{c}").alias(c) for c in ("type", "id", "name")])


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 3 AS a, p_size % 12 AS b, p_partkey % 4 AS c FROM part) SELECT id, CASE WHEN id % 10 = 0 THEN false ELSE (a, b, c) > (1, 9, 2) END AS newer FROM v""")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    id_, part = F.col("p_partkey"), lambda c: c.cast("string")
    tag = F.when(id_ % 10 == 0, "latest").otherwise(F.concat(F.lit("v"), part(id_ % 3), F.lit("."), part(F.col("p_size") % 12), F.lit("."), part(id_ % 4), F.when(id_ % 7 == 0, "-rc1").otherwise("")))
    return B.table(spark, d, "part").select(id_.alias("id"), C.is_newer(tag, F.lit("1.9.2")).alias("newer"))


@query("""WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT 'x/' || p_name || p_partkey AS path, CAST(coalesce(n, 0) AS BIGINT) AS score FROM part LEFT JOIN g ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0 ORDER BY score DESC, path LIMIT 15""")
def annotation_queue(spark: SparkSession, d: str) -> DataFrame:
    files = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("x/"), "p_name", F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 3 == 0, "said").alias("purpose"))
    return reports.annotation_queue(files, B.calls(spark, d).withColumn("kind", F.lit("imports")), 15)


@query("SELECT 'd' || s_suppkey AS path, CASE WHEN s_suppkey = 3 THEN 'new words' ELSE 'said' END AS purpose, CASE WHEN s_suppkey = 3 THEN 2 ELSE 1 END AS terms FROM supplier")
def annotation_upsert(spark: SparkSession, d: str) -> DataFrame:
    known = B.table(spark, d, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("said").alias("purpose"), F.create_map(F.lit("a"), F.lit("b")).alias("terms"), F.lit("h").alias("content_hash"), F.lit("t").alias("annotated_at"))
    return reports.upsert_annotation(known, "d3", "new words", "h2", "t2", {"c": "d"}).select("path", "purpose", F.size("terms").alias("terms"))


@query("""WITH r AS (SELECT p_partkey AS id, p_name, p_brand, row_number() OVER (PARTITION BY lower(p_name) ORDER BY (p_name = lower(p_name)) DESC, p_size - 1 DESC, (p_size > 25) DESC, p_partkey) AS place FROM part) SELECT lower(p_name) AS wanted, id FROM r WHERE place = 1""")
def best_definitions(spark: SparkSession, d: str) -> DataFrame:
    symbols = B.symbols(spark, d).withColumn("kind", F.lit("function"))
    return search.best_definition(symbols, symbols.select(F.col("name_lower").alias("wanted")).distinct()).select("wanted", "id")


@query("SELECT p_brand AS path, p_partkey AS id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_partkey) AS INTEGER) AS place FROM part) WHERE place <= 4")
def key_symbols(spark: SparkSession, d: str) -> DataFrame:
    return search.key_symbols(B.symbols(spark, d), 4).select("path", "id", "place")


@query("SELECT p_partkey AS id FROM part WHERE starts_with(p_brand, 'Brand#1')")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.in_scope(B.symbols(spark, d), "Brand#1").select("id")


EXTENSIONS = ("rs", "ts", "JSX", "py", "go", "java", "cs", "kts", "hpp", "md", "xyz", "")


@query(f"""SELECT p_partkey AS id, [{", ".join(repr(e) for e in EXTENSIONS)}][p_partkey % 12 + 1] AS ext, ['rust', 'typescript', 'javascript', 'python', 'go', 'java', 'csharp', 'kotlin', 'cpp', 'markdown', 'unknown', 'unknown'][p_partkey % 12 + 1] AS language FROM part""")
def language_of_path(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    path = F.concat(F.lit("a.b/c"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.extension(path).alias("ext"), C.language_of(path).alias("language"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x * 3.0::DOUBLE) * (x * 3.0::DOUBLE)))), 3) > 0 AS unit FROM embeddings")
def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d).select("id", C.l2_normalised(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return v.select("id", (F.abs(C.dot(F.col("v"), F.col("v")) - 1) < 1e-4).alias("unit"))


@query("SELECT count(*) AS live, sum((doc_id % 4 <> 0)::INT)::BIGINT AS to_embed, CAST(0 AS BIGINT) AS to_drop, sum((doc_id % 4 = 0)::INT)::BIGINT AS current, false AS compact FROM documents")
def vector_status(spark: SparkSession, d: str) -> DataFrame:
    live = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    stored = live.filter("id % 4 < 2").withColumn("digest", F.when(F.col("id") % 4 == 1, "old").otherwise(F.col("digest")))
    return vectors.coverage(stored, live)


@query("SELECT p_partkey AS id, 64 AS size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def vector_sync(spark: SparkSession, d: str) -> DataFrame:
    """A store of the odd ones, brought up to those divisible by 2 or 3, by an embedder that needs no model."""
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.sha2("p_name", 256).alias("digest"))
    store = vectors.embedded(rows.filter("id % 2 = 1"), vectors.HashingEmbedder())
    return vectors.synced(store, rows.filter("id % 2 = 0 or id % 3 = 0"), vectors.HashingEmbedder()).select("id", F.size("embedding").alias("size"))


@query("SELECT count(*) FILTER (WHERE s_suppkey % 5 = 0) AS tests, CASE WHEN count(*) FILTER (WHERE s_suppkey % 5 = 0) = 0 THEN 'no tests' ELSE 'beside the code' END AS pattern FROM supplier")
def test_layout(spark: SparkSession, d: str) -> DataFrame:
    return explore.test_pattern(B.project(spark, d)[0])


#: Two words of part names and one each: a hundred questions.
FIRST, SECOND = ("red", "small", "hot", "blue", "steel", "anvil", "gear", "ring", "bolt", "plate"), ("bolt", "gear", "ring", "widget", "anvil", "pin", "plate", "valve", "rod", "cap")


@query()
def symbol_search_batch(spark: SparkSession, d: str) -> DataFrame:
    """A hundred questions against the symbols in one job: one small file, dealt to all cores and written once with its search columns."""
    symbols = graph.cut(B.symbols(spark, d).repartition(spark.sparkContext.defaultParallelism))
    return search.batch(symbols, [f"{a} {b}" if a != b else a for a in FIRST for b in SECOND], 12)
