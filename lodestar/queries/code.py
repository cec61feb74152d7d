"""Queries over names, files, graphs and history, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import columns as C
from ..functions.text import expand
from ..operators import change, graph, history, reports, search

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS = "regexp_split_to_array(lower(p_name), '[^a-z0-9]+')"
#: Fixed in SQL: the tiers of one token in a name, as columns.single_score() has them without stems and synonyms.
TIERS = """CASE WHEN n = '{q}' THEN 1.0 WHEN starts_with(n, '{q}') THEN 0.9 WHEN contains(n, '{q}') THEN 0.4 + CAST(strlen('{q}') AS DOUBLE) / strlen(n) * 0.4
  WHEN regexp_matches(n, '{fuzzy}') THEN 0.2 + CAST(strlen('{q}') AS DOUBLE) / strlen(n) * 0.2 ELSE 0.0 END"""


def tiers(q: str) -> str:
    return TIERS.format(q=q, fuzzy=".*".join(q))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = 'red bolt' ORDER BY p_partkey LIMIT 1")
def lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.get_symbol(B.symbols(spark, d), "Red Bolt").select("id", "name")


@query(f"WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part) SELECT id, round({tiers('gizm')}, 6) AS score FROM s WHERE {tiers('gizm')} > 0")
def lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = search.scored(B.symbols(spark, d), expand("gizm"))
    return rows.select("id", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part) SELECT id, round({tiers('rdot')}, 6) AS score FROM s WHERE {tiers('rdot')} > 0")
def lookup_fuzzy_subsequence(spark: SparkSession, d: str) -> DataFrame:
    return search.scored(B.symbols(spark, d), expand("rdot")).select("id", F.round("score", 6).alias("score"))


@query(f"WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part) SELECT id, round({tiers('gear')}, 6) AS score FROM s WHERE {tiers('gear')} > 0 ORDER BY {tiers('gear')} DESC, id LIMIT 12")
def symbol_score_single(spark: SparkSession, d: str) -> DataFrame:
    return search.find_symbol(B.symbols(spark, d), "gear", 12).select("id", F.round("score", 6).alias("score"))


MULTI = """WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n, p_brand FROM part),
v AS (SELECT id, n, p_brand, CASE WHEN n IN ('small gear ring', 'small_gear_ring', 'smallgearring') THEN 0.98 WHEN contains(n, 'small gear ring') THEN 0.95 ELSE 0 END AS phrase,
  CASE WHEN contains(n, 'small') THEN 1.0 WHEN contains(n, 'tiny') OR contains(n, 'little') THEN 0.72 ELSE 0.0 END AS a,
  CASE WHEN contains(n, 'gear') THEN 1.0 ELSE 0.0 END AS b, CASE WHEN contains(n, 'ring') THEN 1.0 ELSE 0.0 END AS c FROM s),
m AS (SELECT * FROM v WHERE a <> 0 OR b <> 0 OR c <> 0),
w AS (SELECT ln(1 + CAST(count(*) AS DOUBLE) / (1 + sum((a <> 0)::INT))) AS wa, ln(1 + CAST(count(*) AS DOUBLE) / (1 + sum((b <> 0)::INT))) AS wb, ln(1 + CAST(count(*) AS DOUBLE) / (1 + sum((c <> 0)::INT))) AS wc FROM m),
x AS (SELECT id, (a * wa + b * wb + c * wc) / (wa + wb + wc) AS ratio, (0.04 * len(list_filter(string_split(n, ' '), lambda t: contains(t, 'small') OR contains(t, 'gear') OR contains(t, 'ring'))) / len(string_split(n, ' ')))
  + CASE WHEN contains(n, 'smallgear') OR contains(n, 'small_gear') OR contains(n, 'gearring') OR contains(n, 'gear_ring') THEN 0.03 ELSE 0 END AS bonus FROM m, w)
SELECT id, round(least(ratio * 0.9 + bonus, 0.94), 6) AS score FROM x"""


@query(MULTI)
def symbol_score_multi_idf(spark: SparkSession, d: str) -> DataFrame:
    return search.multi_scored(B.symbols(spark, d), expand("small gear ring")).select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'blue bolt' THEN 0.98::DOUBLE ELSE 0.95::DOUBLE END AS score FROM part WHERE contains(lower(p_name), 'blue bolt')")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    rows = B.symbols(spark, d).withColumn("score", C.phrase_score(expand("blue bolt"), F.col("name_lower"), F.col("sig_lower")))
    return rows.filter("score > 0").select("id", F.col("score"))


@query(f"""WITH s AS (SELECT p_partkey AS id, lower(p_name) AS n, p_name, p_brand FROM part),
v AS (SELECT *, {tiers('anvil')} AS score FROM s), b AS (SELECT p_brand, max(score) AS best FROM v WHERE score > 0 GROUP BY p_brand)
SELECT p_brand AS path, round(best * 0.8, 6) AS score FROM b ORDER BY best DESC, p_brand LIMIT 12""")
def file_search_best_symbol(spark: SparkSession, d: str) -> DataFrame:
    return search.find_files(B.brand_files(spark, d), B.symbols(spark, d), "anvil", 12).select("path", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT page_id, lower(url) AS u FROM pages),
v AS (SELECT page_id, ((CASE WHEN contains(u, 'blog') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(u, 'page') THEN 1.0 ELSE 0 END)) / 2 AS score FROM p)
SELECT page_id, CAST(score AS DOUBLE) AS score FROM v WHERE score > 0""")
def path_score(spark: SparkSession, d: str) -> DataFrame:
    score = C.path_score(expand("blog page"), F.lower("url"))
    return B.table(spark, d, "pages").select("page_id", score.alias("score")).filter("score > 0")


@query("SELECT c_custkey AS id, list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM customer")
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.identifier_words(F.col("c_name")).alias("words"))


@query("""WITH w AS (SELECT DISTINCT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
k AS (SELECT DISTINCT word FROM w),
t AS (SELECT p_partkey, p_brand, CASE WHEN word LIKE '%s' AND length(word) > 3 AND substr(word, 1, length(word) - 1) IN (SELECT word FROM k) THEN substr(word, 1, length(word) - 1) ELSE word END AS term FROM w WHERE strlen(word) >= 3)
SELECT term, count(*) AS symbols, count(DISTINCT p_brand) AS files FROM t GROUP BY term HAVING count(*) >= 3 AND count(DISTINCT p_brand) >= 2 ORDER BY count(*) * count(DISTINCT p_brand) DESC, term LIMIT 15""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    return reports.glossary(B.symbols(spark, d), 15, generic=("zzz",)).select("term", "symbols", "files")


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.language_histogram(B.doc_files(spark, d))


@query("SELECT coalesce(source, '') AS dir, count(*) AS files FROM documents GROUP BY 1 ORDER BY files DESC, dir LIMIT 16")
def top_dirs(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_dirs(B.doc_files(spark, d), 16)


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang ORDER BY files DESC, language LIMIT 1")
def primary_language(spark: SparkSession, d: str) -> DataFrame:
    return reports.primary_language(B.doc_files(spark, d), ("en", "de", "fr", "es"))


@query("""SELECT 'language' AS section, lang AS key, count(*) AS files FROM documents GROUP BY lang
UNION ALL (SELECT 'dir', coalesce(source, ''), count(*) AS files FROM documents GROUP BY 2 ORDER BY files DESC, 2 LIMIT 10)""")
def repo_outline(spark: SparkSession, d: str) -> DataFrame:
    return reports.outline(B.doc_files(spark, d), 5)


@query("""WITH c AS (SELECT sum((contains(c_name, '_') AND c_name = lower(c_name))::INT) AS s, sum((regexp_matches(c_name, '^[a-z]') AND regexp_matches(c_name, '[A-Z]'))::INT) AS m, sum((regexp_matches(c_name, '^[A-Z]'))::INT) AS p FROM customer)
SELECT CASE WHEN s + m + p = 0 THEN 'unknown' ELSE concat_ws(', ', CASE WHEN s > (s + m + p) // 4 THEN 'snake_case (' || (s * 100 // (s + m + p)) || '%)' END, CASE WHEN m > (s + m + p) // 4 THEN 'camelCase (' || (m * 100 // (s + m + p)) || '%)' END, CASE WHEN p > (s + m + p) // 4 THEN 'PascalCase (' || (p * 100 // (s + m + p)) || '%)' END) END AS naming FROM c""")
def naming_style(spark: SparkSession, d: str) -> DataFrame:
    return reports.naming_style(B.table(spark, d, "customer").select(F.col("c_name").alias("name")))


@query("SELECT p_name AS name, p_brand AS path, p_size AS lines, CAST(NULL AS BIGINT) AS churn, CAST(p_size AS DOUBLE) AS score FROM part ORDER BY score DESC, path, name LIMIT 20")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    rows = B.symbols(spark, d).select("name", "path", F.col("span.end_line").alias("lines"))
    return reports.hotspots(rows, None, 20)


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1)
SELECT p_name AS name, p_partkey AS path, p_size AS lines, churn, CAST(p_size * coalesce(churn, 1) AS DOUBLE) AS score FROM part LEFT JOIN c ON p_partkey = l_partkey ORDER BY score DESC, path, name LIMIT 20""")
def hotspots_churn(spark: SparkSession, d: str) -> DataFrame:
    rows = B.symbols(spark, d).select("name", F.col("id").alias("path"), F.col("span.end_line").alias("lines"))
    return reports.hotspots(rows, history.commit_counts(B.commit_files(spark, d)), 20)


@query("SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1")
def churn_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.commit_counts(B.commit_files(spark, d))


@query("""WITH c AS (SELECT l_suppkey AS path, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1), m AS (SELECT CAST(sum(churn) AS BIGINT) // count(*) AS mean FROM c)
SELECT path, churn, mean FROM c, m WHERE churn > mean""")
def high_churn(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("hash"))
    return history.high_churn(history.commit_counts(rows), 1)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS p FROM lineitem), s AS (SELECT h FROM f GROUP BY h HAVING count(*) <= 50), o AS (SELECT f.* FROM f JOIN s USING (h))
SELECT x.p AS a, y.p AS b, count(*) AS together FROM o x JOIN o y ON x.h = y.h AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    return history.co_change_pairs(B.commit_files(spark, d))


MISSING = """WITH f AS (SELECT DISTINCT l_orderkey AS h, l_suppkey AS p FROM lineitem), s AS (SELECT h FROM f GROUP BY h HAVING count(*) <= 50), o AS (SELECT f.* FROM f JOIN s USING (h)),
n AS (SELECT p, count(*) AS own FROM o GROUP BY p), t AS (SELECT count(DISTINCT h) AS commits FROM o),
c AS (SELECT s_suppkey AS p FROM supplier WHERE s_suppkey <= 5),
r AS (SELECT x.p AS path, y.p AS partner, count(*) AS cnt FROM o x JOIN o y ON x.h = y.h AND x.p <> y.p WHERE x.p IN (SELECT p FROM c) GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT r.*, cnt / own AS confidence, row_number() OVER (PARTITION BY path ORDER BY cnt DESC, partner) AS place FROM r JOIN n ON n.p = r.path
  WHERE own >= 3 AND cnt / own >= 0.03 AND partner NOT IN (SELECT p FROM c) AND partner NOT IN (SELECT p FROM n, t WHERE commits >= 20 AND own > commits * 0.3))
SELECT partner AS file, path AS co_changed_with, cnt AS count, round(confidence, 2) AS confidence FROM k WHERE place <= 5"""


@query(MISSING)
def missing_co_changes(spark: SparkSession, d: str) -> DataFrame:
    files = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_suppkey").alias("path"))
    changed = B.table(spark, d, "supplier").filter("s_suppkey <= 5").select(F.col("s_suppkey").alias("path"))
    return history.missing_co_changes(files, changed, least_confidence=0.03)


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem), i AS (SELECT t AS path, count(*) AS fan_in FROM e GROUP BY t), o AS (SELECT s AS path, count(*) AS fan_out FROM e GROUP BY s),
f AS (SELECT DISTINCT l_orderkey AS h, 'p' || l_partkey AS p FROM lineitem), m AS (SELECT h FROM f GROUP BY h HAVING count(*) <= 50), q AS (SELECT f.* FROM f JOIN m USING (h)),
k AS (SELECT x.p AS a, y.p AS b FROM q x JOIN q y ON x.h = y.h AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2), n AS (SELECT path, count(*) AS co FROM (SELECT a AS path FROM k UNION ALL SELECT b FROM k) GROUP BY path)
SELECT path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(co, 0) AS co_change_count, round(coalesce(fan_in, 0) * 0.4::DOUBLE + coalesce(fan_out, 0) * 0.3::DOUBLE + coalesce(co, 0) * 0.3::DOUBLE, 6) AS risk_score FROM i FULL JOIN o USING (path) LEFT JOIN n USING (path)""")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    e = B.calls(spark, d).select(F.concat(F.lit("s"), "source_id").alias("source"), F.concat(F.lit("p"), "target_id").alias("target"))
    commits = B.commit_files(spark, d).withColumn("path", F.concat(F.lit("p"), "path"))
    together = history.partners(history.co_change_pairs(commits)).groupBy("path").agg(F.count(F.lit(1)).alias("partners"))
    return graph.coupling(e, together)


@query("SELECT DISTINCT s_suppkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE lower(p_name) = 'hot gear'")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(*call_graph(spark, d), "hot gear").select("id")


def call_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers under their number and parts under -1 minus theirs, as symbols, and the calls between them."""
    parts = B.symbols(spark, d).select((-1 - F.col("id")).alias("id"), "name")
    both = parts.unionByName(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return both, B.calls(spark, d).withColumn("target_id", -1 - F.col("target_id"))


@query("SELECT DISTINCT p_partkey AS id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = 3")
def callees(spark: SparkSession, d: str) -> DataFrame:
    found = graph.callees(*call_graph(spark, d), "Supplier#000000003")
    return found.select((-1 - F.col("id")).alias("id"), "name")


@query("SELECT p_name AS name, p_brand AS path, min(p_partkey) AS id FROM part GROUP BY 1, 2 HAVING count(*) = 1")
def unique_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    return graph.unique_by(B.symbols(spark, d), "name", "path")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), b AS (SELECT t FROM e GROUP BY t HAVING count(DISTINCT s) > 25) SELECT s AS source_id, t AS target_id FROM e WHERE t NOT IN (SELECT t FROM b)""")
def frequency_cutoff(spark: SparkSession, d: str) -> DataFrame:
    both, calls = call_graph(spark, d)
    kept, _ = graph.without_noise(calls, both.select("id", F.concat(F.lit("f"), "id").alias("path")), 25)
    return kept.select("source_id", (-1 - F.col("target_id")).alias("target_id"))


TREE = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS t FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
w AS (SELECT {seed} AS seed, {id} AS id, 0 AS depth FROM {source} UNION ALL SELECT w.seed, e.s, w.depth + 1 FROM w JOIN e ON e.t = w.id WHERE w.depth < 3)
SELECT seed, id, min(depth) AS depth FROM w GROUP BY seed, id HAVING min(depth) > 0"""


@query(TREE.format(seed="'asia'", id="'r2'", source="(SELECT 1)"))
def affected_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.affected(B.tree(spark, d), spark.createDataFrame([("asia", "r2")], "seed string, id string"))


@query(TREE.format(seed="'n' || n_nationkey", id="'n' || n_nationkey", source="nation"))
def affected_multi_seed(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return graph.affected(B.tree(spark, d), B.table(spark, d, "nation").select(key.alias("seed"), key.alias("id")))


@query("""WITH n AS (SELECT DISTINCT p_brand, lower(p_name) AS w FROM part), t AS (SELECT w FROM n WHERE p_brand = 'Brand#3'), k AS (SELECT count(*) AS k FROM t),
s AS (SELECT p_brand, count(*) AS shared FROM n WHERE w IN (SELECT w FROM t) GROUP BY 1), f AS (SELECT DISTINCT p_brand FROM part),
r AS (SELECT DISTINCT p_brand AS a, 'Brand#' || (p_partkey % 25 + 1) AS b, CASE p_size % 3 WHEN 0 THEN 'imports' WHEN 1 THEN 'test_for' ELSE 'config_for' END AS kind FROM part WHERE p_brand <> 'Brand#' || (p_partkey % 25 + 1)),
g AS (SELECT brand, sum(w) AS edges FROM (SELECT b AS brand, CASE kind WHEN 'imports' THEN 0.7 WHEN 'test_for' THEN 0.8 ELSE 0.4 END AS w FROM r WHERE a = 'Brand#3' UNION ALL SELECT a, CASE kind WHEN 'imports' THEN 0.6 WHEN 'test_for' THEN 0.8 ELSE 0.4 END FROM r WHERE b = 'Brand#3') GROUP BY brand),
v AS (SELECT f.p_brand AS path, coalesce(edges, 0)::DOUBLE + least(coalesce(shared, 0)::DOUBLE / greatest(k, 1), 1.0) * 0.3 + CASE WHEN contains(lower(f.p_brand), 'brand#3') OR contains('brand#3', lower(f.p_brand)) THEN 0.1 ELSE 0 END + 0.05 AS score FROM f LEFT JOIN s ON s.p_brand = f.p_brand LEFT JOIN g ON g.brand = f.p_brand, k WHERE f.p_brand <> 'Brand#3')
SELECT path, round(score, 6) AS score FROM v WHERE round(score, 6) > 0.05 ORDER BY round(score, 6) DESC, path LIMIT 12""")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    return search.find_related(B.brand_files(spark, d), B.symbols(spark, d), B.brand_relations(spark, d), "Brand#3", 12)


HUNKS = "SELECT l_orderkey AS path, min(l_linenumber) AS h_start, max(l_linenumber) AS h_end FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


@query(f"WITH h AS ({HUNKS}), s AS (SELECT l_orderkey AS path, l_partkey AS id, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1, 2) SELECT DISTINCT s.path, s.id FROM s JOIN h USING (path) WHERE a <= h_end AND b >= h_start")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    li = B.table(spark, d, "lineitem")
    hunks = li.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_linenumber").alias("h_start"), F.max("l_linenumber").alias("h_end"))
    spans = li.groupBy(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").alias("start"), F.max("l_linenumber").alias("end"))
    return change.overlapping(spans, hunks).select("path", "id").distinct()


@query("""WITH s AS (SELECT l_suppkey AS path, l_orderkey AS id, CAST(epoch(min(l_shipdate)) // 86400 AS BIGINT) AS a, CAST(epoch(max(l_shipdate)) // 86400 + 30 AS BIGINT) AS b FROM lineitem GROUP BY 1, 2),
p AS (SELECT DISTINCT l_suppkey AS path, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS line FROM lineitem WHERE l_quantity > 40),
k AS (SELECT p.path, line, id, row_number() OVER (PARTITION BY p.path, line ORDER BY b - a, a DESC, id) AS place FROM p JOIN s ON p.path = s.path AND a <= line AND b >= line) SELECT path, line, id FROM k WHERE place = 1""")
def innermost_span(spark: SparkSession, d: str) -> DataFrame:
    li = B.table(spark, d, "lineitem").withColumn("day", F.unix_date(F.to_date("l_shipdate")).cast("long"))
    spans = li.groupBy(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("id")).agg(F.min("day").alias("start"), (F.max("day") + 30).alias("end"))
    points = li.filter("l_quantity > 40").select(F.col("l_suppkey").alias("path"), F.col("day").alias("line")).distinct()
    return change.innermost(spans, points).select("path", "line", "id")


@query("SELECT page_id, regexp_matches(lower(url), '/(tests|test|__tests__|spec|specs|testdata)/') OR regexp_matches(url, '[.](test|spec)[.]') AS is_test, CASE WHEN regexp_matches(lower(url), '[.]html$') THEN 'html' ELSE '' END AS ext FROM pages")
def test_path_flags(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(C.extension(F.col("url")) == "html", "html").otherwise("")
    return B.table(spark, d, "pages").select("page_id", C.is_test_path(F.col("url")).alias("is_test"), ext.alias("ext"))


@query("""WITH p AS (SELECT page_id, regexp_split_to_array(lower(url), '[/._-]+') AS w FROM pages)
SELECT page_id, list_filter([CASE WHEN list_has_any(w, ['main', 'index', 'app', 'server', '__main__']) THEN 'entrypoint' END, CASE WHEN list_has_any(w, ['config', 'settings', 'conf', 'env']) THEN 'config' END, CASE WHEN list_has_any(w, ['auth', 'login', 'session', 'oauth', 'jwt']) THEN 'auth' END,
 CASE WHEN list_has_any(w, ['db', 'database', 'sql', 'migrations', 'models', 'schema']) THEN 'database' END, CASE WHEN list_has_any(w, ['http', 'api', 'routes', 'handlers', 'controllers']) THEN 'http' END, CASE WHEN list_has_any(w, ['cli', 'cmd', 'commands']) THEN 'cli' END, CASE WHEN list_has_any(w, ['types', 'interfaces', 'dto']) THEN 'types' END], lambda x: x IS NOT NULL) AS tags FROM p""")
def file_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", C.file_tags(F.col("url")).alias("tags"))
