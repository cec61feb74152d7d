"""The queries of the corpus operators: each applies one to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dup, pii, quality, sharding, substring_dedup, suffix_dedup, token_counts, url_filters

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
TOKEN_LIMIT = 4096
#: The key of the pseudonyms in the query; deployments pass their own secret to pii.pseudonymise().
PII_KEY = "lodestar-example-key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filters.fit(url_filters.weak_labels(pages))
    return url_filters.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(read(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(read(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start_word"), F.col("s.end").cast("long").alias("end_word"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.aggregate(F.map_values("pii"), F.lit(0), lambda a, n: a + n).cast("long").alias("n_replaced"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position")
    return mixing.scheduled(read(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken", "copies", first)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.repeated_words_removed(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.measure(read(spark, sf_dir, "documents"), keep=["doc_id"])
    failed, kept = quality.verdicts("quality")
    base = [F.col(f"quality.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, failed.alias("base_failed"), kept.alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_minhash_near_dup, op3_decontaminate, op4_hilbert_shards, op5_token_counts, op6_suffix_dedup, op7_pseudonyms, op8_curriculum_mix, op9_substring_dedup, op10_repetition_coverage)
}

WORDS_SQL = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Documents as lists of words, and the words of every n-word window that also starts elsewhere.
REPEATS_SQL = """
d AS (SELECT doc_id, {words} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {n} + 2)) AS i, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: md5(array_to_string(list_slice(ws, i, i + {n} - 1), ' ')))) AS h FROM d WHERE len(ws) >= {n}),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM r)"""


def repeats_sql(n: int) -> str:
    return REPEATS_SQL.format(n=n, words=WORDS_SQL.format(text="coalesce(text, '')"))


def coverage_sql() -> str:
    """The characters that later ones of equal n-grams cover, for each n of the rules, as CTEs c5, c6 ..."""
    out = ""
    for n in sorted(quality.NGRAM_LIMITS):
        out += f""",
g{n} AS (SELECT doc_id, unnest(range(1, len(ws) - {n} + 2)) AS i, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(list_slice(ws, i, i + {n} - 1), ' '))) AS h FROM d WHERE len(ws) >= {n}),
l{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM g{n}) WHERE k > 1),
c{n} AS (SELECT doc_id, sum(length(ws[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM l{n}) JOIN d USING (doc_id) GROUP BY doc_id)"""
    return out


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL.format(text="coalesce(text, '')")} AS ws FROM documents),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
dl AS (SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM ln) WHERE k > 1 AND regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dc AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM dl GROUP BY doc_id),
g3 AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) AS h FROM d WHERE len(ws) >= 3),
l3 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS k FROM g3) WHERE k > 1),
c3 AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM l3) GROUP BY doc_id){coverage_sql()},
a AS (SELECT m.*, coalesce(dc.n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(dc.chars, 0) / greatest(word_chars, 1) <= {quality.LINE_LIMIT}::DOUBLE {" ".join(f"AND coalesce(c{n}.chars, 0) / greatest(word_chars, 1) <= {limit}::DOUBLE" for n, limit in sorted(quality.NGRAM_LIMITS.items()))} AS good
  FROM m LEFT JOIN dc USING (doc_id) LEFT JOIN c3 USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in sorted(quality.NGRAM_LIMITS))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND good AS kept FROM a"""

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM d),
n AS (SELECT d.doc_id, count(sh) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k USING (doc_id)"""

#: DuckDB SQL where it can express a query.
ORACLES: dict[str, str] = {
    "op2_minhash_near_dup": NEAR_SQL,
    "op6_suffix_dedup": f"""
WITH {repeats_sql(suffix_dedup.MIN_WORDS)},
e AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c)
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS start_word, CAST(max(p) AS BIGINT) AS end_word FROM e GROUP BY doc_id, run""",
    "op9_substring_dedup": f"""
WITH {repeats_sql(substring_dedup.WINDOW)},
gone AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda w, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op10_repetition_coverage": QUALITY_SQL,
    "op8_curriculum_mix": """
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 8))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS schedule FROM d GROUP BY source),
o AS (SELECT *, (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[schedule + 1] AS w, 2.0 * source_size AS cap FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM o),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM p),
t AS (
  SELECT source, source_size, schedule, round(CAST(coalesce(least(cap, w * (SELECT level FROM l WHERE cap > w * level ORDER BY place LIMIT 1)), cap) AS DOUBLE), 6) AS target FROM l),
m AS (
  SELECT doc_id, size, source_size, target, (ARRAY[1.0::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE])[schedule + 1] AS a, (ARRAY[1.0::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE])[schedule + 1] AS b,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) - size / 2 AS middle,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, passes + CASE WHEN middle <= target - passes * source_size THEN 1 ELSE 0 END AS n, least(1.0, middle / target) AS part FROM m)
SELECT doc_id, size, source_size, target, CAST(least(2, n) * size AS BIGINT) AS taken, CAST(CASE WHEN size > 0 THEN least(2, n) ELSE least(1, n) END AS INTEGER) AS copies,
       CASE WHEN (CASE WHEN size > 0 THEN least(2, n) ELSE least(1, n) END) > 0 AND target > 0
            THEN round(CASE WHEN part > 0 THEN least(1.0, 2 * part / (a + sqrt(greatest(a * a + part * (2 * (b - a)), 0)))) ELSE 0 END, 6) END AS first_position
FROM c""",
}
