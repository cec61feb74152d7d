"""The corpus queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest
from test_corpus_operators import brute_components, brute_quality, brute_targets, words_of

import corpus_pipeline
from lodestar.llm import quality, queries
from lodestar.llm.common import saved


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    mine = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(mine.columns) == sorted(columns)
    order = sorted(columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    got = sorted((tuple(plain(r[c]) for c in order) for r in mine.collect()), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize(("name", "table", "key"), [("op1_url_filter", "pages", "page_id"), ("op4_hilbert_shards", "documents", "doc_id"), ("op5_token_counts", "documents", "doc_id"), ("op7_pseudonyms", "documents", "doc_id")])
def test_query_has_a_row_for_each_row(spark, sf_dir, name, table, key):
    got = Counter(r[key] for r in queries.QUERIES[name](spark, sf_dir).collect())
    assert got == Counter(r[key] for r in queries.read(spark, sf_dir, table).collect())


def brute_kept(t):
    n, _, _, _, repeat, _ = brute_quality(t)
    if n < quality.MIN_WORDS or 100 * repeat > quality.MAX_REPEAT_PERCENT * n:
        return False
    words = words_of(t)
    whole = sum(map(len, words))
    for k, limit in quality.NGRAM_LIMITS.items():
        first, hit = set(), set()
        for i in range(len(words) - k + 1):
            g = tuple(words[i : i + k])
            if g in first:
                hit.update(range(i, i + k))
            first.add(g)
        if sum(len(words[i]) for i in hit) / whole > limit:
            return False
    seen, chars = set(), 0
    for line in t.split("\n"):
        if line in seen:
            chars += sum(map(len, words_of(line)))
        seen.add(line)
    return chars / whole <= quality.LINE_LIMIT


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    alive = set(rows)
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality rules", "near-duplicates", "benchmark leaks", "source mix", "shards"]

    def step(name, d):
        out = saved(named[name](spark, d, sf_dir), "test-stage")
        return out, Counter(r["doc_id"] for r in out.collect())

    docs, got = step("quality rules", docs)
    alive = {i for i in alive if brute_kept(rows[i]["text"])}
    assert docs.columns == columns and got == Counter(alive)

    docs, got = step("near-duplicates", docs)
    ids = sorted(alive)
    found = brute_components([rows[i]["text"] for i in ids], ids, 5)
    alive = {i for i in ids if found[i][1] == i}
    assert docs.columns == columns and got == Counter(alive)

    docs, got = step("benchmark leaks", docs)
    plain = lambda t: " " + re.sub(r"\W+", " ", t.lower()).strip() + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    alive = {i for i in alive if not any(x in plain(rows[i]["text"]) for x in items)}
    assert docs.columns == columns and got == Counter(alive)

    docs, got = step("source mix", docs)
    sizes = Counter()
    for i in alive:
        sizes[rows[i]["source"]] += len(words_of(rows[i]["text"]))
    want, taken = brute_targets(sizes), Counter()
    for i, n in got.items():
        assert i in alive and n <= 2
        taken[rows[i]["source"]] += n * len(words_of(rows[i]["text"]))
    largest = max(len(words_of(rows[i]["text"])) for i in alive)
    assert docs.columns == columns and all(abs(taken[s] - want[s]) <= largest for s in sizes)

    last = named["shards"](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in last) == got
    counts = Counter(r["shard"] for r in last)
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1


def test_two_runs_are_both_readable(spark, sf_dir):
    first, second = corpus_pipeline.run(spark, sf_dir), corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "shard", "slot"} <= set(first.columns)
    assert second.count() == first.count() > 0


def test_stages_on_edge_cases(spark, sf_dir):
    """Null texts, ids and sources, repeated rows, no rows, and a column whose name clashes with the operators' own."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, None, None, None, "x"), (1, text, None, None, None, "x"), (None, text + " more", "en", "s", 3, None), (2, None, "en", "s", 0, "x"), (3, "", "en", "s", 0, "x"), (4, text + " and", "en", "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key string")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = saved(stage(spark, left, sf_dir), "test-edges")
        assert left.columns == docs.columns
        if name == "quality rules":
            assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 1, None, 4])
        elif name != "source mix":
            assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 1, None])
    assert corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).count() == left.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_the_mix_is_written_by_shard(spark, sf_dir, tmp_path):
    corpus_pipeline.write(spark, sf_dir, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(found.columns)
    want = corpus_pipeline.run(spark, sf_dir)
    key = lambda d: Counter((r["doc_id"], r["shard"]) for r in d.select("doc_id", "shard").collect())
    assert key(found) == key(want)
