import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.model import Weights
from lodestar.operators import change, graph, history, memory, ranking, reports, search, vectors

SYMBOL = "id string, file_id string, name string, kind string, language string, path string, signature string, span struct<start_line:int,end_line:int,start_col:int,end_col:int>, parent_symbol_id string, exported boolean, visibility string, doc_summary string, ordinal long"


def symbols(spark, rows):
    made = [(i, p, n, k, "rust", p, None, (a, b, 0, 0), parent, True, "public", None, j) for j, (i, n, k, p, a, b, parent) in enumerate(rows)]
    return search.with_search_columns(spark.createDataFrame(made, SYMBOL))


@pytest.fixture(scope="module")
def code(spark):
    return symbols(spark, [
        ("a", "parse_file", "function", "src/parse.rs", 1, 10, None), ("b", "parse_line", "function", "src/parse.rs", 3, 5, None), ("c", "run", "function", "src/main.rs", 1, 9, None),
        ("m", "tests", "module", "src/parse.rs", 20, 40, None), ("t", "checks_parse", "function", "src/parse.rs", 21, 30, "m"), ("u", "render", "method", "src/out.rs", 1, 4, None),
    ])


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame([("c", "a", "calls", 1.0), ("a", "b", "calls", 1.0), ("t", "a", "calls", 1.0), ("x", "c", "calls", 0.5)], "source_id string, target_id string, kind string, weight float")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_callers_and_callees(code, relations):
    assert ids(graph.callers(code, relations, "parse_file")) == ["c", "t"]
    assert ids(graph.callees(code, relations, "parse_file")) == ["b"]
    assert graph.no_callers_because(code, relations, "render", []) == "no_edges"
    assert graph.no_callers_because(code, relations, "nothing", []) == "symbol_not_found"
    assert graph.no_callers_because(code, relations, "x", ["x"]) == "frequency_filtered"


def test_affected_has_least_depths_and_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "c")], "source string, target string")
    got = {(r["seed"], r["id"]): r["depth"] for r in graph.affected(edges, spark.createDataFrame([("c", "c"), ("z", "z")], "seed string, id string"), 5).collect()}
    assert got == {("c", "b"): 1, ("c", "a"): 1, ("c", "d"): 2}


def test_weak_calls_carry_no_change(relations):
    assert graph.dependency_edges(relations).count() == 3


def test_test_symbols_go_down_the_parents(code):
    assert ids(graph.test_symbols(code)) == ["m", "t"]


def test_call_resolution(spark, code):
    calls = spark.createDataFrame([("src/parse.rs", "a", "parse_line", False), ("src/main.rs", "c", "parse_file", False), ("src/main.rs", "c", "run", False), ("src/main.rs", "c", "render", True)], "path string, caller_id string, callee string, is_method boolean")
    got = {(r["source_id"], r["target_id"]) for r in graph.resolve_calls(calls, code).collect()}
    assert got == {("a", "b"), ("c", "a"), ("c", "u")}


def test_untested_symbols(spark, code, relations):
    files = spark.createDataFrame([("src/out.rs", "src/out.rs")], "id string, path string")
    assert ids(change.untested(code, code, relations, files)) == ["c", "u"]


def test_verify_change(spark, code, relations):
    files = spark.createDataFrame([("src/out.rs", "src/out.rs", "rust")], "id string, path string, language string")
    hunks = spark.createDataFrame([("src/parse.rs", 4, 4)], "path string, start int, end int")
    commits = spark.createDataFrame([("h", "src/parse.rs")], "hash string, path string")
    r = change.verify_change(hunks, code, relations, files, commits).first()
    assert (r["changed"], r["affected"], r["untested"], r["missing_co_changes"]) == (2, 2, 0, 0)


def test_diff_parser(spark):
    diff = ["+++ b/x.py", "@@ -1,2 +3,4 @@ f", "+a", "@@ -9 +0,0 @@", "+++ b/y.py", "@@ -5 +7 @@"]
    got = [tuple(r) for r in change.unified_diff(spark.createDataFrame([("d", i, t) for i, t in enumerate(diff)], "source string, n int, text string")).collect()]
    assert got == [("x.py", 3, 6), ("x.py", 1, 1), ("y.py", 7, 7)]


def test_stack_frames(spark):
    t = 'Traceback\n  File "a/b.py", line 12, in f\n  at src/x.rs:40:5\n  File "a/b.py", line 12'
    got = [(r["place"], r["path"], r["line"]) for r in change.stack_frames(spark.createDataFrame([(1, t)], "id int, text string"), "id", "text").orderBy("place").collect()]
    assert got == [(1, "a/b.py", 12), (2, "src/x.rs", 40)]


def test_missing_co_changes(spark):
    rows = [(h, p) for h in range(4) for p in ("a", "b")] + [(4, "a"), (5, "c"), (0, "Cargo.lock"), (1, "Cargo.lock"), (2, "Cargo.lock")]
    got = history.missing_co_changes(spark.createDataFrame(rows, "hash int, path string"), spark.createDataFrame([("a",)], "path string")).collect()
    assert [(r["file"], r["co_changed_with"], r["count"], r["confidence"]) for r in got] == [("b", "a", 4, 0.8)]


def test_huge_commits_pair_nothing(spark):
    rows = [(1, f"f{i}") for i in range(60)] + [(2, "f1"), (2, "f2"), (3, "f1"), (3, "f2")]
    got = history.co_change_pairs(spark.createDataFrame(rows, "hash int, path string")).collect()
    assert [tuple(r) for r in got] == [("f1", "f2", 2)]


@pytest.mark.parametrize(
    ("rows", "k", "names"),
    [
        ([("d/a.rs", "1", 1.0), ("d/a.rs", "2", 0.95), ("d/a.rs", "3", 0.9), ("e/b.rs", "4", 0.7)], 3, ["1", "4", "2"]),
        ([("a.rs", "x", 0.9), ("a.rs", "x", 0.5), ("b.rs", "y", 0.1)], 5, ["x", "y"]),
    ],
)
def test_diverse_packets(spark, rows, k, names):
    df = spark.createDataFrame([("q", p, n, s, i) for i, (p, n, s) in enumerate(rows)], "query_id string, path string, name string, score double, ordinal int")
    assert [r["name"] for r in ranking.diverse(df, k).orderBy("rank").collect()] == names


def test_pick_equals_definition():
    import random

    rnd = random.Random(3)
    pool = pd.DataFrame([(f"d{rnd.randint(0, 2)}/f{rnd.randint(0, 3)}", round(rnd.random(), 2)) for _ in range(40)], columns=["path", "score"])
    pool["dir"] = pool.path.str.split("/").str[0]
    pool = pool.sort_values("score", ascending=False, kind="stable").reset_index(drop=True)
    pool["place"] = range(len(pool))
    got = ranking.pick(pool, 12, 0.5, 0.85)
    left, seen = pool.copy(), []
    for _ in range(12):
        def worth(r):
            f = sum(x.path == r.path for x in seen)
            return r.score * 0.5**f * 0.85 ** (sum(x.dir == r.dir for x in seen) - f)
        w = [worth(r) for r in left.itertuples()]
        i = w.index(max(w))
        seen.append(left.iloc[i])
        left = left.drop(left.index[i])
    assert got.place.tolist() == [s.place for s in seen]


def test_blend_caps_weak_hits_and_takes_one_a_file(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.85), (3, "b", 0.7), (4, "c", 0.5)], "id long, path string, cosine double")
    known = spark.createDataFrame([(1, 0.3)], "id long, score double")
    got = {r["id"]: r["score"] for r in vectors.blend(hits, known, 0.65, Weights()).collect()}
    assert set(got) == {1, 2, 3} and got[3] == pytest.approx(0.63)


def test_memory_conflicts_and_supersession(spark):
    schema = "id string, content string, related_symbols array<string>, status string, supersedes string"
    rows = [("1", "x", ["s"], "active", None), ("2", "y", ["s"], "active", None), ("3", "y", ["s"], "active", None), ("4", "z", ["t"], "active", None), ("5", "w", ["t"], "active", "4"), ("6", "q", ["s"], "archived", None)]
    got = [(r["signal"], r["ids"]) for r in memory.conflicts(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("symbol:s", ["1", "2"])]


def test_sections(spark):
    text = "intro words here\n# Decision\nwe take the long way home\n## Other\nshort"
    got = memory.doc_sections(spark.createDataFrame([("docs/adr/1.md", text)], "path string, text string"), "path", "text").orderBy("section").collect()
    assert [(r["header"], r["kind"], r["start_line"], r["end_line"]) for r in got] == [("", "doc_section", 1, 1), ("Decision", "decision", 2, 3)]


def test_anchors(spark):
    r = spark.createDataFrame([("Use `my.Var` and parseFile for THE file_name",)], "t string").select(memory.anchors(F.col("t"))).first()[0]
    assert r == ["file", "file_name", "for", "my.var", "parse", "parsefile", "use", "var"] or "parsefile" in r and "my.var" in r and "the" not in r


def test_usage_and_scores(spark):
    e = spark.createDataFrame([("a", 10, 100), ("a", 5, None), ("b", 7, 0)], "command string, bytes_served long, raw_baseline long")
    got = {r["command"]: (r["calls"], r["measured"], r["ratio"]) for r in reports.usage(e, rollup=True).collect()}
    assert got == {"a": (2, 10, 10.0), "b": (1, 7, None), None: (3, 17, round(100 / 17, 6))}
    case = spark.createDataFrame([("c", 1, 2, 0, 0, 0, 2, True, False)], "id string, must_include_found int, must_include_total int, should_include_found int, should_include_total int, irrelevant_found int, selected_files int, files_within_limit boolean, bytes_within_limit boolean")
    assert reports.case_scores(case).first()["score"] == 25 + 15 + 10 - 2


def test_batch_search_equals_single_searches(spark, sf_dir):
    from lodestar import bindings
    from lodestar.operators import search

    symbols = bindings.symbols(spark, sf_dir).cache()
    texts = ["gear", "small gear ring", "Red Bolt", "rdot", "nothing_like_it", "blue bolt"]
    got = search.batch(symbols, texts, 7).collect()
    for t in texts:
        want = [(r["id"], round(r["score"], 9)) for r in search.find_symbol(symbols, t, 7).collect()]
        mine = sorted(((r["place"], r["id"], round(r["score"], 9)) for r in got if r["question"] == t))
        assert [x[1:] for x in mine] == want


def test_vector_batches_in_blocks(spark, sf_dir, monkeypatch):
    from lodestar import bindings
    from lodestar.operators import vectors

    v = bindings.vectors(spark, sf_dir)
    asked = v.filter("id < 25").selectExpr("id as query", "embedding as q")
    asked = asked.unionByName(asked.filter("query = 3").selectExpr("cast(null as long) as query", "q"))
    whole = vectors.top_k_batch(v, asked, 4).collect()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 60)
    assert sorted(map(tuple, vectors.top_k_batch(v, asked, 4).collect()), key=repr) == sorted(map(tuple, whole), key=repr) and len(whole) == 26 * 4
