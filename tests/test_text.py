import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.functions import text as T


@pytest.mark.parametrize(
    ("name", "words"),
    [("HTTPServer", ["http", "server"]), ("getUserByID", ["get", "user", "by", "id"]), ("snake_case-kebab", ["snake", "case", "kebab"]), ("base64Encode", ["base", "64", "encode"]), ("", []), ("__x__", ["x"])],
)
def test_identifiers_split_at_case_digits_and_signs(name, words):
    assert T.split_identifier(name) == words


@given(st.text("abzABZ019_-. ", max_size=20))
def test_split_keeps_all_letters_and_digits(name):
    assert "".join(T.split_identifier(name)) == re.sub("[^a-z0-9]", "", name.lower())


def test_column_split_equals_driver_split(spark):
    names = ["HTTPServer", "getUserByID", "base64Encode", "a-b_c9d", "XMLHttpRequest2", "été_Là", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.identifier_words(F.col("n")).alias("w")).collect()
    assert {r["n"]: r["w"] for r in rows} == {n: T.split_identifier(n) for n in names}


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caching", "cach"), ("running", "runn"), ("handlers", "handler"), ("entries", "entry"), ("serialization", "serialize"), ("authentication", "authenticate"), ("ranking", "rank"), ("status", None), ("cat", None), ("happiness", "happi")],
)
def test_primary_stem(word, stem):
    assert T.primary_stem(word) == stem


def test_stem_variants_hold_all_readings():
    assert T.stem_variants("running") == ["runn", "runne", "run"]
    assert "happy" in T.stem_variants("happiness")


def test_short_root():
    assert T.short_root("authentication") == "auth"
    assert T.short_root("config") is None
    assert T.short_root("snake_case_name") is None


def test_queries_expand():
    q = T.expand("Ask-context 42 a ask")
    assert q.words == ["ask", "context"]
    assert T.expand("7").words == ["7"]
    assert T.expand("").words == []
    assert "ctx" in T.expand("context").tokens[0].synonyms


def test_intents():
    assert T.detect_intent(["please", "fix", "find"]) == "debug"
    assert T.detect_intent(["hello"]) == "lookup"


def test_scores_in_order(spark):
    names = ["rank", "ranking", "ranker_x", "frank", "r_a_n_k", "other", "sort"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int").withColumns({"l": F.lower("name"), "w": C.identifier_words(F.col("name"))})
    t = T.expand("rank").tokens[0]
    got = {r["name"]: r["s"] for r in rows.select("name", C.single_score(t, F.col("l"), F.col("w")).alias("s")).collect()}
    assert got["rank"] == 1.0
    assert got["ranking"] == 0.9
    assert got["frank"] == pytest.approx(0.4 + 4 / 5 * 0.4)
    assert got["r_a_n_k"] == pytest.approx(0.2 + 4 / 7 * 0.2)
    assert got["other"] == 0.0


@pytest.mark.parametrize(
    ("path", "test"),
    [("tests/a.rs", True), ("src/contest.rs", False), ("src/foo_test.go", True), ("a/b.spec.ts", True), ("test_x.py", True), ("src/conftest.py", True), ("src/main/FooTest.java", True), ("Test.java", False), ("src/tests.rs", True), ("src/testing.rs", False), ("src/test/java/A.java", True)],
)
def test_test_paths(spark, path, test):
    assert spark.createDataFrame([(path,)], "p string").select(C.is_test_path(F.col("p"))).first()[0] is test


def test_text_helpers(spark):
    r = spark.createDataFrame([("One two. Three", "[1.0, 2.0]")], "t string, v string").select(C.first_sentence(F.col("t"), 50), C.truncate(F.col("t"), 3), C.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), C.l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert r[0] == "One two" and r[1] == "One..." and r[2] == 11.0 and [round(x, 3) for x in r[3]] == [0.6, 0.8]


def test_short_forms_of_a_vocabulary():
    from lodestar.functions import text

    pairs = {("msg", "message"), ("ctx", "context"), ("pkg", "package"), ("conn", "connection"), ("req", "request"), ("cfg", "configuration"), ("buf", "buffer")}
    assert all(text.abbreviates(a, b) for a, b in pairs)
    assert not any(text.abbreviates(a, b) for a, b in [("cat", "dog"), ("as", "assert"), ("message", "msg"), ("code", "context"), ("a", "array"), ("tx", "text")])
    groups = text.groups_of(["msg", "message", "msgs", "dog", "request", "req"], ())
    assert ("message", "msg") in groups and ("request", "req") in groups and not any("dog" in g for g in groups)
    assert "message" in text.expand("msg", groups).tokens[0].synonyms


def test_concepts():
    from lodestar.functions import text

    assert text.with_concepts(["login", "page"])[:2] == ["login", "page"] and "session" in text.new_terms(["login"])
    assert text.new_terms(["login"], {"login": ("door",)}) == ["door"] and text.new_terms(["caching"]) == list(text.CONCEPTS["cache"])
