import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestar.model import IndexConfig
from lodestar.operators import change
from lodestar.plans import index
from lodestar.sources import parsers, records, trees
from lodestar.streaming import feeds

FILES = {
    "README.md": "# Tool\nIt parses things.\n",
    "pkg/__init__.py": "",
    "pkg/util.py": '"""Helpers for the tool."""\n\n\ndef helper(x):\n    # TODO: make it faster\n    return x\n\n\nclass Box:\n    def open(self):\n        return helper(self)\n',
    "pkg/api.py": "from pkg.util import helper\nfrom . import util\n\n\ndef handle(r):\n    return helper(r)\n",
    "tests/test_util.py": "from pkg.util import helper\n\n\ndef test_helper():\n    assert helper(1) == 1\n",
    "pkg/settings.toml": "a = 1\n",
    "lib.rs": "use crate::x;\npub fn go(a: u8) -> u8 {\n    inner(a)\n}\nfn inner(a: u8) -> u8 {\n    a\n}\n",
    "pic.png": "not read",
    "node_modules/x.js": "function no() {}\n",
    "skip/me.py": "x = 1\n",
    ".gitignore": "skip\n",
}


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def shown(ix):
    rows = lambda d, *c: sorted((tuple(r) for r in d.select(*c).collect()), key=repr)
    return rows(ix.files, "path", "id", "language", "purpose"), rows(ix.symbols, "id", "path", "kind", "parent_symbol_id"), rows(ix.relations, "source_id", "target_id", "kind", "weight"), rows(ix.memories, "id", "kind", "symbol_id"), rows(ix.dropped, "source_id", "target_id")


def test_scan_follows_the_rules(tmp_path):
    put(tmp_path, FILES)
    assert [p for p, _, _ in trees.scan_tree(tmp_path)] == ["README.md", "lib.rs", "pic.png", "pkg/__init__.py", "pkg/api.py", "pkg/settings.toml", "pkg/util.py", "tests/test_util.py"]


def test_full_equals_incremental(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, FILES)
    first = index.full(spark, str(root)).write(str(tmp_path / "index"))
    by_path = {r["path"]: r["id"] for r in first.files.collect()}
    edges = {(r["source_id"], r["target_id"], r["kind"]) for r in first.relations.collect()}
    assert (by_path["pkg/api.py"], by_path["pkg/util.py"], "imports") in edges
    assert (by_path["tests/test_util.py"], by_path["pkg/util.py"], "test_for") in edges
    assert (by_path["pkg/settings.toml"], by_path["pkg/util.py"], "config_for") in edges
    names = {r["id"]: r["name"] for r in first.symbols.collect()}
    assert ("handle", "helper") in {(names.get(a), names.get(b)) for a, b, k in edges if k == "calls"}
    assert {r["purpose"] for r in first.files.filter("purpose is not null").collect()} == {"Helpers for the tool."}
    assert [(r["kind"], names[r["symbol_id"]] if r["symbol_id"] else None) for r in first.memories.collect()] == [("todo", None)]

    (root / "pkg/util.py").write_text(FILES["pkg/util.py"].replace("def helper", "def assist"))
    (root / "lib.rs").unlink()
    put(root, {"pkg/more.py": "from pkg.util import assist\n\n\ndef more():\n    return assist(2)\n"})
    assert shown(index.incremental(spark, first, str(root))) == shown(index.full(spark, str(root)))


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("python", "class A:\n    def f(self): ...\ndef _g(): ...\n", [("A", "class", True), ("f", "method", True), ("_g", "function", False)]),
        ("rust", "pub struct S {\n}\nimpl S {\n    pub fn new() -> S { S }\n}\n", [("S", "struct", True), ("S", "impl", False), ("new", "method", True)]),
        ("go", "func Do(x int) {\n}\nfunc (s *T) run() {\n}\ntype T struct {\n}\n", [("Do", "function", True), ("run", "method", False), ("T", "struct", True)]),
        ("typescript", "export class A {\n}\nexport interface B {\n}\nconst f = (x) => x\n", [("A", "class", True), ("B", "interface", True), ("f", "function", False)]),
        ("java", "public class A {\n    public int f(int x) {\n        return g(x);\n    }\n}\n", [("A", "class", True), ("f", "method", True)]),
        ("csharp", "public class A {\n    public int F(int x)\n    {\n    }\n}\n", [("A", "class", True), ("F", "method", True)]),
        ("kotlin", "class A {\n}\nfun go(x: Int) = x\n", [("A", "class", True), ("go", "function", True)]),
        ("c", "#define N 3\nstruct P {\n};\nint add(int a) {\n  return a;\n}\n", [("N", "constant", True), ("P", "struct", True), ("add", "function", True)]),
    ],
)
def test_parsers(language, text, names):
    assert [(s["name"], s["kind"], s["exported"]) for s in parsers.parse(text, "p", "f", language).symbols] == names


def test_broken_python_gives_comments():
    p = parsers.python("def (:\n# TODO x\n", "p", "f")
    assert not p.symbols and p.comments[0]["text"] == "TODO x"


def test_git_log_and_diff(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    put(tmp_path, {"a.py": "1\n2\n3\n", "b.py": "x\n"})
    run("add", ".")
    run("commit", "-qm", "first | piped")
    put(tmp_path, {"a.py": "1\nnew\n3\n", "c.py": "y\n"})
    commits, files = records.log(spark, str(tmp_path))
    assert [r["message"] for r in commits.collect()] == ["first | piped"]
    assert sorted((r["path"], r["status"]) for r in files.collect()) == [("a.py", "A"), ("b.py", "A")]
    assert [tuple(r) for r in change.unified_diff(records.diff_lines(spark, str(tmp_path))).collect()] == [("a.py", 2, 2)]
    assert [r[0] for r in records.changed_paths(spark, str(tmp_path)).collect()] == ["a.py", "c.py"]
    with pytest.raises(ValueError):
        records.commit_hunks(spark, str(tmp_path), "--all")


def test_memory_files(spark, tmp_path):
    entry = {"id": records.next_id(str(tmp_path)), "kind": "decision", "title": "Use Parquet", "tags": ["io"], "related_files": [], "related_symbols": ["a"], "pinned": True, "status": "active", "content": "Because +++ it is columnar.\nSecond line"}
    records.write_entry(str(tmp_path), entry)
    r = records.project_memory(spark, str(tmp_path)).first()
    assert r["id"] == "mem_0001" and r["content"] == entry["content"] and r["pinned"] and r["tags"] == ["io"]
    assert records.next_id(str(tmp_path)) == "mem_0002"


def test_streams(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps({"path": p}) for p in ["a.py", "a.py", ".git/x", "b.py"]))
    got = []
    q = feeds.watch(spark, str(feed), lambda d, n: got.append(sorted(r[0] for r in d.collect())), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert got == [["a.py", "b.py"]]

    usage = tmp_path / "usage"
    usage.mkdir()
    (usage / "1.json").write_text("\n".join(json.dumps({"command": c, "bytes_served": 5, "ts": "2024-01-01T00:00:00Z"}) for c in "aab"))
    q = feeds.usage_counters(feeds.read_usage(spark, str(usage))).writeStream.outputMode("complete").format("memory").queryName("usage_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["command"], r["calls"], r["unmeasured"]) for r in spark.sql("select * from usage_counts").collect()} == {("a", 2, 2), ("b", 1, 1)}


def test_staleness(spark):
    listing = spark.createDataFrame([("a", 1, 50.0), ("b", 2, 10.0), ("c", 3, 10.0), ("z", 1, 9e12)], "path string, size long, mtime double")
    known = spark.createDataFrame([("a", 1), ("b", 5), ("d", 1), ("z", 1)], "path string, size long")
    assert {(r["path"], r["why"]) for r in trees.staleness(listing, known, 20.0).collect()} == {("a", "touched"), ("b", "touched"), ("c", "new"), ("d", "missing")}


def test_gate(spark):
    rows = spark.createDataFrame([("a.py", 3, bytearray(b"x=1")), ("b.py", 3, bytearray(b"\x00a")), ("c.png", 1, bytearray(b"a")), ("d.py", 9 << 20, bytearray(b"a"))], "path string, size long, content binary")
    from lodestar.model import IndexConfig

    assert {r["path"]: r["state"] for r in trees.gated(rows, IndexConfig()).collect()} == {"a.py": "full", "b.py": "binary", "c.png": "asset", "d.py": "oversize"}
    assert trees.file_entries(trees.gated(rows, IndexConfig())).filter(F.col("hash").startswith("skip:")).count() == 3


def test_files_with_an_underscore_are_read(spark, tmp_path):
    put(tmp_path, {"pkg/__init__.py": "def boot():\n    return 1\n", "pkg/_util.py": "def aid():\n    return 2\n", "pkg/a.py": "from pkg._util import aid\n\n\ndef go():\n    return aid()\n"})
    ix = index.full(spark, str(tmp_path))
    assert sorted(r["name"] for r in ix.symbols.collect()) == ["aid", "boot", "go"]
    assert ix.files.filter("id is null or hash is null").count() == 0
    names = {r["id"]: r["name"] for r in ix.symbols.collect()}
    assert ("go", "aid") in {(names.get(r["source_id"]), names.get(r["target_id"])) for r in ix.relations.filter("kind = 'calls'").collect()}


def test_nested_ignore_rules(tmp_path):
    put(tmp_path, {
        ".gitignore": "*.log\n/only.py\nbuild/\ndocs/*.txt\n**/gen/**\n!keep.log\n", "a.log": "x", "keep.log": "x", "only.py": "x", "sub/only.py": "x", "sub/build/x.py": "x", "sub/build.py": "x",
        "docs/a.txt": "x", "docs/deep/b.txt": "x", "x/gen/y.py": "x", "sub/.gitignore": "!a.log\ntmp?.py\n", "sub/a.log": "x", "sub/tmp1.py": "x", "tmp1.py": "x", "lib/a.rs": "x", ".hidden/a.py": "x",
    })
    found = [p for p, _, _ in trees.scan_tree(tmp_path, IndexConfig(ignore=("lib",)))]
    assert found == ["docs/deep/b.txt", "keep.log", "sub/a.log", "sub/build.py", "sub/only.py", "tmp1.py"]
    assert [p for p, _, _ in trees.scan_tree(tmp_path, IndexConfig(ignore=()), depth=1, start="sub")] == ["sub/a.log", "sub/build.py", "sub/only.py"]
    only = trees.scan_tree(tmp_path, IndexConfig(ignore=(), languages=("rust",)))
    assert [p for p, _, _ in only] == ["docs/deep/b.txt", "keep.log", "lib/a.rs", "sub/a.log"]


def test_full_equals_incremental_equals_targeted(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, FILES)
    first = index.full(spark, str(root)).write(str(tmp_path / "index"))
    (root / "pkg/util.py").write_text(FILES["pkg/util.py"].replace("def helper", "def assist"))
    (root / "lib.rs").unlink()
    put(root, {"pkg/more.py": "from pkg.util import assist\n\n\ndef more():\n    return assist(2)\n", "skip/other.py": "y = 1\n"})
    full, grown = index.full(spark, str(root)), index.incremental(spark, first, str(root))
    aimed = index.targeted(spark, first, str(root), ["pkg/util.py", "lib.rs", str(root / "pkg/more.py"), "skip/other.py", "no/such.py"])
    assert shown(full) == shown(grown) == shown(aimed)
    with pytest.raises(ValueError, match="outside"):
        index.targeted(spark, first, str(root), ["../elsewhere.py"])
    again = aimed.write(str(tmp_path / "index"))
    assert shown(index.load(spark, str(tmp_path / "index"))) == shown(again)
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "nothing"))


def test_stop_names_by_language(spark):
    from lodestar.functions import stopnames
    from lodestar.operators import graph

    calls = spark.createDataFrame([("a.py", "s", "append", True), ("a.py", "s", "unwrap", False), ("a.rs", "s", "unwrap", True), ("a.ts", "s", "forEach", True), ("a.unknown", "s", "unwrap", False), ("a.py", "s", "own", False)], "path string, caller_id string, callee string, is_method boolean")
    left = graph.not_stopped(calls, stopnames.stop_table(spark)).collect()
    assert {(r["path"], r["callee"]) for r in left} == {("a.py", "unwrap"), ("a.py", "own")}
    assert stopnames.is_ubiquitous("len", "go") and not stopnames.is_ubiquitous("unwrap", "python") and stopnames.is_ubiquitous("unwrap")
