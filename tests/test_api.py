import subprocess

import pytest
from test_index import FILES, put

from lodestar.api import Project


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put(root, FILES | {"docs/adr/1.md": "# Decision\nWe keep the helper function small on purpose.\n"})
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    p = Project(spark, str(root), str(tmp_path_factory.mktemp("store"))).index()
    (root / "pkg/util.py").write_text(FILES["pkg/util.py"].replace("    return x", "    return x + 1"))
    return p


def names(df, c="name"):
    return [r[c] for r in df.collect()]


def test_search(project):
    assert names(project.find_symbol("helper"))[0] == "helper"
    assert names(project.get_symbol("Box.open")) == ["open"]
    assert "pkg/util.py" in names(project.find_files("util"), "path")
    assert "pkg/util.py" in names(project.find_related("pkg/api.py"), "path")
    assert "helper" in names(project.ask("where is the helper"))
    assert names(project.semantic_search("assist helper"))
    assert [(r["path"], r["line"]) for r in project.grep(["todo"]).collect()] == [("pkg/util.py", 5)]
    assert names(project.explore_symbol("helper"))[0] == "helper"
    assert project.edit_context("helper").first()["body"].startswith("def helper")


def test_graph_and_changes(project):
    assert set(names(project.callers("helper"))) >= {"handle"}
    assert project.why_no_callers("handle") == "no_edges"
    assert {"handle"} <= set(names(project.affected("helper")))
    assert names(project.changed()) == ["helper"]
    assert "tests/test_util.py" in names(project.smart_tests(), "path")
    assert names(project.untested()) == []
    assert project.verify_change().first()["changed"] == 1
    assert "helper" in names(project.diff_context())
    assert names(project.history("pkg/util.py"), "message") == ["first"]
    assert project.coupling().count() > 0
    assert len(names(project.blame("pkg/api.py", 1, 3), "hash")) == 1
    assert names(project.debug_trace('File "pkg/util.py", line 6')) [0] == "helper"


def test_reports_and_memory(project, tmp_path):
    assert project.status().first()["files"] >= 8
    assert project.onboard().count() > 5 and project.outline().count() > 2 and project.hotspots(files=True, churn=True).count() > 3
    key = project.remember("decision", "Use small helper functions", related_symbols=["helper"], title="Size")
    project.remember("warning", "Make helper functions large", related_symbols=["helper"])
    assert key == "mem_0001"
    assert "mem_0001" in names(project.memory_search("small helper"), "id")
    assert [r["ids"] for r in project.memory_conflicts().collect()] == [["mem_0001", "mem_0002"]]
    assert "decision" in names(project.rationale("why is the helper small", "full"), "kind")
    project.export_jsonl(str(tmp_path / "out"))
    assert project.spark.read.text(str(tmp_path / "out")).count() > 20


def test_annotations_layers_and_histories(project):
    project.annotate("pkg/api.py", " Handles requests ", {"handle": "answer"})
    project.annotate("pkg/api.py", "Handles all requests", {"call": "question"})
    row = project.annotations().filter("path = 'pkg/api.py'").first()
    assert (row["purpose"], row["terms"]) == ("Handles all requests", {"handle": "answer", "call": "question"})
    assert project.files().filter("path = 'pkg/api.py'").first()["purpose_source"] == "agent"
    with pytest.raises(ValueError, match="not indexed"):
        project.annotate("no/such.py", "x")
    with pytest.raises(ValueError, match="300"):
        project.annotate("pkg/api.py", "x" * 301)
    project.forget_annotation("pkg/api.py")
    assert project.annotations().count() == 0 and "pkg/api.py" in names(project.annotation_queue(), "path")
    layers = project.ask_context("where is the helper", include=("code", "rationale", "history"))
    assert set(layers) == {"packet", "code", "rationale", "history"} and names(layers["history"], "message")[0] == "first"
    assert any("def helper" in c for c in names(layers["code"], "code"))
    assert names(project.symbol_history("handle"), "message") == ["first"] and project.symbol_history("nothing").count() == 0
    assert names(project.change_timeline("pkg/api.py"), "event") == ["introduced"]
    assert {r["via"] for r in project.affected_provenance("helper").collect()} <= {"calls", "imports", "test_for"}
    assert project.contract_changes().count() == 0 and project.verify_change().first()["contracts"] == 0
    assert project.new_terms("auth error") and project.concept_search("helper").count() > 0
    assert project.why_no_edges("len") == "filtered_ubiquitous"


def test_vectors_follow_the_symbols(project, tmp_path):
    from lodestar.operators.vectors import HashingEmbedder

    project.vectors_path = str(tmp_path / "vectors")
    project.sync_vectors(HashingEmbedder())
    n = project.symbols.count()
    assert project.vector_status().select("live", "current", "to_embed", "to_drop").first() == (n, n, 0, 0)
    hit = project.semantic_search("helper", query=HashingEmbedder().embed(["function helper"])[0])
    assert names(hit)[0] == "helper"


def test_reindexing_what_was_edited(project):
    from pathlib import Path

    root = Path(project.root)
    (root / "pkg/late.py").write_text("from pkg.util import helper\n\n\ndef late():\n    return helper(3)\n")
    project.index_paths(["pkg/late.py"])
    assert "late" in names(project.callers("helper"))
    (root / "pkg/late.py").unlink()
    project.index_changed()
    assert project.get_symbol("late").count() == 1  # git knows of no change: the file was never added
    project.index_paths([str(root / "pkg/late.py")])
    assert project.get_symbol("late").count() == 0
    with pytest.raises(ValueError, match="outside"):
        project.index_paths(["/elsewhere.py"])
