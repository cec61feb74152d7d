"""Git history, project memory files and annotations as tables, and their writers."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS

HASH = re.compile("[0-9a-f]{4,40}")
MARK = "+++"


def git(root: str, *args: str) -> str:
    """Output of a git query; a failure is an error, never an empty history."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return done.stdout


def log(spark: SparkSession, root: str, most: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a repository, or of one path through its renames; read once."""
    limit = ["-n", str(most)] if most else []
    own = ["--follow"] if path else []
    lines = git(root, "log", *own, "--relative", "--name-status", "--format=\x01%H|%aI|%an|%s", *limit, "--", path or ".").split("\n")
    rows, commit = [], -1
    for i, x in enumerate(lines):
        commit += x.startswith("\x01")
        if x:
            rows.append((commit, i, x))
    return parse_log(spark.createDataFrame(rows, "commit int, n int, line string"))


def parse_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) from log lines (commit, n, line): heads begin with 0x01 and have four fields, parted by |."""
    from pyspark.sql import Window

    head = F.col("line").startswith("\x01")
    own = Window.partitionBy("commit").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(F.when(head, F.col("line")), ignorenulls=True).over(own))
    parts = F.split(F.expr("substring(head, 2)"), "[|]", 4)
    rows = rows.withColumns({"hash": parts[0], "ts": F.to_timestamp(parts[1]), "author": parts[2], "message": parts[3]})
    commits = rows.filter(head).select(F.substring("hash", 1, 8).alias("hash"), "ts", "author", "message")
    files = rows.filter(~head).select(F.substring("hash", 1, 8).alias("hash"), F.substring_index("line", "\t", -1).alias("path"), F.substring("line", 1, 1).alias("status"))
    return commits, files


def diff_lines(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(source, n, text) of the working tree's diff against base: HEAD, or the empty tree before the first commit."""
    if base is None:
        try:
            base = git(root, "rev-parse", "--verify", "HEAD").strip()
        except RuntimeError:
            base = git(root, "hash-object", "-t", "tree", "/dev/null").strip()
    lines = git(root, "diff", "-U0", "--relative", base).split("\n")
    return spark.createDataFrame([("diff", i, x) for i, x in enumerate(lines)], "source string, n int, text string")


def changed_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path): changed, staged or untracked, each once."""
    names = set(git(root, "ls-files", "--others", "--exclude-standard").split("\n"))
    names |= {x[3:].split(" -> ")[-1] for x in git(root, "status", "--porcelain").split("\n")}
    return spark.createDataFrame([(n,) for n in sorted(names - {""})], "path string")


def commit_hunks(spark: SparkSession, root: str, commit: str) -> DataFrame:
    if not HASH.fullmatch(commit):
        raise ValueError(f"not a commit hash: {commit}")
    lines = git(root, "show", "-U0", "--format=", commit).split("\n")
    return spark.createDataFrame([(commit, i, x) for i, x in enumerate(lines)], "source string, n int, text string")


def parse_entry(text: str) -> dict:
    """A memory file: TOML between two +++ lines, then the content."""
    _, head, body = text.split(MARK, 2)
    return tomllib.loads(head) | {"content": body.strip("\n")}


def render_entry(entry: dict) -> str:
    keys = [k for k in entry if k != "content" and entry[k] is not None]
    head = "\n".join(f"{k} = {json.dumps(entry[k], ensure_ascii=False)}" for k in keys)
    return f"{MARK}\n{head}\n{MARK}\n{entry['content']}\n"


def project_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a folder of memory files; the files are the source of truth."""
    schema = SCHEMAS["project_memory"]
    names = [c.split()[0] for c in schema.split(", ")]
    lists = {"tags", "related_files", "related_symbols"}
    rows = [parse_entry(p.read_text()) for p in sorted(Path(folder).glob("*.md"))]
    return spark.createDataFrame([tuple(r.get(n, [] if n in lists else False if n == "pinned" else None) for n in names) for r in rows], schema)


def write_entry(folder: str, entry: dict) -> None:
    """One memory file, whole or not at all."""
    path = Path(folder, f"{entry['id']}.md")
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".tmp")
    new.write_text(render_entry(entry))
    os.replace(new, path)


def next_id(folder: str) -> str:
    taken = [int(m[1]) for p in Path(folder).glob("mem_*.md") if (m := re.match(r"mem_(\d+)", p.stem))]
    return f"mem_{max(taken, default=0) + 1:04d}"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["annotations"]).json(path)


def write_annotations(rows: DataFrame, folder: str) -> None:
    """The annotations as one file of JSON lines, whole or not at all. They are as many as people have written."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    lines = [r["line"] for r in rows.orderBy("path").select(F.to_json(F.struct(*rows.columns)).alias("line")).collect()]
    new = path / "annotations.json.tmp"
    new.write_text("".join(x + "\n" for x in lines))
    os.replace(new, path / "annotations.json")


def pathless(rel: str, root: str) -> str | None:
    """A path relative to root; None for one outside."""
    root = os.path.normpath(root)
    full = os.path.normpath(os.path.join(root, rel))
    return os.path.relpath(full, root) if full == root or full.startswith(root.rstrip("/") + "/") else None


def blame(spark: SparkSession, root: str, path: str, start: int, end: int) -> DataFrame:
    """(path, line, hash, author, ts) of the lines start to end."""
    text = git(root, "blame", "--porcelain", "-L", f"{start},{end}", "--", path)
    return parse_blame(spark, path, text)


def parse_blame(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Porcelain blame: heads are given once a commit and remembered."""
    rows, heads, now = [], {}, None
    for line in text.split("\n"):
        if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
            now = (m[1], int(m[2]))
            heads.setdefault(m[1], {})
        elif line.startswith("\t") and now:
            h = heads[now[0]]
            rows.append((path, now[1], now[0][:8], h.get("author"), int(h["author-time"]) if "author-time" in h else None))
        elif now and " " in line:
            key, _, value = line.partition(" ")
            heads[now[0]].setdefault(key, value)
    df = spark.createDataFrame(rows, "path string, line int, hash string, author string, seconds long")
    return df.withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")


def update_entry(folder: str, key: str, **changes: object) -> dict:
    """Change a memory file's fields; status can be set to active or archived."""
    if changes.get("status", "active") not in ("active", "archived"):
        raise ValueError("status is active or archived")
    entry = parse_entry(Path(folder, f"{key}.md").read_text()) | changes
    write_entry(folder, entry)
    return entry


def remove_entry(folder: str, key: str) -> None:
    Path(folder, f"{key}.md").unlink()


def hook_path(payload: str, root: str) -> str | None:
    """The edited file of an editor hook's JSON, relative to root; None if it is elsewhere or missing."""
    found = json.loads(payload).get("tool_input", {}).get("file_path")
    rel = pathless(found, root) if found else None
    return rel
