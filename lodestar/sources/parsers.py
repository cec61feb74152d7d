"""Source files as rows of symbols, imports, calls and comments.

Python is parsed by the standard library's ast, languages with braces by braces.py. Parsers run file by file in
mapInPandas, so a file is the unit of work and of retry.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import braces


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    comments: list[dict] = field(default_factory=list)
    module_doc: str | None = None


COMMENT = re.compile(r"^\s*(?://+!?|#|\*)\s?(?P<t>.*)$")


def python(text: str, path: str, file_id: str) -> Parsed:
    """Definitions, imports, calls and comments of Python; a file that doesn't parse gives its comments alone."""
    out = Parsed()
    out.comments = line_comments(text, "#")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out
    lines = text.split("\n")
    doc = ast.get_docstring(tree)
    out.module_doc = doc.split("\n\n")[0].replace("\n", " ")[:160] if doc else None

    def visit(node: ast.AST, parent: str | None, in_class: bool, scope: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                key = f"s:{file_id}:{child.lineno}:{child.name}"
                said = ast.get_docstring(child)
                out.symbols.append({
                    "id": key, "name": child.name, "kind": "class" if is_class else "method" if in_class else "function", "signature": lines[child.lineno - 1].strip()[:300],
                    "start": child.lineno, "end": child.end_lineno or child.lineno, "parent": parent, "exported": not child.name.startswith("_"), "doc": said.split("\n")[0][:120] if said else None,
                })
                visit(child, key, is_class, scope if is_class else child.lineno)
                continue
            if isinstance(child, ast.Import):
                out.imports += [{"import_path": a.name, "names": [], "line": child.lineno} for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.imports.append({"import_path": "." * child.level + (child.module or ""), "names": [a.name for a in child.names], "line": child.lineno})
            elif isinstance(child, ast.Call) and scope is not None:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.calls.append({"caller_line": scope, "callee": name, "is_method": isinstance(f, ast.Attribute)})
            visit(child, parent, in_class, scope)

    visit(tree, None, False, None)
    return out


def line_comments(text: str, sign: str) -> list[dict]:
    """Runs of comment lines: text, first and last line."""
    out: list[dict] = []
    for i, line in enumerate(text.split("\n"), 1):
        t = line.strip()
        if t.startswith(sign):
            body = COMMENT.match(t)
            said = body["t"].strip() if body else t
            if out and out[-1]["end_line"] == i - 1 and not re.match("(?i)todo|fixme|note|hack|xxx", said):
                out[-1] |= {"text": out[-1]["text"] + " " + said, "end_line": i}
            else:
                out.append({"text": said, "line": i, "end_line": i})
    return [c for c in out if c["text"]]


def with_braces(text: str, path: str, file_id: str, language: str) -> Parsed:
    """A file of a language with braces, see braces.py."""
    own = braces.SAME.get(language, language)
    scan = braces.scanned(text, own)
    comments = braces.grouped(scan)
    found = braces.definitions(scan, file_id, own)
    braces.attach_docs(scan, found, comments)
    symbols = [{k: s[k] for k in ("id", "name", "kind", "signature", "start", "end", "parent", "exported", "doc")} for s in found]
    said = [{k: c[k] for k in ("text", "line", "end_line")} for c in comments]
    return Parsed(symbols, braces.imports(scan, own), braces.calls(scan, found), said, braces.module_doc(scan, comments, own))


def parse(text: str, path: str, file_id: str, language: str) -> Parsed:
    if language == "python":
        return python(text, path, file_id)
    return with_braces(text, path, file_id, language) if braces.SAME.get(language, language) in braces.RULES else Parsed()


SHAPE = """path string, file_id string, symbols array<struct<id:string,name:string,kind:string,signature:string,start:int,end:int,parent:string,exported:boolean,doc:string>>,
imports array<struct<import_path:string,names:array<string>,line:int>>, calls array<struct<caller_line:int,callee:string,is_method:boolean>>, comments array<struct<text:string,line:int,end_line:int>>, module_doc string"""


def parsed(files: DataFrame) -> DataFrame:
    """One row a file of (path, id, language, content), as in SHAPE."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, file_id, language, content in zip(pdf.path, pdf.id, pdf.language, pdf.content, strict=True):
                p = parse(content or "", path, file_id, language)
                rows.append((path, file_id, p.symbols, p.imports, p.calls, p.comments, p.module_doc))
            yield pd.DataFrame(rows, columns=["path", "file_id", "symbols", "imports", "calls", "comments", "module_doc"])

    return files.select("path", "id", "language", "content").mapInPandas(run, SHAPE)


def symbol_rows(rows: DataFrame, languages: DataFrame, most: int = 10_000) -> DataFrame:
    """The symbols table of parsed() rows; ids once each, at most `most` a file."""
    s = rows.select("path", "file_id", F.posexplode("symbols").alias("pos", "s")).filter(F.col("pos") < most)
    s = s.join(languages.select("path", "language"), "path").withColumn("place", F.row_number().over(Window.partitionBy("s.id").orderBy("path"))).filter("place = 1")
    span = F.struct(F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    visibility = F.when(F.col("s.exported"), "public").otherwise("private")
    return s.select("s.id", "file_id", "s.name", "s.kind", "language", "path", "s.signature", span.alias("span"), F.col("s.parent").alias("parent_symbol_id"), "s.exported", visibility.alias("visibility"), F.col("s.doc").alias("doc_summary"), F.xxhash64("path", "pos").alias("ordinal"))


def comment_memories(rows: DataFrame) -> DataFrame:
    """Memories of marked comments (todo, fixme, note, hack, xxx), attached to the symbol they stand on."""
    from ..operators.memory import anchors

    c = rows.select("path", "symbols", F.explode("comments").alias("c")).withColumn("kind", C.comment_kind(F.col("c.text"))).filter("kind <> 'regular'")
    own = F.try_element_at(F.filter("symbols", lambda s: (s["start"] == F.col("c.end_line")) | (s["start"] == F.col("c.end_line") + 1)), F.lit(1))["id"]
    return c.select(
        F.concat_ws(":", F.lit("mem"), "path", "c.line").alias("id"), "path", "kind", F.col("c.text").alias("text"), anchors(F.col("c.text")).alias("anchors"),
        C.kind_weight(F.col("kind")).cast("float").alias("weight"), own.alias("symbol_id"), F.struct(F.col("c.line").alias("start"), F.col("c.end_line").alias("end")).alias("line_range"),
    )
