"""Project memory and documents: search with reasons to boost, inverted index, conflicts, sections, rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import STOP_WORDS

#: What a rationale item of a kind gains.
RATIONALE_BONUS = {"decision": 0.2, "fixme": 0.15, "todo": 0.1, "note": 0.05}


def search(entries: DataFrame, text: str, k: int, files: list[str] | None = None, names: list[str] | None = None, kind: str | None = None, tag: str | None = None, pinned: bool = False, status: str = "active") -> DataFrame:
    """entries with `score`, best first: shares of query words in content, title and tags, bonuses for kind, pin and context."""
    words = text.lower().split()
    rows = entries.filter(F.col("status") == status)
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.filter(F.array_contains("tags", tag)) if tag else rows
    rows = rows.filter("pinned") if pinned else rows
    by_file = C.any_of([overlaps(f) for f in files or []])
    by_name = F.arrays_overlap("related_symbols", F.array(*map(F.lit, names))) if names else F.lit(False)
    context = F.when(by_file, 0.3).otherwise(0.0) + F.when(by_name, 0.3).otherwise(0.0)
    if not words:
        score = F.when(F.col("pinned"), 1.0).otherwise(0.5) + context
        return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(k)
    content, title = F.lower("content"), F.lower(F.coalesce("title", F.lit("")))
    one = lambda c: F.when(c, 1).otherwise(0)
    hits = sum((one(content.contains(w) | title.contains(w)) + one(in_any("tags", w)) for w in words), F.lit(0))
    score = hits / len(words) + F.when(F.col("kind") == "warning", 0.15).when(F.col("kind") == "decision", 0.1).otherwise(0.0) + F.when(F.col("pinned"), 0.2).otherwise(0.0) + context
    score = score + F.when(C.any_of([in_any("related_files", w) for w in words]), 0.1).otherwise(0.0) + F.when(C.any_of([in_any("related_symbols", w) for w in words]), 0.1).otherwise(0.0)
    return rows.filter((hits > 0) | by_file | by_name).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(k)


def overlaps(path: str) -> Column:
    return F.exists("related_files", lambda r: C.paths_overlap(r, F.lit(path)))


def in_any(column: str, word: str) -> Column:
    return F.exists(column, lambda x: F.lower(x).contains(word))


def postings(entries: DataFrame) -> DataFrame:
    """(term, id): the inverted index."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "content")
    return entries.select(F.explode(C.memory_terms(text, STOP_WORDS)).alias("term"), "id").distinct()


def candidates(index: DataFrame, text: str) -> DataFrame:
    """(id): entries with a term that is or begins with a query term."""
    terms = [w for w in text.lower().split() if len(w) >= 3 and w not in STOP_WORDS]
    return index.filter(C.any_of([F.col("term").startswith(t) for t in terms])).select("id").distinct()


def conflicts(entries: DataFrame) -> DataFrame:
    """(signal, ids): active entries that speak of one symbol with different contents; superseded ones don't count."""
    active = entries.filter("status = 'active'")
    gone = active.filter("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    rows = active.join(gone, "id", "left_anti").select("id", "content", F.explode("related_symbols").alias("symbol"))
    unique = rows.groupBy("symbol", F.md5("content").alias("c")).agg(F.min("id").alias("id"))
    found = unique.groupBy("symbol").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") >= 2)
    return found.select(F.concat(F.lit("symbol:"), F.col("symbol").cast("string")).alias("signal"), "ids")


def listing(entries: DataFrame, k: int) -> DataFrame:
    return entries.orderBy(F.desc("pinned"), F.desc("updated_at"), "id").limit(k)


def shaped(found: DataFrame, full_from: float = 0.45, excerpt: int = 160) -> DataFrame:
    """Whole content for good hits, an excerpt for the others."""
    return found.withColumn("content", F.when(F.col("score") >= full_from, F.col("content")).otherwise(C.truncate(F.col("content"), excerpt)))


def anchors(text: Column) -> Column:
    """Sorted distinct anchors: words of three letters or more, parts of camel-case words, identifiers in backticks."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r"`([\p{L}\p{N}_.]{2,})`"), F.lit(1)), F.lower)
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 3)
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(w, r"(?<=\p{Ll})(?=\p{Lu})"))), lambda p: F.octet_length(p) >= 3)
    found = F.filter(F.transform(F.concat(words, parts), F.lower), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(quoted, found)))


def doc_sections(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, section, header, body, start_line, end_line, kind, weight): documents cut at # headers.

    Lines are numbered within their document; a running count of headers is the section.
    """
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    line = F.trim("line")
    rows = lines.withColumns({"trimmed": line, "head": line.startswith("#").cast("int")})
    rows = rows.withColumn("section", F.sum("head").over(Window.partitionBy("path").orderBy("pos")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("head") == 0) & (F.col("trimmed") != ""), F.struct("pos", "trimmed")))), lambda x: x["trimmed"]), " ")
    header = F.max(F.when(F.col("head") == 1, F.trim(F.regexp_replace("trimmed", "^#+", ""))))
    found = rows.groupBy("path", "section").agg(F.coalesce(header, F.lit("")).alias("header"), body.alias("body"), (F.min("pos") + 1).cast("long").alias("start_line"), (F.max("pos") + 1).cast("long").alias("end_line"))
    decides = F.lower("path").rlike("adr/|decisions/|decision-records/") & F.lower("header").rlike("^(decisions?|decision:.*|chosen alternative|outcome)$")
    kind = F.when(decides, "decision").otherwise("doc_section")
    found = found.filter(F.octet_length("body") >= 10).withColumn("kind", kind)
    return found.select("path", "section", "header", C.truncate(F.col("body"), 500).alias("body"), "start_line", "end_line", "kind", C.kind_weight(kind).alias("weight"))


def rationale(memories: DataFrame, query_anchors: list[str], k: int) -> DataFrame:
    """memories (id, kind, anchors, weight) with `relevance`: the share of query anchors they touch, and a bonus, by weight."""
    if not query_anchors or not k:
        return memories.withColumn("relevance", F.lit(0.0)).limit(0)
    touched = sum((F.when(touches(q), 1).otherwise(0) for q in query_anchors), F.lit(0))
    bonus = F.lit(0.0)
    for kind, b in RATIONALE_BONUS.items():
        bonus = F.when(F.col("kind") == kind, b).otherwise(bonus)
    score = (touched / len(query_anchors) + bonus) * F.col("weight")
    return memories.filter(touched > 0).withColumn("relevance", F.round(score, 6)).orderBy(F.desc("relevance"), "id").limit(k)


def touches(anchor: str) -> Column:
    return F.exists("anchors", lambda a: a.contains(anchor) | F.lit(anchor).contains(a))
