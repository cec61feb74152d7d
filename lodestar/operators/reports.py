"""Statistics over an index: histograms, outlines, glossary, hotspots, naming, usage, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import CODE

#: Words too general for a glossary; a project passes its own.
GENERIC = ("get", "set", "new", "add", "the", "for", "with", "from", "test", "data", "value", "name", "item", "list", "map", "key", "call", "run", "make", "build", "init", "main", "util", "helper", "type", "self", "this")
TYPES = ("struct", "enum", "class", "interface", "trait", "type_alias")


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def primary_language(files: DataFrame, code: tuple[str, ...] = CODE) -> DataFrame:
    """One row: the code language with most files, the first of equals."""
    counts = language_histogram(files.filter(F.col("language").isin(*code)))
    return counts.orderBy(F.desc("files"), "language").limit(1)


def top_dirs(files: DataFrame, k: int) -> DataFrame:
    counts = files.groupBy(F.split("path", "/")[0].alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    return counts.orderBy(F.desc("files"), "dir").limit(k)


def outline(files: DataFrame, k: int) -> DataFrame:
    """(section, key, files): languages, top directories and entry points in one table."""
    languages = language_histogram(files).select(F.lit("language").alias("section"), F.col("language").alias("key"), "files")
    dirs = top_dirs(files, 2 * k).select(F.lit("dir").alias("section"), F.col("dir").alias("key"), "files")
    entry = files.filter(F.array_contains(C.file_tags(F.col("path")), "entrypoint")).orderBy("path").limit(k).select(F.lit("entrypoint").alias("section"), F.col("path").alias("key"), F.lit(1).cast("long").alias("files"))
    return languages.unionByName(dirs).unionByName(entry)


def status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(files, symbols, languages) in one row."""
    languages = language_histogram(files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages"))
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols"))).crossJoin(languages)


def architecture(files: DataFrame) -> DataFrame:
    """One row: what the directories say about a project's build, the first rule that holds."""
    has = lambda p: F.max(F.col("path").rlike(p))
    flags = files.agg(has("^(crates|packages|libs)/").alias("workspace"), has("^(services|apps)/").alias("services"), has("(^|/)(controllers|views|models)/").alias("mvc"), has("^src/").alias("src"))
    name = F.when(F.col("workspace"), "workspace").when(F.col("services"), "multi-service").when(F.col("mvc"), "layered").when(F.col("src"), "single package").otherwise("flat")
    return flags.select(name.alias("architecture"))


def naming_style(symbols: DataFrame) -> DataFrame:
    """One row: the styles that over a quarter of the styled names follow, with whole percents."""
    name = F.col("name")
    snake = name.contains("_") & (name == F.lower(name))
    camel = ~snake & name.rlike(r"^\p{Ll}") & name.rlike(r"\p{Lu}")
    pascal = ~snake & ~camel & name.rlike(r"^\p{Lu}")
    n = symbols.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(k) for c, k in ((snake, "snake"), (camel, "camel"), (pascal, "pascal"))])
    total = F.coalesce(F.col("snake") + F.col("camel") + F.col("pascal"), F.lit(0))
    shown = [F.when(F.col(k) > F.expr("(snake + camel + pascal) div 4"), F.concat(F.lit(label), F.lit(" ("), F.expr(f"{k} * 100 div (snake + camel + pascal)").cast("string"), F.lit("%)"))) for k, label in (("snake", "snake_case"), ("camel", "camelCase"), ("pascal", "PascalCase"))]
    text = F.concat_ws(", ", *shown)
    return n.select(F.when(total == 0, "unknown").when(text == "", "mixed").otherwise(text).alias("naming"))


def hotspots(rows: DataFrame, churn: DataFrame | None, k: int) -> DataFrame:
    """(name, path, lines, churn, score) of the k largest of rows (name, path, lines), times churn where given."""
    joined = rows.join(churn, "path", "left") if churn is not None else rows.withColumn("churn", F.lit(None).cast("long"))
    score = F.col("lines") * F.coalesce("churn", F.lit(1))
    return joined.select("name", "path", "lines", "churn", score.cast("double").alias("score")).orderBy(F.desc("score"), "path", "name").limit(k)


def glossary(symbols: DataFrame, k: int, generic: tuple[str, ...] = GENERIC, curated: dict[str, str] | None = None) -> DataFrame:
    """(term, symbols, files, source, meaning): words of names, plurals folded into their singular, by spread.

    A term needs three symbols and two files. Curated terms always stand in front.
    """
    words = F.filter(F.array_distinct(C.identifier_words(F.col("name"))), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*generic) & ~w.rlike("[0-9]"))
    rows = symbols.filter(~C.is_test_path(F.col("path"))).select("id", "path", F.explode(words).alias("word"))
    known = rows.select(F.col("word").alias("singular")).distinct()
    base = F.when(F.col("word").endswith("s") & (F.length("word") > 3), F.expr("substring(word, 1, length(word) - 1)"))
    rows = rows.withColumn("base", base).filter(~F.coalesce(F.col("base").isin(*generic), F.lit(False)))
    rows = rows.join(known, F.col("base") == F.col("singular"), "left").withColumn("term", F.coalesce("singular", "word"))
    found = rows.groupBy("term").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("files")).filter("symbols >= 3 and files >= 2")
    curated = curated or {}
    mined = found.filter(~F.col("term").isin(*curated)) if curated else found
    mined = mined.orderBy(F.desc(F.col("symbols") * F.col("files")), "term").limit(k).select("term", "symbols", "files", F.lit("usage").alias("source"), F.lit(None).cast("string").alias("meaning"))
    if not curated:
        return mined
    own = symbols.sparkSession.createDataFrame(list(curated.items()), "term string, meaning string").join(found, "term", "left")
    return own.select("term", "symbols", "files", F.lit("agent").alias("source"), "meaning").unionByName(mined)


def usage(events: DataFrame, rollup: bool = False) -> DataFrame:
    """(command, calls, bytes_served, raw_baseline, file_backed, pathless, unmeasured, ratio) of usage events.

    A null baseline is unmeasured, 0 is one without a path; rollup adds the total under a null command.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    raw = F.col("raw_baseline")
    grouped = events.rollup("command") if rollup else events.groupBy("command")
    out = grouped.agg(
        F.count(F.lit(1)).alias("calls"), F.sum("bytes_served").alias("bytes_served"), F.coalesce(F.sum("raw_baseline"), F.lit(0)).alias("raw_baseline"),
        one(raw > 0).alias("file_backed"), one(raw == 0).alias("pathless"), one(raw.isNull()).alias("unmeasured"),
        F.coalesce(F.sum(F.when(raw.isNotNull(), F.col("bytes_served"))), F.lit(0)).alias("measured"),
    )
    return out.withColumn("ratio", F.round(C.compression_ratio(F.col("raw_baseline"), F.col("measured")), 6))


def canonical_paths(files: DataFrame) -> DataFrame:
    """(id, path): the first path of each content."""
    return files.groupBy("id").agg(F.min("path").alias("path"))


def fingerprint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, removed, changed, unchanged between (path, hash) tables."""
    joined = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full")
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return joined.select("path", state.alias("state"))


def jsonl(**tables: DataFrame) -> DataFrame:
    """(line): each row of each table as JSON under its `type`, for write.text."""
    out = None
    for kind, rows in tables.items():
        lines = rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(f"`{c}`") for c in rows.columns if c != "type"])).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def annotation_queue(files: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """(path, score): files without a purpose, most imported first, entry points five up."""
    degree = relations.filter("kind = 'imports'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    score = F.coalesce("n", F.lit(0)) + F.when(F.array_contains(C.file_tags(F.col("path")), "entrypoint"), 5).otherwise(0)
    return files.filter("purpose is null").join(degree, "id", "left").select("path", score.cast("long").alias("score")).orderBy(F.desc("score"), "path").limit(k)


def apply_annotations(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """files with purpose and its source: the file's own doc, else an annotation, stale if the content changed since."""
    a = annotations.select("path", F.col("purpose").alias("said"), "content_hash")
    rows = files.join(a, "path", "left")
    own = F.col("purpose_source") == "doc"
    source = F.when(own, "doc").when(F.col("said").isNotNull(), F.when(F.col("content_hash") == F.col("hash"), "agent").otherwise("agent-stale"))
    return rows.withColumns({"purpose": F.when(own, F.col("purpose")).otherwise(F.col("said")), "purpose_source": source}).select(*files.columns)


def raw_baseline(results: DataFrame, files: DataFrame) -> DataFrame:
    """(id, raw_bytes): the sizes of the distinct files whose paths a JSON result names."""
    paths = F.array_distinct(F.regexp_extract_all("json", F.lit(r'"path"\s*:\s*"([^"]+)"'), F.lit(1)))
    return results.select("id", F.explode(paths).alias("path")).join(files.select("path", "size"), "path").groupBy("id").agg(F.sum("size").alias("raw_bytes"))


def case_scores(results: DataFrame) -> DataFrame:
    """(id, score) of retrieval cases: 50 must, 15 should, 20 efficiency, 10 off an irrelevant file, 3 and 2 off for limits."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    efficiency = F.when(F.col("selected_files") > 0, (F.col("must_include_found") + F.col("should_include_found")) / F.col("selected_files")).otherwise(0.0)
    score = 50 * share("must_include_found", "must_include_total") + 15 * share("should_include_found", "should_include_total") + 20 * F.least(efficiency, F.lit(1.0)) - 10 * F.col("irrelevant_found") - F.when(F.col("files_within_limit"), 0).otherwise(3) - F.when(F.col("bytes_within_limit"), 0).otherwise(2)
    return results.select("id", F.round(score, 3).alias("score"))


PURPOSE_CHARS = 300


def upsert_annotation(annotations: DataFrame, path: str, purpose: str, content_hash: str, at: str, terms: dict[str, str] | None = None) -> DataFrame:
    """annotations with one file's purpose set or replaced; its terms are added to those it has."""
    if not purpose.strip() or len(purpose) > PURPOSE_CHARS:
        raise ValueError(f"a purpose has 1 to {PURPOSE_CHARS} characters")
    spark = annotations.sparkSession
    new = spark.createDataFrame([(path, purpose.strip(), terms or {}, content_hash, at)], "path string, purpose string, terms map<string,string>, content_hash string, annotated_at string")
    known = annotations.filter(F.col("path") == path).select("path", F.col("terms").alias("before"))
    own = new.join(known, "path", "left").withColumn("terms", F.map_zip_with(F.coalesce("before", F.create_map().cast("map<string,string>")), "terms", lambda k, a, b: F.coalesce(b, a)))
    return annotations.filter(F.col("path") != path).unionByName(own.select(*annotations.columns))


def without_annotation(annotations: DataFrame, path: str) -> DataFrame:
    return annotations.filter(F.col("path") != path)


def capped(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows in this order, with `note`: what is left out, null where nothing is."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    note = F.when(F.col("_n") > k, F.concat(F.lit(f"showing {k} of "), F.col("_n").cast("string")))
    return rows.orderBy(*order).limit(k).crossJoin(F.broadcast(n)).withColumn("note", note).drop("_n")


def export_counts(**tables: DataFrame) -> DataFrame:
    """(type, rows) of what jsonl() writes."""
    out = None
    for kind, rows in tables.items():
        n = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("type"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def per_key(rows: DataFrame, by: str, order: Column, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("place") <= k).drop("place")
