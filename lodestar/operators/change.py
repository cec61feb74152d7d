"""What a diff touches: interval joins of spans and hunks, tests to run, symbols without tests, a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import graph


def overlapping(spans: DataFrame, hunks: DataFrame, by: str = "path") -> DataFrame:
    """spans (by, start, end) that a hunk (by, h_start, h_end) of the same `by` touches: an equi join with a range filter."""
    return spans.join(hunks, by).filter((F.col("start") <= F.col("h_end")) & (F.col("end") >= F.col("h_start")))


def innermost(spans: DataFrame, points: DataFrame, by: str = "path") -> DataFrame:
    """For each point (by, line) the shortest span around it; of equal ones the later start, then the smaller id."""
    inside = points.join(spans, by).filter((F.col("start") <= F.col("line")) & (F.col("end") >= F.col("line")))
    order = Window.partitionBy(by, "line").orderBy(F.col("end") - F.col("start"), F.desc("start"), "id")
    return inside.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def unified_diff(lines: DataFrame) -> DataFrame:
    """(path, start, end) from diff lines (source, n, text): the new side's ranges, a pure deletion as one line.

    The path of a hunk is the last +++ line in front of it in its source.
    """
    order = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1)
    rows = lines.withColumn("path", F.last(F.when(path != "", path), ignorenulls=True).over(order))
    at = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    rows = rows.filter(F.col("text").rlike(at) & F.col("path").isNotNull())
    start, count = F.regexp_extract("text", at, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("text", at, 2), F.lit("")).cast("int"), F.lit(1))
    return rows.select("path", F.greatest(start, F.lit(1)).alias("start"), F.when(count == 0, F.greatest(start, F.lit(1))).otherwise(start + count - 1).alias("end"))


def stack_frames(traces: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, place, path, line): frames of stack traces in order of first appearance."""
    ext = "rs|ts|tsx|js|jsx|mjs|cjs|py|go|java|kt|cs|c|h|cc|cpp|hpp|rb|php|swift|scala"
    python, plain = r'File "([^"]+)", line ([0-9]+)', rf"([A-Za-z0-9_./\\-]+\.(?:{ext})):([0-9]+)"
    both = F.regexp_extract_all(text, F.lit(f"(?:{python})|(?:{plain})"), F.lit(0))
    rows = traces.select(id_, F.posexplode(both).alias("pos", "m"))
    path = F.coalesce(F.nullif(F.regexp_extract("m", python, 1), F.lit("")), F.regexp_extract("m", plain, 1))
    line = F.coalesce(F.nullif(F.regexp_extract("m", python, 2), F.lit("")), F.regexp_extract("m", plain, 2)).cast("int")
    rows = rows.withColumns({"path": path, "line": line}).groupBy(id_, "path", "line").agg(F.min("pos").alias("pos"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(id_).orderBy("pos"))).drop("pos")


def frame_weight(place: Column) -> Column:
    return 1 - F.least((place - 1) * 0.05, F.lit(0.5))


def smart_tests(changed: DataFrame, symbols: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): tests for changed symbols: paired files, tests that call them, tests beside them."""
    ids = files.select(F.col("id").alias("fid"), F.col("path").alias("fpath"))
    pairs = relations.filter("kind = 'test_for'").join(ids, F.col("source_id") == F.col("fid")).select(F.col("fpath").alias("test"), "target_id").join(ids, F.col("target_id") == F.col("fid")).select("test", F.col("fpath").alias("path"))
    paired = pairs.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("test").alias("path"), F.lit("paired").alias("reason"))
    tests = symbols.filter(C.is_test_path(F.col("path")))
    calls = relations.filter("kind = 'calls'").join(changed.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    calling = tests.join(calls.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").select("path", F.lit("calls").alias("reason"))
    dirs = changed.select(C.dir_of(F.col("path")).alias("dir")).distinct()
    beside = tests.withColumn("dir", C.dir_of(F.col("path"))).join(dirs, "dir", "left_semi").select("path", F.lit("beside").alias("reason"))
    order = F.when(F.col("reason") == "paired", 0).when(F.col("reason") == "calls", 1).otherwise(2)
    return paired.unionByName(calling).unionByName(beside).groupBy("path").agg(F.min_by("reason", order).alias("reason"))


def untested(changed: DataFrame, symbols: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """Changed functions and methods without evidence of a test: no paired file, no test in the file, none that calls them."""
    tests = graph.test_symbols(symbols)
    ids = files.select(F.col("id").alias("target_id"), "path")
    paired = relations.filter("kind = 'test_for'").join(ids, "target_id").select("path").distinct()
    called = relations.filter("kind = 'calls'").join(tests.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    rows = changed.filter(F.col("kind").isin("function", "method")).join(tests.select("id"), "id", "left_anti")
    return rows.join(paired, "path", "left_anti").join(tests.select("path").distinct(), "path", "left_anti").join(called, "id", "left_anti")


def contract_changes(changed: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, name, path) of changed exported symbols whose head, their first line, a hunk (path, start, end) touches."""
    at = changed.filter("exported").select("id", "name", "path", F.col("span.start_line").alias("line"))
    ranges = hunks.select("path", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    return at.join(ranges, "path").filter(F.col("line").between(F.col("h_start"), F.col("h_end"))).select("id", "name", "path").distinct()


def affected_with_reasons(relations: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, id, depth, via): graph.affected() with the kind of edge that leads a step nearer, the strongest of several."""
    edges = relations.filter(F.col("kind").isin("calls", "imports", "test_for")).select(F.col("source_id").alias("id"), F.col("target_id").alias("next"), "kind")
    hit = graph.affected(graph.dependency_edges(relations), seeds, depth)
    nearer = hit.select("seed", F.col("id").alias("next"), F.col("depth").alias("before")).unionByName(seeds.select("seed", F.col("id").alias("next"), F.lit(0).alias("before")))
    rank = F.when(F.col("kind") == "calls", 0).when(F.col("kind") == "imports", 1).otherwise(2)
    steps = hit.join(edges, "id").join(nearer, ["seed", "next"]).filter(F.col("before") == F.col("depth") - 1)
    return steps.groupBy("seed", "id", "depth").agg(F.min_by("kind", rank).alias("via"))


def verify_change(hunks: DataFrame, symbols: DataFrame, relations: DataFrame, files: DataFrame, commit_files: DataFrame, depth: int = 3) -> DataFrame:
    """One row: changed symbols, contracts among them, blast radius, tests, untested symbols, missing companions, risk, summary.

    clean: nothing is missing, untested or at high risk. Without a hunk the summary says so and the row is clean.
    """
    from . import history

    spans = symbols.withColumns({"start": F.col("span.start_line"), "end": F.col("span.end_line")})
    changed = overlapping(spans, hunks.select("path", F.col("start").alias("h_start"), F.col("end").alias("h_end"))).select(*symbols.columns).dropDuplicates(["id"])
    changed = graph.cut(changed)
    seeds = changed.select(F.lit("diff").alias("seed"), "id")
    radius = graph.affected(graph.dependency_edges(relations), seeds, depth).join(changed.select("id"), "id", "left_anti")
    tests = smart_tests(changed, symbols, relations, files)
    missing = history.missing_co_changes(commit_files, hunks.select("path"))
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    row = n(hunks.select("path").distinct(), "files").crossJoin(n(changed, "changed")).crossJoin(n(contract_changes(changed, hunks), "contracts")).crossJoin(n(radius, "affected")).crossJoin(n(tests, "tests"))
    row = row.crossJoin(n(untested(changed, symbols, relations, files), "untested")).crossJoin(n(missing, "missing_co_changes"))
    base = C.risk_level(F.col("affected"), F.col("tests"))
    raised = F.when((F.col("untested") > 0) | (F.col("missing_co_changes") > 0), F.when(base == "LOW", "MEDIUM").otherwise("HIGH")).otherwise(base)
    row = row.withColumn("risk", raised)
    clean = (F.col("untested") == 0) & (F.col("missing_co_changes") == 0) & (F.col("risk") != "HIGH")
    said = F.format_string("%d symbols changed in %d files, %d affected, %d tests to run, %d without a test; risk %s", "changed", "files", "affected", "tests", "untested", "risk")
    return row.withColumns({"clean": clean, "summary": F.when(F.col("files") == 0, "no changes").otherwise(said)})
