"""Commit statistics: churn, co-change, partners that a change set lacks, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, MOST_FILES, LEAST_PAIRS = 500, 50, 2
LEAST_FILE_COMMITS, LEAST_CONFIDENCE, PARTNERS = 3, 0.5, 5
UBIQUITY_COMMITS, UBIQUITOUS_SHARE = 20, 0.3
#: Files that change with everything and say nothing.
LOCKFILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "Gemfile.lock", "composer.lock")


def commit_counts(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("path").agg(F.countDistinct("hash").alias("churn"))


def high_churn(counts: DataFrame, times: int = 2) -> DataFrame:
    """Paths whose churn is over `times` the integer mean. The mean is one row."""
    mean = counts.agg((F.expr("sum(churn) div count(*)")).alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).filter(F.col("churn") > times * F.col("mean"))


def recent(commits: DataFrame, n: int = WINDOW) -> DataFrame:
    return commits.orderBy(F.desc("ts"), F.desc("hash")).limit(n)


def small_commits(commit_files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(hash, path) of commits of at most `most` files: counts first, so that a huge commit is never gathered."""
    files = commit_files.select("hash", "path").distinct()
    small = files.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("hash")
    return files.join(small, "hash")


def co_change_pairs(commit_files: DataFrame, least: int = LEAST_PAIRS, most: int = MOST_FILES) -> DataFrame:
    """(a, b, together), a < b: a commit gives at most most * (most - 1) / 2 pairs."""
    own = small_commits(commit_files, most)
    pairs = own.withColumnRenamed("path", "a").join(own.withColumnRenamed("path", "b"), "hash").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least)


def partners(pairs: DataFrame) -> DataFrame:
    """(path, partner, together), both ways."""
    return pairs.select(F.col("a").alias("path"), F.col("b").alias("partner"), "together").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("partner"), "together"))


def missing_co_changes(commit_files: DataFrame, changed: DataFrame, most_files: int = MOST_FILES, least_commits: int = LEAST_FILE_COMMITS, least_confidence: float = LEAST_CONFIDENCE, present: DataFrame | None = None) -> DataFrame:
    """(file, co_changed_with, count, confidence): usual companions of changed paths (path) that are not changed as well."""
    own = small_commits(commit_files, most_files)
    commits = own.agg(F.countDistinct("hash").alias("commits"))
    counts = own.groupBy("path").agg(F.count(F.lit(1)).alias("own"))
    with_commits = counts.crossJoin(F.broadcast(commits))
    everywhere = with_commits.filter((F.col("commits") >= UBIQUITY_COMMITS) & (F.col("own") > F.col("commits") * UBIQUITOUS_SHARE)).select(F.col("path").alias("partner"))
    changed = changed.select("path").distinct()
    mine = own.join(changed, "path", "left_semi")
    pairs = mine.join(own.withColumnRenamed("path", "partner"), "hash").filter("path <> partner").groupBy("path", "partner").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= LEAST_PAIRS)
    rows = pairs.join(counts.filter(F.col("own") >= least_commits), "path").withColumn("confidence", F.col("count") / F.col("own"))
    rows = rows.filter(F.col("confidence") >= least_confidence).join(changed.withColumnRenamed("path", "partner"), "partner", "left_anti").join(everywhere, "partner", "left_anti")
    rows = rows.filter(~F.substring_index(F.col("partner").cast("string"), "/", -1).isin(*LOCKFILES))
    rows = rows.join(present.select(F.col("path").alias("partner")), "partner", "left_semi") if present is not None else rows
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("count"), "partner"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= PARTNERS)
    return rows.select(F.col("partner").alias("file"), F.col("path").alias("co_changed_with"), "count", F.round("confidence", 2).alias("confidence"))


def file_history(commits: DataFrame, commit_files: DataFrame, path: str, n: int) -> DataFrame:
    """(hash, ts, author, message, introduced) of a path, newest first; introduced: the first commit that added it."""
    rows = commits.join(commit_files.filter(F.col("path") == path).select("hash", "status"), "hash")
    first = rows.filter("status = 'A'").agg(F.min_by("hash", F.struct("ts", "hash")).alias("first"))
    return rows.crossJoin(F.broadcast(first)).withColumn("introduced", F.coalesce(F.col("hash") == F.col("first"), F.lit(False))).drop("first", "status").orderBy(F.desc("ts"), "hash").limit(n)


def symbol_history(commits: DataFrame, commit_hunks: DataFrame, path: str, start: int, end: int, n: int) -> DataFrame:
    """(hash, ts, author, message) of commits with a hunk (hash, path, start, end) in these lines of a path, newest first.

    Lines are those of each commit's own state, as a history by line ranges has them.
    """
    hit = commit_hunks.filter((F.col("path") == path) & (F.col("start") <= end) & (F.col("end") >= start)).select("hash").distinct()
    return commits.join(hit, "hash", "left_semi").orderBy(F.desc("ts"), "hash").limit(n)


def timeline(commits: DataFrame, commit_files: DataFrame, decisions: DataFrame, path: str) -> DataFrame:
    """(ts, event, text): a path's first commit as introduced, the others as commits, decisions that name it, and high churn.

    decisions: (ts, text, anchors, path). A path's churn is high over twice the mean; it is told at the path's last commit.
    """
    rows = commits.join(commit_files.filter(F.col("path") == path).select("hash").distinct(), "hash", "left_semi")
    ends = rows.agg(F.min_by("hash", F.struct("ts", "hash")).alias("first"), F.max("ts").alias("last"))
    event = F.when(F.col("hash") == F.col("first"), "introduced").otherwise("commit")
    own = rows.crossJoin(F.broadcast(ends)).select("ts", event.alias("event"), F.col("message").alias("text"))
    busy = high_churn(commit_counts(commit_files)).filter(F.col("path") == path)
    churned = busy.crossJoin(F.broadcast(ends)).select(F.col("last").alias("ts"), F.lit("high churn").alias("event"), F.concat(F.col("churn").cast("string"), F.lit(" commits")).alias("text"))
    name = path.rsplit("/", 1)[-1].lower()
    said = decisions.filter((F.col("path") == path) | F.exists("anchors", lambda a: F.lit(name).contains(a))).select("ts", F.lit("decision").alias("event"), "text")
    return own.unionByName(churned).unionByName(said).orderBy(F.desc("ts"), "event", "text")


def first_of_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, in each `by`: blame lines with runs of one commit folded."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("before", before).filter(~F.col(value).eqNullSafe(F.col("before")) | F.col("before").isNull()).drop("before")
