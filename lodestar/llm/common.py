"""What the corpus operators share: shared-folder tables, columns, word slices in Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at once; longer single texts are taken alone.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a local session makes one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    for made in _RECORDS:
        made.append(out)
    return out


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df, written to the shared folder as a table of buckets by a column: joins on it later move the other side alone."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}", f"lodestar_{uuid.uuid4().hex}"
    df.repartition(n, F.col(f"`{by}`")).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.saved_at, out.table = path, table
    for made in _RECORDS:
        made.append(out)
    return out


_RECORDS: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that saved() writes meanwhile, for forget()."""
    made: list[DataFrame] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def forget(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, when nothing reads them any more. One that is gone already stays gone."""
    for t in tables:
        spark = t.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if table := getattr(t, "table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark frees them when the driver's objects for them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores in front, so that no column of df has this name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df with c_before and c_total for each of sums: what rows in front of it (in this order) have, and all rows.

    Rows are dealt by ranges of the order and written; then a range's sums are the only rows that come together, and a
    running sum stays within a range. The order must tell all rows apart.
    """
    taken = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = taken.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])  # a row for each task
    front = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(front), F.lit(0)).alias(f"{c}_base") for c in sums], *[F.sum(f"_{c}").over(Window.partitionBy()).alias(f"{c}_total") for c in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = taken.join(F.broadcast(parts), "_part")
    rows = rows.withColumns({f"{c}_before": F.col(f"{c}_base") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    return rows.drop("_part", *[f"{c}_base" for c in sums])


def word_count(c: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


class Vocabulary(dict):
    """word -> place in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as large binary, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def slices(batch: pa.RecordBatch | pa.Table, text: str) -> Iterator[pa.RecordBatch | pa.Table]:
    """batch in runs of rows of at most SLICE_BYTES of text, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(binary(batch[text])).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of some texts, one after the other: their hashes, and where each text begins and ends."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        vocabulary = Vocabulary()
        places, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = (t.lower() if lower else t).split()  # bytes: ASCII white space and ASCII letters only
            counts[i] = len(own)
            places.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
        self.counts = counts
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.vocabulary = list(vocabulary)
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(vocabulary))
        self.hashes = table[self.places]
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.left = np.repeat(self.starts[1:], counts) - np.arange(len(self.places))  # words from here to the end of the text

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        table = np.fromiter((len(w.decode("utf-8", "replace")) for w in self.vocabulary), np.int64, len(self.vocabulary))
        return table[self.places]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on; the last n - 1 places have none."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
    return mix(out + np.uint64(n))
