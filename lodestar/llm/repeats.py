"""Which values occur twice or more in the corpus: numpy on packed chunks, shared by the two repeat removers.

Documents are dealt into chunks of some megabytes by a hash. A chunk sends its distinct values, packed into one binary
for each value bucket; a bucket finds the values that more than one chunk has, or one chunk twice; each chunk gets its
own repeated values back. So a value is sent once a chunk, however often it occurs there, rows are few and large, and
both chunk and bucket are bounded by the counts chosen from the corpus size.

As chunks and buckets both grow with the corpus, their rows would shrink to single values beyond some hundred GB. From
where a row would hold under ROW_VALUES values, they go in two rounds: chunks send to few coarse buckets, tasks of GROUP
chunks each merge these and send on to the buckets, and answers come back the same way. The result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, text_bytes

CHUNK_BYTES = 4 << 20
#: Values a bucket gets, about; and the least number of chunks and of buckets, so that small inputs spread as well.
BUCKET_VALUES = 1 << 21
LEAST = 64
#: Values that a row from a chunk to a bucket holds at least, about, or else chunks are merged first; and how many at once.
ROW_VALUES = 64
GROUP = 256

NARROW, WIDE = np.uint32, np.uint64
REPEATED, MARKED = 1, 2
REST = np.uint64((1 << 30) - 1)


class Plan:
    """How many chunks and buckets a corpus gets; coarse: how many buckets the first of two rounds has, 0 for one round."""

    def __init__(self, df: DataFrame, text: str):
        size = text_bytes(df, text)
        self.chunks = max(LEAST, -(-size // CHUNK_BYTES))
        self.buckets = max(LEAST, -(-size // (6 * BUCKET_VALUES)))
        self.group = GROUP
        short = CHUNK_BYTES // 6 < ROW_VALUES * self.buckets
        self.coarse = min(self.buckets, max(1, GROUP * CHUNK_BYTES // 6 // BUCKET_VALUES)) if short else 0

    def fine(self, g: np.ndarray, kind: type) -> np.ndarray:
        """The bucket of each key."""
        return (g % np.uint64(self.buckets) if kind is WIDE else g >> np.uint64(30)).astype(np.int64)


def chunked(df: DataFrame, plan: Plan, row_id: str, text: str) -> DataFrame:
    """(chunk, id, key, text): each document in the chunk of its hash; key is a hash of the text."""
    body = F.col(f"`{text}`")
    key = F.xxhash64(F.coalesce(body, F.lit("")))
    chunk = F.pmod(F.xxhash64(F.col(f"`{row_id}`"), key), F.lit(plan.chunks)).cast("int")
    return df.select(chunk.alias("chunk"), F.col(f"`{row_id}`").alias("id"), key.alias("key"), body.alias("text"))


def words_of(table: pa.Table) -> Words:
    return Words(binary(table["text"]).to_pylist())


def keys(h: np.ndarray, plan: Plan, kind: type) -> np.ndarray:
    """What a value is known by: all but two of its bits, or for NARROW its bucket and 30 more bits."""
    g, buckets = h >> np.uint64(2), np.uint64(plan.buckets)
    return g if kind is WIDE else ((g % buckets) << np.uint64(30)) | ((g // buckets) & REST)


def cut(bucket: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, values) for each run of equal buckets."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((cuts[1:], [len(bucket)]))
    return [(int(bucket[a]), values[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]


def by_bucket(own: np.ndarray, flags: np.ndarray, plan: Plan, kind: type) -> list[tuple[int, bytes]]:
    """Distinct keys with their two flag bits, by bucket."""
    bucket = plan.fine(own, kind)
    by = np.argsort(bucket, kind="stable")
    own, flags, bucket = own[by], flags[by], bucket[by]
    own = own if kind is WIDE else own & REST
    return cut(bucket, ((own << np.uint64(2)) | flags).astype(kind))


def packed(h: np.ndarray, marks: np.ndarray | None, plan: Plan, kind: type) -> list[tuple[int, bytes]]:
    """(bucket, distinct values with two flag bits) of a chunk's values; coarse buckets and whole keys where there are two rounds."""
    if not len(h):
        return []
    own = keys(h, plan, kind)
    order = np.argsort(own, kind="stable")
    own = own[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    flags = (np.diff(np.concatenate((starts, [len(own)]))) > 1).astype(np.uint64) * np.uint64(REPEATED)
    if marks is not None:
        flags |= np.logical_or.reduceat(marks[order], starts).astype(np.uint64) * np.uint64(MARKED)
    own = own[starts]
    if not plan.coarse:
        return by_bucket(own, flags, plan, kind)
    bucket = plan.fine(own, kind) % plan.coarse
    by = np.argsort(bucket, kind="stable")
    return cut(bucket[by], ((own << np.uint64(2)) | flags)[by])


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("values", pa.binary())])


def sent(chunk: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_pydict({"bucket": [b for b, _ in parts], "chunk": [chunk] * len(parts), "values": [v for _, v in parts]}, SENT)


def repeated(values: DataFrame, plan: Plan, kind: type, marked: bool) -> DataFrame:
    """(bucket, chunk, values): of each chunk the values that occur twice or more anywhere; marked: at least once with a mark."""
    if not plan.coarse:
        return counted(values, kind, marked)
    group = lambda d: d.withColumn("crowd", F.expr(f"chunk div {plan.group}"))

    def merge(table: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint64)
        v = v[np.argsort(v >> np.uint64(2), kind="stable")]
        own = v >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        flags = np.bitwise_or.reduceat(v & np.uint64(3), starts)
        flags |= (np.diff(np.concatenate((starts, [len(own)]))) > 1).astype(np.uint64) * np.uint64(REPEATED)
        return sent(table["crowd"][0].as_py(), by_bucket(own[starts], flags, plan, kind))

    sent_ = group(values)
    merged = sent_.groupBy("bucket", "crowd").applyInArrow(merge, "bucket int, chunk int, values binary")
    hits = counted(merged, kind, marked).withColumnRenamed("chunk", "crowd").withColumn("coarse", F.pmod("bucket", F.lit(plan.coarse)))

    def answer(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return sent(0, [])
        there = whole_keys(found, kind)
        rows = {"bucket": [], "chunk": [], "values": []}
        for bucket, chunk, blob in zip(*(table[c].to_pylist() for c in ("bucket", "chunk", "values")), strict=True):
            own = np.frombuffer(blob, np.uint64) >> np.uint64(2)
            own = own[among(own, there)]
            if len(own):
                for c, x in (("bucket", bucket), ("chunk", chunk), ("values", own.tobytes())):
                    rows[c].append(x)
        return pa.Table.from_pydict(rows, SENT)

    return sent_.groupBy("bucket", "crowd").cogroup(hits.groupBy("coarse", "crowd")).applyInArrow(answer, "bucket int, chunk int, values binary")


def counted(values: DataFrame, kind: type, marked: bool) -> DataFrame:
    """repeated() in one round."""

    def reduce(table: pa.Table) -> pa.Table:
        blobs = table["values"].to_pylist()
        bucket = table["bucket"][0].as_py()
        all_values = np.frombuffer(b"".join(blobs), kind)
        owner = np.repeat(np.arange(len(blobs)), [len(b) // np.dtype(kind).itemsize for b in blobs])
        flags = (all_values & kind(3)).astype(np.uint8)
        own = all_values >> kind(2)
        order = np.argsort(own, kind="stable")
        own, owner, flags = own[order], owner[order], flags[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.concatenate((starts, [len(own)])))
        any_flags = np.bitwise_or.reduceat(flags, starts)
        good = (counts > 1) | ((any_flags & REPEATED) > 0)
        if marked:
            good &= (any_flags & MARKED) > 0
        hit = np.repeat(good, counts)
        own, owner = own[hit], owner[hit]
        by = np.argsort(owner, kind="stable")
        own, owner = own[by], owner[by]
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
        ends = np.concatenate((cuts[1:], [len(owner)])) if len(owner) else cuts
        chunks = table["chunk"].to_pylist()
        rows = [(chunks[owner[a]], own[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)]
        return pa.Table.from_pydict({"bucket": [bucket] * len(rows), "chunk": [c for c, _ in rows], "values": [v for _, v in rows]}, SENT)

    return values.groupBy("bucket").applyInArrow(reduce, "bucket int, chunk int, values binary")


def whole_keys(table: pa.Table, kind: type) -> np.ndarray:
    """The sorted keys of counted() rows."""
    out = []
    for bucket, blob in zip(table["bucket"].to_pylist(), table["values"].to_pylist(), strict=True):
        v = np.frombuffer(blob, kind).astype(np.uint64)
        out.append(v if kind is WIDE else (np.uint64(bucket) << np.uint64(30)) | v)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def known(table: pa.Table, plan: Plan, kind: type) -> np.ndarray:
    """The sorted keys that repeated() gave a chunk."""
    return whole_keys(table, WIDE if plan.coarse else kind)


def among(own: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of own are in the sorted array found."""
    if not len(found) or not len(own):
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(found, own), len(found) - 1)
    return found[at] == own


def spread(at: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Places from before in front of each of at up to, not including, after behind it."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, np.maximum(at - before, 0), 1)
    np.add.at(marks, np.minimum(at + after, size), -1)
    return np.cumsum(marks)[:size] > 0


def per_chunk(docs: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("chunk").applyInArrow(run, schema)


def with_hits(docs: DataFrame, hits: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(run, schema)
