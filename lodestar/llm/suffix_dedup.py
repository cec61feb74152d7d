"""Suffix-array dedup with a sparse suffix array.

Suffixes are retained at minimiser positions: the places of the smallest hash of K words among every SPAN consecutive
places. Two places with MIN_WORDS = K + SPAN - 1 equal words have a minimiser in common, so nothing that long is
missed. Suffixes whose first K words occur once in the corpus have no neighbour and are left out; the others are sorted
over all executors, by a hash of their first K words, then by their next MIN_WORDS words and the words in front read
backwards, and compared with their neighbours. A match is extended right by the common prefix and left by the common
words in front; matches of MIN_WORDS words or more are repeats. Longer repeats are the union of those at their minimisers.

The NEIGHBOURS rows on either side are all that a group of so many equal prefixes has. In a larger group, or one that a
task's border cuts, the suffix that shares most words in front may stand farther off. So each row there that isn't like
its predecessor also sends the hashes of all windows of MIN_WORDS words around its minimiser (every split into words in
front and words behind); those that another row sends too are repeats. Together both find exactly the repeats.

Words are 4-byte hashes in the sort key, so that a match may come out one word too long once in 4 billion comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, rolling, saved
from .repeats import WIDE, Plan, among, chunked, keys, known, packed, per_chunk, repeated, sent, with_hits, words_of

MIN_WORDS = 50
K = 20
BYTES = 4
#: How many suffixes on either side in the order each one is compared with.
NEIGHBOURS = 8


def sliding(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every span consecutive values, by doubling."""
    size = len(values) - span + 1
    out, width = values, 1
    while 2 * width <= span:
        out, width = pick(out[:-width], out[width:]), 2 * width
    return pick(out[:size], out[span - width : span - width + size])


def minimisers(w, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose k-word hash is the smallest of some span consecutive places of a text; these hashes; and its own windows.

    Equal smallest hashes all count, so that the choice hangs on the words alone. A window of k + span - 1 words is owned
    by the first of its smallest hashes: those that a place owns begin at `first` and at the `owned` - 1 places behind it.
    """
    h = rolling(w.hashes, k)
    size = len(h) - span + 1
    if size < 1:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    order = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    least = sliding(order, span, np.minimum)
    least[w.left[:size] < k + span - 1] = 0  # these would reach into the next text
    none = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((none, least, none)), span, np.maximum) == order)
    starts = np.flatnonzero(least)
    owner = np.searchsorted(at, starts)
    while len(wrong := np.flatnonzero(order[at[owner]] != least[starts])):
        owner[wrong] += 1
    first, last = np.searchsorted(owner, np.arange(len(at))), np.searchsorted(owner, np.arange(len(at)), side="right")
    begin = np.where(first < last, starts[np.minimum(first, max(len(starts) - 1, 0))] if len(starts) else at, at)
    return at, h[at], begin, last - first


def around(w, at: np.ndarray, size: int, forward: bool) -> pa.Array:
    """size words from each place on (forward) or in front of it, backwards: 4 bytes each, zero past the text's ends."""
    steps = np.arange(size) if forward else -1 - np.arange(size)
    places = at[:, None] + steps
    inside = (places >= w.starts[w.doc[at]][:, None]) & (places < w.starts[w.doc[at] + 1][:, None])
    values = (w.hashes % np.uint64((1 << 32) - 1)).astype(np.uint32) + np.uint32(1)
    values = values[np.clip(places, 0, max(len(w.hashes) - 1, 0))]
    values[~inside] = 0
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * BYTES), len(at), [None, pa.py_buffer(values.astype(">u4").tobytes())])
    return fixed.cast(pa.binary())


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of binaries of one length, as rows of words."""
    a = column.combine_chunks()
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32).reshape(len(a), -1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal words of the rows of a and b, not counting places past a text's end."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def repeated_passages(df: DataFrame, row_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(row_id, text_key, n_repeated, spans): a row for each document with a passage of min_words words that occurs twice or more.

    spans: disjoint [start, end) word ranges, ascending; n_repeated: the words in them. text_key is a hash of the text.
    Documents without such a passage, null, empty and shorter texts have no row. Rows with equal id and text share one
    row, and repeat each other. Null ids stay. Other columns are not read. An empty table gives an empty result.
    """
    span = min_words - k + 1
    back, ahead = span - 1, min_words
    plan = Plan(df, text)
    docs = chunked(df, plan, row_id, text)

    def anchors(table: pa.Table) -> pa.Table:
        return sent(table["chunk"][0].as_py(), packed(minimisers(words_of(table), k, span)[1], None, plan, WIDE))

    hits = repeated(per_chunk(docs, anchors, "bucket int, chunk int, values binary"), plan, WIDE, marked=False)
    kind = df.schema[row_id].dataType.simpleString()
    shape = f"prefix long, context long, suffix binary, front binary, id {kind}, key long, at int, own_first int, own int"

    def suffixes(table: pa.Table, found: pa.Table) -> pa.Table:
        at = first = own = np.zeros(0, np.int64)
        h = np.zeros(0, np.uint64)
        if table.num_rows and found.num_rows:
            w = words_of(table)
            at, h, first, own = minimisers(w, k, span)
            held = among(keys(h, plan, WIDE), known(found, plan, WIDE))
            at, h, first, own = at[held], h[held], first[held], own[held]
        doc = w.doc[at] if len(at) else at
        none = pa.array([], pa.binary())
        out = {"suffix": around(w, at, ahead, True) if len(at) else none, "front": around(w, at, back, False) if len(at) else none}
        # The first K words' hash, and one of all: short keys, by which equal rows meet and few bytes are sampled.
        context = [xxhash.xxh3_64_intdigest(x + y) for x, y in zip(out["suffix"].to_pylist(), out["front"].to_pylist(), strict=True)]
        out = {"prefix": pa.array(h.astype(np.int64), pa.int64()), "context": pa.array(np.array(context, np.uint64).astype(np.int64), pa.int64())} | out
        out |= {n: table[n].take(pa.array(doc)) for n in ("id", "key")}
        return pa.table(out | {"at": pa.array(at - w.starts[doc] if len(at) else at, pa.int32()), "own_first": pa.array(back - (at - first), pa.int32()), "own": pa.array(own, pa.int32())})

    retained = with_hits(docs, hits, suffixes, shape)
    ordered = retained.repartitionByRange("prefix", "context", "id").sortWithinPartitions("prefix", "suffix", "front")
    found_schema = f"part int, id {kind}, key long, at int, front_words int, next_words int, own_first int, own int, suffix binary, front binary"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compare each row with the next ones; a row waits for them."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last rows so far: a table, their left and right match, and how many have their next ones known
        opening = None  # the prefix that the task begins with
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if opening is None:
                opening = t["prefix"][0].as_py()
            held = Held(t, held, opening, min_words)
            yield from held.done(part, last=False)
        if held is not None:
            yield from held.done(part, last=True)

    kept = saved(ordered.mapInArrow(neighbours, found_schema), "matches")
    far = kept.filter("suffix is not null and own > 0").select("part", "id", "key", "at", "own_first", "own", "suffix", "front")

    def splits(table: pa.Table) -> pa.Table:
        h, good = own_windows(table, min_words)
        return sent(table["part"][0].as_py(), packed(h[good], None, plan, WIDE))

    again = repeated(far.groupBy("part").applyInArrow(splits, "bucket int, chunk int, values binary"), plan, WIDE, marked=False)

    def met(table: pa.Table, found: pa.Table) -> pa.Table:
        at, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if table.num_rows and found.num_rows:
            h, good = own_windows(table, min_words)
            hit = good & among(keys(h.ravel(), plan, WIDE), known(found, plan, WIDE)).reshape(h.shape)
            at, start = np.nonzero(hit)
            if len(at):  # a row's windows that touch are one span
                new = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(start) != 1)))
                last = np.concatenate((new[1:], [True]))
                at, start, end = at[new], start[new], start[last] + min_words
                base = table["at"].to_numpy()[at] - back
                return pa.table({n: table[n].take(pa.array(at)) for n in ("id", "key")} | {"start": pa.array(base + start, pa.int32()), "end": pa.array(base + end, pa.int32())})
        return pa.table({n: table[n].take(pa.array(at)) for n in ("id", "key")} | {"start": pa.array(start, pa.int32()), "end": pa.array(start, pa.int32())})

    exact = far.groupBy("part").cogroup(again.groupBy("chunk")).applyInArrow(met, f"id {kind}, key long, start int, end int")
    matches = kept.filter("next_words > 0")
    spans = matches.select("id", "key", F.struct((F.col("at") - F.col("front_words")).alias("start"), (F.col("at") + F.col("next_words")).alias("end")).alias("s"))
    spans = spans.unionByName(exact.select("id", "key", F.struct("start", "end").alias("s")))
    merged = spans.groupBy("id", "key").agg(F.array_sort(F.collect_set("s")).alias("s"))
    merged = merged.select("id", "key", merge(F.col("s")).alias("spans"))
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return merged.select(F.col("id").alias(row_id), F.col("key").alias("text_key"), covered.alias("n_repeated"), "spans")


def own_windows(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the hashes of the windows of size words in front and suffix, in text order, and which of them it owns."""
    words = np.concatenate((matrix(table["front"])[:, ::-1], matrix(table["suffix"])), axis=1)
    values = mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    base = np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for i in range(words.shape[1]):
        sums[:, i + 1] = sums[:, i] * base + values[:, i]
    power = np.uint64(pow(int(base), size, 1 << 64))
    h = mix(sums[:, size:] - sums[:, :-size] * power)
    place = np.arange(h.shape[1]) - table["own_first"].to_numpy()[:, None]
    return h, (place >= 0) & (place < table["own"].to_numpy()[:, None])


class Held:
    """Rows of a task in order, each with the words it has in common to the left and right with its neighbours so far."""

    def __init__(self, t: pa.Table, before: Held | None, opening: int, min_words: int):
        n = 0
        if before:
            n = before.t.num_rows
            t = pa.concat_tables([before.t, t])
        zeros = np.zeros(t.num_rows - n, np.int64)
        self.left, self.right = (np.concatenate((x, zeros)) for x in ((before.left, before.right) if before else (zeros[:0], zeros[:0])))
        self.t, self.opening = t.combine_chunks(), opening
        self.seen = before.seen if before else 0  # rows at the start that are here for comparison only
        prefix, suffix, front = self.t["prefix"].to_numpy(), matrix(self.t["suffix"]), matrix(self.t["front"])
        for step in range(1, min(NEIGHBOURS, t.num_rows - 1) + 1):
            at = np.flatnonzero((prefix[:-step] == prefix[step:]) & (np.arange(step, t.num_rows) >= n))
            r, b = common(suffix[at], suffix[at + step]), common(front[at], front[at + step])
            good = r + b >= min_words
            at = at[good]
            for side, value in ((self.left, b[good]), (self.right, r[good])):
                side[at] = np.maximum(side[at], value)
                side[at + step] = np.maximum(side[at + step], value)
        self.prefix, self.suffix, self.front = prefix, suffix, front

    def done(self, part: int, last: bool) -> Iterator[pa.RecordBatch]:
        """The rows that have met all their neighbours (or the task's last); NEIGHBOURS + 1 rows on either side stay held."""
        size, far = self.t.num_rows, NEIGHBOURS + 1
        end = size if last else max(self.seen, size - far)
        rows = np.arange(self.seen, end)
        same = lambda other: self.prefix[np.clip(other, 0, size - 1)] == self.prefix[rows]
        open_ = (same(rows - far) & (rows >= far)) | (same(rows + far) & (rows + far < size)) | (self.prefix[rows] == self.opening)
        if last:
            open_ |= self.prefix[rows] == self.prefix[-1]
        like = np.zeros(len(rows), bool)
        at = np.flatnonzero(rows > 0)
        like[at] = (self.suffix[rows[at]] == self.suffix[rows[at] - 1]).all(axis=1) & (self.front[rows[at]] == self.front[rows[at] - 1]).all(axis=1)
        open_ &= ~like
        wanted = np.flatnonzero((self.right[rows] > 0) | open_)
        own, sends = self.t.take(pa.array(rows[wanted])), pa.array(open_[wanted])
        null = pa.scalar(None, pa.binary())
        out = {"part": pa.array(np.full(len(wanted), part), pa.int32()), "id": own["id"], "key": own["key"], "at": own["at"], "front_words": pa.array(self.left[rows[wanted]], pa.int32()), "next_words": pa.array(self.right[rows[wanted]], pa.int32()), "own_first": own["own_first"], "own": own["own"]}
        out |= {c: pc.if_else(sends, own[c].combine_chunks(), null) for c in ("suffix", "front")}
        yield from pa.table(out).combine_chunks().to_batches()
        keep = max(0, end - far)
        self.t, self.seen = self.t.slice(keep), end - keep
        self.left, self.right, self.prefix, self.suffix, self.front = (x[keep:] for x in (self.left, self.right, self.prefix, self.suffix, self.front))


def merge(spans: Column) -> Column:
    """Sorted [start, end) structs with those that touch made one."""
    last = lambda acc: F.element_at(acc, -1)

    def add(acc: Column, s: Column) -> Column:
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.slice(spans, 2, F.size(spans)), F.slice(spans, 1, 1), add)
