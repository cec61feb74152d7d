"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's shingles are hashed once; the K smallest hashes are its sketch. Documents with equal sets are one class
   from here on, standing under its smallest id.
2. Inverted lists of retained values, keyed by runs of values that are neighbours in a sketch, generate overlaps. Two sets
   with similarity 0.8 keep each smallest value of their union with chance 0.8, so that none of INDEXED values has a
   neighbour in common with chance 0.512 ** INDEXED or less (1e-7); where the union fits into INDEXED values it can't happen.
   Lists of one key are linked as stars to their smallest member, never as all pairs. Sets of five values are linked with
   those of four of them by keys of their own.
3. The union's sketch, from the two sketches, estimates the similarity; pairs far under the threshold go.
4. The rest is confirmed on the full sets, made again from the texts.
5. Lists that then hold more than one component are gone through again: short ones pair by pair across components, long
   ones under longer runs, where everything outside the largest component is compared with that component and with each
   other in blocks of BLOCK documents. So a link that misses the star's centre is found as well. Documents that can't have
   such a link, as too few of their shingles are in any other component, are found by counting shingles and left out before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, bucketed, forget, free_name, mix, recorded, release, rolling, saved, slices

SHINGLE, PERCENT = 5, 80
K, INDEXED = 64, 24
#: Lists up to this length are gone through pair by pair; longer ones in blocks.
SHORT = 32
BLOCK = 256
#: Rows in one file of a table behind a shuffle, about, and the least number of files.
FILE_ROWS, LEAST_FILES = 1 << 20, 8
#: Standard deviations of the estimate that a pair may lie under the threshold and still be confirmed.
SLACK = 6.0
PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after the other, and where each text's begin."""
    w = Words(texts, lower=True)
    h = rolling(w.hashes, size)
    at = np.flatnonzero(w.left[: len(h)] >= size)
    doc, h = w.doc[at], h[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))  # the whole sequence is the one shingle
    if len(few):
        alone = np.array([rolling(w.hashes[w.starts[i] : w.starts[i + 1]], int(w.counts[i]))[0] for i in few], np.uint64)
        doc, h = np.concatenate((doc, few)), np.concatenate((h, alone))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(df: DataFrame, row_id: str, text: str, shingle: int) -> DataFrame:
    """(id, n, h1, h2, sketch): set size, 128 bits of the set's hash (null for the empty set), its K smallest hashes."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, starts = shingle_sets(binary(part["text"]).to_pylist(), shingle)
                n = np.diff(starts)
                sums = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))[starts])  # noqa: E731  wraps
                h1, h2 = (sums(x).astype(np.int64) for x in (mix(h), mix(h ^ np.uint64(0xA0761D6478BD642F))))
                none = pa.array(n == 0)
                rows = [h[a : min(b, a + K)].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                nulled = lambda x, none=none: pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(x))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(n, pa.int64()), nulled(h1), nulled(h2), pa.array(rows, pa.binary())], names=["id", "n", "h1", "h2", "sketch"])

    given = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, sketch binary")


def postings(reps: DataFrame, values: int, length: int) -> DataFrame:
    """(key, rep, n): a row for each run of `length` neighbours among the first `values` values of a sketch."""
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch["sketch"].to_pylist()
            own = [np.frombuffer(b, np.uint64)[:values] for b in blobs]
            found = [rolling(v, min(length, len(v))) if len(v) else v for v in own]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            key = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch["rep"].take(pa.array(at)), batch["n"].take(pa.array(at))], names=["key", "rep", "n"])

    return reps.select("rep", "n", "sketch").mapInArrow(run, f"key long, rep {kind}, n long").distinct()


def nested(reps: DataFrame) -> DataFrame:
    """(a, b) with a < b: sets of five values and sets of four of these, the only pairs of 0.8 or more that may share no run of three."""
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, np.uint64) for b in batch["sketch"].to_pylist()]
            found = [[v] if len(v) == 4 else [np.delete(v, i) for i in range(5)] for v in own]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            key = np.array([rolling(v, 4)[0] for f in found for v in f], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch["rep"].take(pa.array(at)), batch["n"].take(pa.array(at))], names=["key", "rep", "n"])

    rows = reps.filter("n between 4 and 5").select("rep", "n", "sketch").mapInArrow(run, f"key long, rep {kind}, n long")
    pairs = rows.filter("n = 4").select("key", F.col("rep").alias("x")).join(rows.filter("n = 5").select("key", F.col("rep").alias("y")), "key").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_enough(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that leave room for the similarity."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't speak against the threshold."""
    kind = reps.schema["rep"].dataType.simpleString()
    sketch = reps.select("rep", F.col("sketch"))
    joined = pairs.join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b").join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")

    def fixed(column: pa.Array) -> np.ndarray:
        out = np.full((len(column), K), PAD)
        for i, blob in enumerate(column.to_pylist()):
            v = np.frombuffer(blob, np.uint64)
            out[i, : len(v)] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.sort(np.concatenate((fixed(batch["sa"]), fixed(batch["sb"])), axis=1), axis=1)
            twin = np.concatenate((np.zeros((len(both), 1), bool), both[:, 1:] == both[:, :-1]), axis=1) & (both != PAD)
            rank = np.cumsum(~twin & (both != PAD), axis=1)
            inside = rank <= K
            shared = (twin & inside).sum(axis=1)
            size = np.minimum(rank[:, -1], K)
            share = percent / 100
            good = shared >= size * share - SLACK * np.sqrt(np.maximum(size, 1) * share * (1 - share))
            yield batch.filter(pa.array(good)).select(["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


class Forest:
    """Which things are joined, directly or by others."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Join two; False if they were."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def confirmed(tasks: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b) with a < b: links that join the same documents as all pairs of a task's left and right ones with similar enough full sets.

    tasks: (id, task, left). A task has BLOCK documents a side, about. A link between documents that others of its task
    join already isn't repeated, so that a task's links are fewer than its documents.
    """
    kind = texts.schema["id"].dataType.simpleString()
    held = tasks.join(texts, "id").select("task", "left", "id", "text")

    def run(table: pa.Table) -> pa.Table:
        left = np.array(table["left"].to_pylist(), bool)
        h, starts = shingle_sets(binary(table["text"]).to_pylist(), shingle)
        ids = table["id"].to_pylist()
        sizes = np.diff(starts)
        rights, lefts = np.flatnonzero(~left), np.flatnonzero(left)
        values = np.concatenate([h[starts[i] : starts[i + 1]] for i in rights]) if len(rights) else h[:0]
        owner = np.repeat(np.arange(len(rights)), sizes[rights])
        place = {x: i for i, x in enumerate(dict.fromkeys(ids))}
        forest, out = Forest(len(place)), []
        for i in lefts:
            own = h[starts[i] : starts[i + 1]]
            if not len(own) or not len(values):
                continue
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            shared = np.bincount(owner[own[at] == values], minlength=len(rights))
            good = 100 * shared >= percent * (sizes[i] + sizes[rights] - shared)
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in rights[good] if forest.join(place[ids[i]], place[ids[j]])]
        return pa.table({"a": pa.array([x for x, _ in out], table["id"].type), "b": pa.array([y for _, y in out], table["id"].type)})

    return held.groupBy("task").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def pair_tasks(pairs: DataFrame) -> DataFrame:
    """(id, task, left) for pairs (a, b): the b of one a, BLOCK at a time."""
    salt = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"))
    named = pairs.join(salt, "a").withColumn("task", F.concat_ws("/", F.lit("p"), "a", F.pmod(F.xxhash64("b"), F.col("salts"))))
    return named.select(F.col("b").alias("id"), "task", F.lit(False).alias("left")).unionByName(named.select(F.col("a").alias("id"), "task", F.lit(True).alias("left")).distinct())


def linkable(held: DataFrame, texts: DataFrame, buckets: int, shingle: int, percent: int) -> DataFrame:
    """(rep): the documents of held that may have a link with one of another component there; held: (rep, comp).

    A link's common shingles are percent of the union and so of either set or more, so that a document of which fewer are
    in any other component has none. Nothing else goes, and no pair is made. Sets go to buckets of values in packed rows,
    one for each bucket and slice of texts.
    """
    kind = texts.schema["id"].dataType.simpleString()
    given = held.select(F.col("rep").alias("id"), F.xxhash64("comp").alias("comp")).join(texts, "id").select("id", "comp", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, starts = shingle_sets(binary(part["text"]).to_pylist(), shingle)
                n = np.diff(starts)
                sums = np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))[starts]).astype(np.int64)  # tells an id's texts apart
                bucket, doc = (h % np.uint64(buckets)).astype(np.int64), np.repeat(np.arange(len(n)), n)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(ends)):
                    at = order[ends[b] : ends[b + 1]]
                    docs, counts = np.unique(doc[at], return_counts=True)
                    lists = [part["id"].take(pa.array(docs)), part["comp"].take(pa.array(docs)), pa.array(sums[docs]), pa.array(n[docs], pa.int64()), pa.array(counts, pa.int64())]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), x) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([h[at].tobytes()], pa.binary()), *lists], names=["bucket", "hashes", "reps", "comps", "sums", "sizes", "counts"])

    def count(table: pa.Table) -> pa.Table:
        flat = lambda c: pa.concat_arrays([x.flatten() for x in table[c].chunks])
        h = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
        counts = flat("counts").to_numpy()
        owner = np.repeat(np.arange(len(counts)), counts)
        comp = flat("comps").to_numpy()[owner]
        order = np.lexsort((comp, h))
        h, comp = h[order], comp[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        ends = np.append(starts[1:], len(h))
        both = np.repeat(comp[starts] != comp[ends - 1], ends - starts)
        shared = np.bincount(owner[order][both], minlength=len(counts))
        out = pa.table({"rep": flat("reps"), "sum": flat("sums"), "size": flat("sizes"), "shared": pa.array(shared, pa.int64())})
        return out.filter(pa.array(shared > 0))

    packed = given.mapInArrow(pack, f"bucket long, hashes binary, reps array<{kind}>, comps array<long>, sums array<long>, sizes array<long>, counts array<long>")
    found = packed.groupBy("bucket").applyInArrow(count, f"rep {kind}, sum long, size long, shared long")
    return found.groupBy("rep", "sum", "size").agg(F.sum("shared").alias("shared")).filter(100 * F.col("shared") >= percent * F.col("size")).select("rep").distinct()


def block_tasks(outside: DataFrame, members: DataFrame) -> DataFrame:
    """(id, task, left): for each comp, the documents outside against all its members and against each other.

    outside: (rep, comp), members: (rep, comp).
    """
    size = lambda d, c: d.groupBy("comp").agg(F.count(F.lit(1)).alias(c))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = size(outside, "o").join(size(members, "m"), "comp", "left").select("comp", blocks(F.col("o")).alias("nl"), blocks(F.coalesce("m", F.lit(0)) + F.col("o")).alias("nr"))
    counts = saved(counts.coalesce(LEAST_FILES), "blocks")  # a table, so that adaptive execution may split a large component
    rights = members.select("rep", "comp").unionByName(outside.select("rep", "comp"))
    spread_ = lambda d, own, other: d.join(counts, "comp").select("rep", "comp", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
    left = spread_(outside, "nl", "nr").select(F.col("rep").alias("id"), F.concat_ws("/", F.lit("b"), "comp", "mine", "theirs").alias("task"), F.lit(True).alias("left"))
    right = spread_(rights, "nr", "nl").select(F.col("rep").alias("id"), F.concat_ws("/", F.lit("b"), "comp", "theirs", "mine").alias("task"), F.lit(False).alias("left"))
    return left.unionByName(right)


def narrowed(tasks: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The rows of block_tasks() whose sketches leave room for a link with a document of another component on the task's other side.

    sketched: (rep, comp, n, sketch). What comes out are documents, not pairs, and only their texts are read to confirm links.
    """
    kind = tasks.schema["id"].dataType.simpleString()
    held = tasks.join(sketched.withColumnRenamed("rep", "id"), "id").select("task", "left", "id", F.xxhash64("comp").alias("comp"), "n", "sketch")

    def run(table: pa.Table) -> pa.Table:
        left = np.array(table["left"].to_pylist(), bool)
        own = [np.frombuffer(b, np.uint64) for b in table["sketch"].to_pylist()]
        comp, n, size = table["comp"].to_numpy(), table["n"].to_numpy(), np.array([len(v) for v in own])
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        wanted = np.zeros(len(own), bool)
        if len(rights):
            values, owner = np.concatenate([own[i] for i in rights]), np.repeat(np.arange(len(rights)), size[rights])
            share = percent / 100
            for i in lefts:
                if not len(own[i]):
                    continue
                at = np.minimum(np.searchsorted(own[i], values), len(own[i]) - 1)
                shared = np.bincount(owner[own[i][at] == values], minlength=len(rights))
                union = np.minimum(size[i] + size[rights] - shared, K)  # of a union's sketch, no more than these can be shared
                good = shared >= union * share - SLACK * np.sqrt(np.maximum(union, 1) * share * (1 - share))
                good &= (comp[rights] != comp[i]) & (100 * np.minimum(n[rights], n[i]) >= percent * np.maximum(n[rights], n[i]))
                wanted[rights[good]] = True
                wanted[i] = good.any()
        return table.filter(pa.array(wanted)).select(["id", "task", "left"])

    return held.groupBy("task").applyInArrow(run, f"id {kind}, task string, left boolean").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): for each document with a link, the smallest one reachable. Labels spread and jump until none changes.

    Rows are two numbers each, so that a round's table is kept in files of FILE_ROWS rows rather than one for each task.
    """
    files = max(LEAST_FILES, -(-edges.count() // FILE_ROWS))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.coalesce(files), "edges")
    labels = saved(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m")).select("rep", F.least("rep", "m").alias("comp")).coalesce(files), "labels")
    while True:
        before = labels
        near = both.join(labels.select(F.col("rep").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "rep").select("rep", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("rep").alias("low"), F.col("comp").alias("lower"))
        step = saved(step.join(jump, "low").select("rep", F.col("comp").alias("old"), F.least("low", "lower").alias("comp")).coalesce(files), "labels")
        forget(before)
        labels = step.select("rep", "comp")
        changed = bool(step.filter("old <> comp").head(1))
        if not changed:
            forget(both)
            return labels
        labels.saved_at = step.saved_at


def with_components(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components in one list, for lists of at most SHORT rows with (key, rep, n, comp)."""
    found = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "comp"))).alias("m"))
    a = found.select("m", F.posexplode("m").alias("i", "x"))
    pairs = a.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).filter((F.col("x.comp") != F.col("y.comp")) & near_enough(F.col("x.n"), F.col("y.n"), percent))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(row_id, n_shingles, component_id, kept), a row for each row of df.

    A-Z is lower-cased; words are runs of non-space; a text with fewer words than a shingle is one shingle. Two texts
    are linked if 100 * common >= percent * all shingles. component_id: the smallest id reachable over links, the own
    included; kept: the id is its component's. Texts without a word (null, empty, blank) are linked with nothing. A null
    id has no component_id and is kept: it can't be named. Rows with equal ids are one document with several texts, and
    linked. Other columns are not read. An empty table gives an empty result. The result is a table of its own in the
    shared folder; what was written on the way is deleted.
    """
    with recorded() as made:
        found = linked(bucketed(df.select(F.col(f"`{row_id}`"), F.col(f"`{text}`")), "texts", row_id), row_id, text, shingle, percent)
        found = saved(found, "near-duplicates")
    forget(*[t for t in made if t is not found])
    release(df.sparkSession)
    return found


def linked(df: DataFrame, row_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """near_duplicates() of a table bucketed by its id: texts are then read where they lie when pairs are confirmed."""
    rows = saved(sketches(df, row_id, text, shingle), "sketches")
    files = max(LEAST_FILES, rows.count() * INDEXED // FILE_ROWS)  # steps behind a shuffle write files of about FILE_ROWS rows
    own = rows.filter("h1 is not null and id is not null")
    classes = own.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    reps = saved(own.join(classes.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"]).select(F.col("id").alias("rep"), "n", "h1", "h2", "sketch").dropDuplicates(["rep", "h1", "h2"]).coalesce(files), "classes")
    texts = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null")

    lists = postings(reps, INDEXED, 2)
    stars = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "n")).alias("first")).filter("size > 1")
    stars = saved(stars.coalesce(files), "stars")  # a table, so that adaptive execution may split the join's hot keys
    lists = saved(lists.join(stars, "key").coalesce(files), "lists")
    forget(stars)
    pairs = lists.filter((F.col("first.rep") < F.col("rep")) & near_enough(F.col("n"), F.col("first.n"), percent)).select(F.col("first.rep").alias("a"), F.col("rep").alias("b"))
    pairs = (pairs.unionByName(nested(reps)) if percent <= 80 else pairs).distinct()
    pairs = saved(estimated(pairs, reps, percent).coalesce(files), "pairs")
    edges = saved(confirmed(pair_tasks(pairs), texts, shingle, percent).coalesce(files), "links")
    forget(pairs)
    release(df.sparkSession)
    labels = components(edges)

    found = with_components(lists.select("key", "rep", "n", "size"), labels)
    mixed = found.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    mixed = saved(mixed.coalesce(files), "mixed")
    all_lists, lists = lists, saved(found.join(mixed, "key").coalesce(files), "mixed-lists")
    forget(all_lists, mixed)
    long_ = lists.filter(F.col("size") > SHORT).select("rep").distinct()
    runs = postings(reps.join(long_, "rep", "left_semi"), K, 3)
    sizes = saved(runs.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").coalesce(files), "run-sizes")
    runs = saved(with_components(runs.join(sizes, "key"), labels).coalesce(files), "run-lists")
    forget(sizes)
    pairs = across(lists.filter(F.col("size") <= SHORT), percent).unionByName(across(runs.filter(F.col("size") <= SHORT), percent)).distinct()
    pairs = saved(estimated(pairs, reps, percent).coalesce(files), "pairs")
    parts = runs.filter(F.col("size") > SHORT).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("key").agg(F.max(F.struct(F.col("c"), F.col("comp"))).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    largest = saved(largest.coalesce(files), "largest")
    outside = runs.join(largest.select("key", F.col("top.comp").alias("main")), "key").filter("comp <> main").select("rep", F.col("main").alias("comp")).distinct()
    outside = saved(outside.coalesce(files), "outside")
    release(df.sparkSession)
    members = saved(with_components(reps.select("rep", "n", "sketch"), labels).coalesce(files), "members")
    held = members.join(outside.select("comp").distinct(), "comp", "left_semi").unionByName(members.join(outside.select("rep").distinct(), "rep", "left_semi"))
    held = saved(held.groupBy("rep", "comp").agg(F.sum("n").alias("n")).coalesce(files), "held")
    buckets = max(LEAST_FILES, (held.agg(F.sum("n")).first()[0] or 0) // FILE_ROWS)
    able = saved(linkable(held, texts, buckets, shingle, percent).coalesce(files), "linkable")
    near, able_members = outside.join(able, "rep", "left_semi"), members.join(able, "rep", "left_semi")
    tasks = narrowed(block_tasks(near, able_members), able_members, percent)
    tasks = pair_tasks(pairs).unionByName(tasks)
    more = saved(confirmed(tasks, texts, shingle, percent).coalesce(files), "more-links")
    forget(lists, runs, largest, pairs, outside, members, held, able)
    release(df.sparkSession)
    if more.head(1):
        labels = components(edges.unionByName(more))

    shared = own.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("l"), F.max(F.struct("h1", "h2")).alias("m")).filter("l <> m").select("id")
    named = with_components(reps.select("rep", "h1", "h2"), labels).select("h1", "h2", "comp")
    out = rows.join(named, ["h1", "h2"], "left")
    if shared.head(1):  # ids with several texts: their classes are linked as well
        named = by_id(out, shared, named)
        out = rows.join(named, ["h1", "h2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def by_id(rows: DataFrame, shared: DataFrame, named: DataFrame) -> DataFrame:
    """named with the components of an id's several texts made one."""
    links = rows.join(shared, "id", "left_semi").filter("comp is not null").groupBy("id").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("c"))
    links = links.select(F.least("a", "id").alias("a"), F.explode(F.array_union("c", F.array("id"))).alias("b")).filter("a <> b").distinct()
    if not links.head(1):
        return named
    lower = components(links).select(F.col("rep").alias("comp"), F.col("comp").alias("low"))
    return named.join(lower, "comp", "left").select("h1", "h2", F.coalesce("low", "comp").alias("comp"))


def one_of_each(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """df's columns: of each component the rows of its smallest id, and every row that is linked with nothing.

    Null ids, texts without words, repeated rows and an empty table: see near_duplicates(). Columns of any name pass.
    """
    gone = near_duplicates(df, row_id, text, shingle, percent).filter("not kept").select(F.col(row_id).alias("gone_id")).distinct()
    key = free_name(df, "gone_id")
    return df.join(gone.withColumnRenamed("gone_id", key), F.col(f"`{row_id}`") == F.col(f"`{key}`"), "left_anti")
