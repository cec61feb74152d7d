"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, their Hilbert index orders the rows, and the order is cut
into runs of equal row counts. Neighbours on the curve are close in every dimension, so each file covers small ranges
of all of them and readers can skip files by any.

Ranks come from counts, not from one sort task: rows are counted for each (curve cell, hash bucket), a running sum
over these counts (a bounded table) gives each bucket its first rank, and row_number() within a bucket does the rest.
A cell with a third of all rows gets as many buckets as it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, running, saved

BITS = 5
SHARDS = 24
#: Buckets are sized so that there are at most about so many of them, and not under LEAST_ROWS rows in one.
MOST_BUCKETS = 20_000
LEAST_ROWS = 200
#: Cells of the curve up to which their counts are broadcast.
MOST_CELLS = 1 << 16
#: Rows in a file of a written shard, about.
FILE_ROWS = 1 << 20


def hilbert(dimensions: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns with values from 0 to 2**bits - 1, from bit operations alone.

    From the highest bit down, a set bit of a coordinate mirrors the lower bits of the first one, a clear bit exchanges
    them with the first one's. What is left, as a Gray code over all coordinates, spells the index.
    """
    n = len(dimensions)
    name = lambda i: f"x{i}"
    state = F.struct(*[d.cast("long").alias(name(i)) for i, d in enumerate(dimensions)])

    def mirrored(x: list[Column], i: int, q: int) -> list[Column]:
        low = q - 1
        swap = F.when(x[i].bitwiseAND(q) != 0, 0).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(low))
        first = F.when(x[i].bitwiseAND(q) != 0, x[0].bitwiseXOR(F.lit(low))).otherwise(x[0].bitwiseXOR(swap))
        return [first] + [x[j].bitwiseXOR(swap) if j == i else x[j] for j in range(1, n)]

    def let(value: Column, use: Callable[[list[Column]], list[Column]]) -> Column:
        """use() of a struct's coordinates, each made once."""
        return F.transform(F.array(value), lambda s: F.struct(*[c.alias(name(i)) for i, c in enumerate(use([s[name(i)] for i in range(n)]))]))[0]

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            state = let(state, lambda x, i=i, q=1 << level: mirrored(x, i, q))
    for i in range(1, n):
        state = let(state, lambda x, i=i: [*x[:i], x[i].bitwiseXOR(x[i - 1]), *x[i + 1 :]])

    def spelt(s: Column) -> Column:
        flip = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(s[name(n - 1)].bitwiseAND(1 << level) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
        out = F.lit(0).cast("long")
        for level in range(bits):
            for i in range(n):
                bit = F.shiftright(s[name(i)].bitwiseXOR(flip), level).bitwiseAND(1)
                out = out + bit * (1 << (level * n + n - 1 - i))
        return out

    return F.transform(F.array(state), spelt)[0]


def category_codes(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(key, code): each distinct value of a string column and its equi-depth code, in value order, nulls last.

    Values may be many (hosts, say): their counts are summed by ranges, not in one task.
    """
    key = category_key(F.col(f"`{column}`"))
    counts = running(df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")), ["key"], ["n"])
    return counts.select("key", F.floor(F.col("n_before") * (1 << bits) / F.col("n_total")).cast("int").alias("code"))


def category_key(c: Column) -> Column:
    """A string that sorts as c does with nulls last, and keeps null apart from every value."""
    return F.concat(F.when(c.isNull(), "1").otherwise("0"), F.coalesce(c, F.lit("")))


def size_code(size: Column, bits: int = BITS) -> Column:
    """Half powers of two, from 0 up."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size.cast("double") + 1) * 1.5)).cast("int")


def assign_shards(df: DataFrame, shards: int = SHARDS, categories: tuple[str, ...] = ("source", "lang"), text: str = "text", row_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(row_id, size, text_crc32, curve, shard, slot), a row for each row of df: the law `rows` holds.

    size: UTF-8 bytes of the text plus 8; a null text has none. The curve's dimensions are the categories and the size.
    Shards differ by one row at most; slots run from 0 without gaps. Ties on the curve are ordered by hash bucket, id and
    checksum, so reruns agree; equal rows may change places, which changes nothing. Null ids and values are values of
    their own. Fewer rows than shards leave shards empty; an empty table gives an empty result. Other columns are not
    read; with keep, these columns of df come instead of the first four, and shard and slot get underscores in front
    where they clash with one.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keys = [category_key(F.col(f"`{c}`")).alias(f"key{i}") for i, c in enumerate(categories)]
    row = [] if keep is None else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]
    rows = df.select(F.col(f"`{row_id}`").alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("crc"), *keys, *row)
    for i, c in enumerate(categories):
        codes = category_codes(df, c).select(F.col("key").alias(f"key{i}"), F.col("code").alias(f"code{i}"))
        rows = rows.join(codes, f"key{i}")  # few distinct values: adaptive execution broadcasts them after measuring
    dimensions = [F.col(f"code{i}") for i in range(len(categories))] + [size_code(F.col("size"))]
    rows = saved(rows.select("id", "size", "crc", hilbert(dimensions).alias("curve"), *["row"] * len(row)), "curve")

    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    total = max(1, cells.agg(F.sum("n")).first()[0] or 0)
    room = max(LEAST_ROWS, -(-total // MOST_BUCKETS))
    held = F.broadcast if (1 << BITS * len(dimensions)) <= MOST_CELLS else (lambda x: x)
    cells = cells.select("curve", F.ceil(F.col("n") / room).cast("int").alias("buckets"))
    rows = rows.join(held(cells), "curve").withColumn("bucket", F.pmod(dealt(), F.col("buckets")).cast("int")).drop("buckets")
    first = rows.groupBy("curve", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most a row for each cell, and MOST_BUCKETS
    first = first.select("curve", "bucket", (F.sum("n").over(Window.orderBy("curve", "bucket")) - F.col("n")).alias("first"))
    own = Window.partitionBy("curve", "bucket").orderBy("id", "crc", "size")
    ranked = rows.join(held(first), ["curve", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    shard = F.expr(f"(rank * {shards}) div {total}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    found = ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - start).cast("long")).withColumn("shard", F.col("shard").cast("int"))
    if keep is None:
        return found.select(F.col("id").alias(row_id), "size", F.col("crc").alias("text_crc32"), "curve", "shard", "slot")
    names = [free_name(df.select(*[F.col(f"`{c}`") for c in keep]), c) for c in ("shard", "slot")]
    return found.select(*[F.col(f"row.`{c}`") for c in keep], F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


def dealt() -> Column:
    """A number from id and checksum that spreads the rows of a cell."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("crc").cast("string"))), 1, 8), 16, 10).cast("long")


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", file_rows: int = FILE_ROWS) -> None:
    """Write rows that have a shard and a slot as one directory of Parquet a shard, in files of about file_rows rows by slot.

    Rows are dealt by ranges of (shard, slot), so that no shard is one task. Null texts and repeated rows are written as
    they are; rows without a shard go to the directory of null; an empty table writes no file of rows.
    """
    files = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(files, F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
