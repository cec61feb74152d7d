"""Mixing sources by a time-varying curriculum, in DataFrame functions alone.

Each source has a target, in words, and a schedule: the share of its weight over training time t from 0 to 1. The
schedule's integral says what part of the target has been asked for by t; its inverse gives each document, by the words
of its source in front of it, its training position. Documents are then range-sorted by position.

Running sums are built in two steps, so that a source with a third of all rows is no single task: rows are ordered by
a hash of their id, cut into hash ranges, summed for each (source, range), and summed on within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, saved, word_count

WEIGHTS = (5, 2, 1)
#: Each weight's schedule: rates at evenly spaced times from 0 to 1, linear in between, of any scale: steady, rising, falling.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows a hash range aims at, and the most ranges.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 16


def source_key(c: Column) -> Column:
    """A string that sorts as the source does by code point with null last, and keeps null apart."""
    return F.concat(F.when(c.isNull(), "1").otherwise("0"), F.coalesce(c, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(key, source_size) -> also weight, place (of its weight) and target, for one row a source.

    The sources share `share` of all words by weight; none gets over `most` times its own, the excess going to the rest
    by weight until none is above. That is a level: target = least(most * size, weight * level). In the order of
    size / weight, the level is what is left over the weights that are left at the first source under its limit.
    """
    ranked = running(sizes.select("key", "source_size", F.lit(1).cast("long").alias("one")), ["key"], ["one", "source_size"])
    place = F.pmod(F.col("one_before"), F.lit(len(weights))).cast("int")
    rows = ranked.select("key", "source_size", F.col("source_size_total").alias("whole"), place.alias("schedule"), (F.col("source_size") * float(most)).alias("most"))
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), F.col("schedule"))).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = running(rows, ["ratio", "key"], ["most", "weight"])
    rows = rows.withColumn("level", (F.col("whole") * share - F.col("most_before")) / (F.col("weight_total") - F.col("weight_before")))
    first = rows.filter(F.col("most") > F.col("weight") * F.col("level")).agg(F.min(F.struct("ratio", "key", "level")).alias("first"))  # one row
    rows = rows.crossJoin(F.broadcast(first)).withColumn("at", F.col("first.level"))
    return rows.select("key", "source_size", "weight", "schedule", F.round(F.coalesce(F.least("most", F.col("weight") * F.col("at")), F.col("most")), 6).alias("target"))


def time_of(part: Column, rates: tuple[float, ...]) -> Column:
    """When a schedule has asked for this part of its target: the inverse of its integral, a root in each linear piece."""
    pieces = len(rates) - 1
    width = 1.0 / pieces
    whole = sum((a + b) / 2 * width for a, b in zip(rates, rates[1:], strict=False))
    out, done = F.lit(1.0), whole
    for i in range(pieces - 1, -1, -1):
        a, b = float(rates[i]), float(rates[i + 1])
        done -= (a + b) / 2 * width
        asked = F.greatest(part * whole - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + asked * (2 * (b - a) / width), F.lit(0.0)))
        own = F.when(asked > 0, F.least(F.lit(width), 2 * asked / (a + root))).otherwise(0.0) + i * width
        out = own if i == pieces - 1 else F.when(part * whole > done + (a + b) / 2 * width, out).otherwise(own)
    return out


def scheduled(df: DataFrame, **options) -> DataFrame:
    """positioned() in training order: range-sorted by first position, untaken documents last."""
    return positioned(df, **options).withColumn("first", F.try_element_at("positions", F.lit(1))).orderBy(F.col("first").asc_nulls_last(), "u", "id").drop("first", "u", "id")


def positioned(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of df: `row` with the columns keep (default: the id), size, source_size, target, taken, copies, positions; u and id order them.

    size: words of the text (null: 0). copies: how often the mix takes the document, 0 to 2; taken = copies * size. A
    source's target is so many whole passes over its documents and a rest; the documents whose middle lies within the
    rest, in hash order of their ids, are taken once more. So a source misses its target by one document at most.
    positions: training time of each copy, from 0 to 1, by the schedule in the place of the source's weight.

    Null sources are a source of their own, the last. Null ids are spread by a hash of their text. Equal ids
    are ordered by size; equal rows may change places, which changes nothing. An empty table gives an empty result, a
    source without words a target of 0. Other columns are only read where keep names them.
    """
    keep = [row_id] if keep is None else keep
    named = F.coalesce(F.col(f"`{row_id}`").cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    spread = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{row_id}`").alias("id"), source_key(F.col(f"`{source}`")).alias("key"), word_count(F.col(f"`{text}`")).alias("size"), spread.alias("u"))
    if text in keep:  # texts are read again rather than written once more
        slim = saved(given.select("key", "size", "u"), "sizes")
    else:
        given = slim = saved(given, "sizes")
    n = slim.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    part = F.expr(f"(u * {ranges}) div 4294967296")
    given, slim = given.withColumn("part", part), slim.withColumn("part", part)
    parts = slim.groupBy("key", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("before", F.sum("part_size").over(Window.partitionBy("key").orderBy("part")) - F.col("part_size"))
    sizes = targets(slim.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share)
    parts = parts.join(sizes, "key")
    own = Window.partitionBy("key", "part").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = given.join(parts, ["key", "part"]).withColumn("middle", F.col("before") + F.sum("size").over(own) - F.col("size") / 2)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("passes", passes.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    rows = rows.withColumn("copies", F.col("passes") + F.when(F.col("middle") <= F.col("rest"), 1).otherwise(0))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("copies"), F.lit(MOST_EPOCHS))).otherwise(F.least(F.col("copies"), F.lit(1))))

    def at(part: Column) -> Column:
        out = F.lit(None).cast("double")
        for i, rates in enumerate(schedules):
            out = F.when(F.col("schedule") % len(schedules) == i, time_of(part, rates)).otherwise(out)
        return out

    when = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1), lambda k: at(F.least(F.lit(1.0), (k * F.col("source_size") + F.col("middle")) / F.col("target"))))
    rows = rows.withColumn("positions", F.when((F.col("copies") > 0) & (F.col("target") > 0), when).otherwise(F.array().cast("array<double>")))
    made = [F.col(c) for c in ("size", "source_size", "target")] + [(F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "positions"]
    return rows.select("row", *made, "u", "id")


def mix(df: DataFrame, **options) -> DataFrame:
    """df's columns: each document as often as the mix takes it, in training order. Options: see positioned()."""
    columns = df.columns
    rows = positioned(df, keep=columns, **options)
    copies = rows.filter("copies > 0").select("row", "u", "id", F.posexplode_outer("positions").alias("k", "at"))
    copies = copies.orderBy(F.col("at").asc_nulls_last(), "u", "id", "k")
    return copies.select(*[F.col(f"row.`{c}`") for c in columns])

