"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts become templates: numbers, names (capitalised words) and units behind a number turn into typed placeholders, the
rest is lower-cased and loses its punctuation. Windows of WINDOW template tokens of every place are hashed, of items and
documents alike, and joined; where a window holds placeholders, it is hashed with their values as well, so that tables
of numbers, lists of names and words that are capitalised on one side alone are found too. Each hit names an alignment
of a document with an item. There the two are laid side by side, and a hit needs a run of equal tokens whose slots are
consistent: one value of the item stands for one value of the document and the other way round. So a question with other
numbers or names is caught, and a text that only looks alike is not.

What counts is stated for `contaminated` and is what a comparison of all alignments would give (tests do that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

#: A run: so many tokens that agree (all of a shorter item's), and so many more places in between that may disagree.
RUN, GAPS = 13, 2
#: Tokens of a joined window: RUN tokens with GAPS others between them hold that many in a row.
WINDOW = 5
#: Words that a window of placeholders needs to be hashed without their values.
WINDOW_WORDS = 2
#: Agreeing tokens that must be words, not placeholders; with fewer, placeholders agree only where their values are equal.
LEAST_WORDS = 4
#: Rows of benchmark windows up to which they are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Units of measure that turn into a placeholder behind a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "oz", "lb", "lbs", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "mph", "kmh", "w", "kw", "kwh", "v", "a", "hz", "c", "f")

#: Words that are no names, capitalised or not.
NOT_NAMES = ("a", "after", "all", "an", "and", "are", "as", "at", "before", "but", "by", "can", "do", "does", "each", "every", "find", "for", "from", "given", "he", "her", "his", "how", "if", "in", "is", "it", "its", "let", "no", "not", "of", "on", "one", "or", "our", "she", "so", "some", "that", "the", "their", "then", "there", "these", "they", "this", "to", "we", "what", "when", "where", "which", "while", "who", "why", "with", "you", "your")

#: Kinds of tokens; all but the first are placeholders.
WORD, NUMBER, NAME, UNIT = range(4)
#: What parts tokens: anything but letters, digits and marks, but for points and commas before a digit.
APART = r"[\x00-+\-/:-@\[-`{-\x7F\u0080-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u00D7\u00F7\u2000-\u206F\u20A0-\u20CF\u2190-\u2BFF\u3000-\u303F]+|[.,](?![0-9])"


def tokenised(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """keep, `tok` (lower-cased tokens) and `kind` (their kinds) for each row; none for a null text."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), APART), lambda w: w != "")
    df = df.select(*keep, parts.alias("part")).select("*", F.transform("part", F.lower).alias("tok"))
    number = lambda w: (w <= "9~") & (w >= "0") & w.rlike(r"^[0-9][0-9.,]*$")
    name = lambda w, low: (w != low) & ~low.isin(*NOT_NAMES) & w.rlike(r"^\p{Lu}[\p{L}\p{M}]*\p{Ll}")
    plain = F.zip_with("part", "tok", lambda w, low: F.when(number(w), NUMBER).when(name(w, low), NAME).otherwise(WORD))
    df = df.select(*[c for c in df.columns if c != "part"], plain.alias("plain"))
    unit = F.transform("plain", lambda k, i: F.when((F.get("plain", i - 1) == NUMBER) & (k != NUMBER) & F.get("tok", i).isin(*UNITS), UNIT).otherwise(k))
    return df.select(*[c for c in df.columns if c != "plain"], F.when(F.array_contains("plain", NUMBER), unit).otherwise(F.col("plain")).alias("kind"))


def windowed(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, h): the windows of tokenised() rows: as templates, and by values where these differ."""
    df = df.select(*keep, F.col("kind").alias("kinds"), F.transform("tok", lambda w: F.xxhash64(w)).alias("by_value"))
    df = df.select(*keep, "by_value", F.zip_with("by_value", "kinds", lambda h, k: F.when(k == WORD, h).otherwise(k.cast("long"))).alias("by_kind"))
    n = F.greatest(F.size("by_value") - (WINDOW - 1), F.lit(0))
    window = lambda c: F.transform(F.slice(c, F.lit(1), F.col("n")), lambda h, i: F.xxhash64(h, *[F.get(c, i + k) for k in range(1, WINDOW)]))
    df = df.select("*", n.alias("n")).select(*keep, "n", window("by_kind").alias("t"), window("by_value").alias("v"))
    df = df.select(*keep, "n", F.concat("t", F.zip_with("t", "v", lambda t, v: F.when(t != v, v))).alias("both"))
    # An inner posexplode would make Catalyst infer a filter on the array's size, and make the array once more for it.
    df = df.select(*keep, "n", F.posexplode_outer("both").alias("p", "h")).filter("h is not null")
    return df.select(*keep, F.when(F.col("p") < F.col("n"), F.col("p")).otherwise(F.col("p") - F.col("n")).alias("at"), "h")


def telling(df: DataFrame) -> DataFrame:
    """windowed() rows of items, without template windows of fewer than WINDOW_WORDS words."""
    few = F.size(F.filter(F.slice("kind", F.col("at") + 1, F.lit(WINDOW)), lambda k: k == WORD)) < WINDOW_WORDS
    by_kind = F.xxhash64(*[F.when(F.get("kind", F.col("at") + k) == WORD, F.xxhash64(F.get("tok", F.col("at") + k))).otherwise(F.get("kind", F.col("at") + k).cast("long")) for k in range(WINDOW)])
    return df.filter(~few | (F.col("h") != by_kind))


def whole_hash(tok: str = "tok") -> Column:
    """A hash of all tokens."""
    return F.xxhash64(F.array_join(tok, " "))


def let(value: Column, use) -> Column:
    """use(value) with value made once."""
    return F.transform(F.array(value), use)[0]


def consistent(slots: Column) -> Column:
    """Whether values iv and dv of slots stand for each other one to one."""
    distinct = lambda of: F.size(F.array_distinct(F.transform(slots, of)))
    both = distinct(lambda s: F.struct(s["iv"], s["dv"]))
    return (both == distinct(lambda s: s["iv"])) & (both == distinct(lambda s: s["dv"]))


def is_run(places: Column, need: Column) -> Column:
    """Whether of these places `need` agree, with consistent slots; of few words, with equal values."""

    def judged(same: Column) -> Column:
        slots = F.filter(same, lambda s: s["slot"])
        few = F.size(same) - F.size(slots) < LEAST_WORDS
        return F.when(few, F.size(F.filter(same, lambda s: s["iv"] == s["dv"])) >= need).otherwise((F.size(same) >= need) & let(slots, consistent))

    return let(F.filter(places, lambda s: s["same"]), judged)


def contaminated(df: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, gaps: int = GAPS) -> DataFrame:
    """(row_id, item_id, matched, item_tokens, start, slots, changed_slots, text_key), a row for each document and item that it holds.

    A document and an item are laid side by side in every way in which WINDOW tokens in a row agree, as templates with
    WINDOW_WORDS words or more, or by their values. There, two tokens agree if both are words or names of equal value, or
    placeholders of one kind (a slot). The document holds the item if among some min(run, n) to run + gaps places in a
    row, n being the item's tokens, min(run, n) agree and their slots are consistent; where fewer than LEAST_WORDS of
    them are words, only tokens of equal values count. An item of fewer than WINDOW tokens can't be told from chance
    within a text; it is held by a document that consists of its tokens and nothing else.

    matched: the agreeing tokens in such runs; slots and changed_slots: the slots among them, and those with another
    value, over 0 for re-parameterised questions; start: the document's token where the item's first would be. Of several
    ways the one with most agreeing tokens counts, the first of equals. text_key is a hash of the document's text.

    Null and empty texts and items hold nothing; null ids pass through as ids. Repeated rows give a row once for each
    distinct (id, text); two texts with one id may both show up. An item repeated under other ids gives a row for each.
    Empty tables give an empty result. Other columns are not read.
    """
    items = tokenised(benchmark, F.col(f"`{item_text}`"), F.col(f"`{item_id}`").alias("item")).filter(F.size("tok") > 0)
    items = items.select("item", F.col("tok").alias("item_tok"), F.col("kind").alias("item_kind")).dropDuplicates(["item", "item_tok", "item_kind"])
    items = saved(items.withColumn("item_key", F.xxhash64("item", "item_tok", "item_kind")), "items")
    index = telling(windowed(items.select("item_key", F.col("item_tok").alias("tok"), F.col("item_kind").alias("kind")), "item_key", "tok", "kind"))
    index = saved(index.select("item_key", F.col("at").alias("item_at"), "h").distinct(), "item-windows")
    held = F.broadcast if index.count() <= BROADCAST_ROWS else (lambda x: x)

    body = F.col(f"`{text}`")
    docs = df.select(F.col(f"`{row_id}`").alias("id"), body.alias("body"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_key"))
    laid_out = tokenised(docs, F.col("body"), F.col("id"), F.col("text_key"))
    hits = windowed(laid_out, "id", "text_key").join(held(index), "h").select("id", "text_key", "item_key", (F.col("at") - F.col("item_at")).alias("start"))
    candidates = hits.distinct()
    short = items.filter(F.size("item_tok") < WINDOW).select("item_key", whole_hash("item_tok").alias("h"))
    if short.head(1):
        alike = laid_out.filter(F.size("tok").between(1, WINDOW - 1)).select("id", "text_key", whole_hash().alias("h")).join(short, "h")
        candidates = candidates.unionByName(alike.select("id", "text_key", "item_key", F.lit(0).alias("start"))).distinct()
    candidates = saved(candidates, "candidates")

    wanted = candidates.groupBy("id", "text_key").agg(F.collect_set(F.struct("item_key", "start")).alias("found"))
    texts = docs.withColumnRenamed("id", "doc").withColumnRenamed("text_key", "key")
    laid = wanted.join(texts, F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key"))).dropDuplicates(["id", "text_key"])
    laid = tokenised(laid, F.col("body"), F.col("id"), F.col("text_key"), F.col("found")).select("id", "text_key", "tok", "kind", F.explode("found").alias("c"))
    cut = F.struct(F.greatest(F.col("c.start"), F.lit(0)).alias("from"), F.least(F.size("tok"), F.col("c.start") + F.size("item_tok")).alias("to"))
    laid = laid.withColumn("item_key", F.col("c.item_key")).join(held(items), "item_key").withColumn("cut", cut)
    length = F.col("cut.to") - F.col("cut.from")
    part = lambda c: F.slice(F.col(c), F.col("cut.from") + 1, length)
    item_part = lambda c: F.slice(F.col(c), F.col("cut.from") - F.col("c.start") + 1, length)
    sides = F.arrays_zip(part("kind").alias("d"), item_part("item_kind").alias("i"), part("tok").alias("dv"), item_part("item_tok").alias("iv"))
    slot = lambda s: (s["d"] == s["i"]) & (s["d"] != WORD)
    sides = F.transform(sides, lambda s, at: F.struct(at.alias("at"), slot(s).alias("slot"), (slot(s) | (s["dv"] == s["iv"])).alias("same"), s["dv"].alias("dv"), s["iv"].alias("iv")))
    need = F.least(F.lit(run), F.size("item_tok"))
    laid = laid.filter(length > 0).select("id", "text_key", "item", F.col("c.start").alias("start"), F.size("item_tok").alias("item_tokens"), need.alias("need"), sides.alias("sides"))
    laid = laid.filter(F.size(F.filter("sides", lambda s: s["same"])) >= F.col("need"))
    # Each stretch of need to need + gaps places (from, length) that is a run.
    stretches = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(gaps)), lambda more: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sides") - F.col("need") - more + 1)), lambda at: F.struct(at.alias("at"), (F.col("need") + more).alias("n")))))
    runs = F.filter(stretches, lambda r: (r["at"] + r["n"] - 1 <= F.size("sides")) & is_run(F.slice("sides", r["at"], r["n"]), F.col("need")))
    laid = laid.withColumn("runs", runs).filter(F.size("runs") > 0)
    inside = F.filter("sides", lambda s: s["same"] & F.exists("runs", lambda r: (s["at"] + 1 >= r["at"]) & (s["at"] + 1 < r["at"] + r["n"])))
    found = laid.select("id", "text_key", "item", "start", "item_tokens", inside.alias("same")).withColumn("slots", F.filter("same", lambda s: s["slot"]))
    found = found.select("id", "text_key", "item", F.struct(F.size("same").alias("matched"), (-F.col("start")).alias("minus"), "item_tokens", F.size("slots").alias("slots"), F.size(F.filter("slots", lambda s: s["iv"] != s["dv"])).alias("changed")).alias("m"))
    best = found.groupBy("id", "text_key", "item").agg(F.max("m").alias("m"))
    return best.select(F.col("id").alias(row_id), F.col("item").alias(item_id), F.col("m.matched").alias("matched"), F.col("m.item_tokens").alias("item_tokens"), (-F.col("m.minus")).alias("start"), F.col("m.slots").alias("slots"), F.col("m.changed").alias("changed_slots"), "text_key")


def decontaminated(df: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df whose text holds no benchmark item, with df's columns."""
    bad = contaminated(df, benchmark, row_id, text, **options).select(F.col("text_key").alias("bad_key")).distinct()
    key = free_name(df, "text_key")
    held = df.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return held.join(bad, F.col(f"`{key}`") == F.col("bad_key"), "left_anti").drop(key)
