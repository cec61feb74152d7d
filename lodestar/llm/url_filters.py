"""URL filters: a rule list first, gradient-boosted trees on lexical features for the rest, in DataFrame functions alone.

Trees are grown on histograms. The labelled URLs (a bounded hash sample) become vectors of feature bins, equal vectors
become one row with counts, and each level of each tree is one aggregation of gradients by (node, feature, bin) over
that small table; the driver only sees these sums. The finished trees are CASE expressions over the features, so that
scoring is one pass over the URLs beside a broadcast of suffix statistics that the sample bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, saved

#: Labelled URLs that a fit uses at most, about: a hash sample of the rows. Bounds suffix statistics and tree tables.
MAX_LABELLED = 50_000
TREES, DEPTH, BINS, RATE = 10, 3, 16, 0.4
#: Strength of the prior of a suffix's block rate, and URLs a suffix needs in the sample to have a rate of its own.
PRIOR, LEAST_URLS = 4.0, 3
#: Files of the table of binned URLs, which MAX_LABELLED bounds.
FILES = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_.%=&/"
#: Words in a host that label it as unwanted for training.
UNWANTED_TERMS = ("ads", "adult", "bets", "betting", "casino", "cheap", "escort", "free", "loan", "lottery", "pills", "poker", "porn", "replica", "spam", "track", "viagra", "win", "xxx")

FEATURES = ("url_length", "host_length", "labels", "hyphens", "path_length", "depth", "digits", "entropy", "parameters", "rate1", "rate2", "rate3")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (like 'example.net/en/') that fits host or a parent domain and begins the path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(url: str) -> dict[str, Column]:
    """Lexical features of the string column url; null counts as the empty text."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path, low = host_of(u), path_of(u), ascii_lower(u)
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    whole = F.greatest(F.length(u), F.lit(1)).cast("double")
    entropy = F.lit(0.0)
    for ch in ALPHABET:
        share = count(low, ch) / whole
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": (count(host, ".") + 1).cast("double"),
        "hyphens": count(host, "-").cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/").cast("double"),
        "digits": F.length(F.regexp_replace(u, r"[^0-9]", "")) / whole,
        "entropy": F.round(entropy, 6),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1).cast("double"),
    }


def featured(df: DataFrame, url: str) -> DataFrame:
    """df with a struct _f of lexical features and the array _s of its host's suffixes of 1, 2 and 3 labels."""
    host = host_of(F.col(url))
    return df.withColumn("_f", F.struct(*[c.alias(k) for k, c in lexical(url).items()])).withColumn("_s", F.array(*[suffix(host, k) for k in (1, 2, 3)]))


@dataclass
class UrlModel:
    """Trees over features, and block rates of host suffixes."""

    prior: float
    rates: DataFrame
    trees: list[tuple] = field(default_factory=list)  # (feature, threshold, left, right) or a leaf's float

    def with_rates(self, df: DataFrame) -> DataFrame:
        """df with the columns rate1, rate2 and rate3; a suffix without a rate takes that of the shorter one."""
        before = F.lit(self.prior)
        for k in (1, 2, 3):
            own = F.broadcast(self.rates.filter(F.col("k") == k).select(F.col("suffix").alias("_suffix"), F.col("rate").alias("_rate")))
            df = df.join(own, F.col("_s")[k - 1] == F.col("_suffix"), "left").withColumn(f"rate{k}", F.coalesce("_rate", before)).drop("_suffix", "_rate")
            before = F.col(f"rate{k}")
        return df

    def score(self) -> Column:
        """Log odds of `block` over the columns that with_rates() and featured() make."""
        out = F.lit(0.0)
        for tree in self.trees:
            out = out + tree_column(tree)
        return out


def feature(name: str) -> Column:
    return F.col(name) if name.startswith("rate") else F.col(f"_f.{name}")


def tree_column(tree: tuple | float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    name, limit, left, right = tree
    return F.when(feature(name) <= limit, tree_column(left)).otherwise(tree_column(right))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """A model from URLs with labels (1: block, 0: allow; null labels are left out, null URLs count as empty).

    It uses a hash sample of about max_labelled rows at most. Suffix rates come from one half of the sample, trees from
    the other, so that no row's own label is among its features. Without labelled rows, or with one label only, it has
    no trees and its score is the prior's side throughout.
    """
    rows = labelled.select(F.col(f"`{url}`").alias("_url"), F.col(f"`{label}`").cast("int").alias("_y")).filter(F.col("_y").isNotNull())
    n = rows.count()
    u = F.pmod(F.xxhash64(F.col("_url"), F.lit(7)), F.lit(1 << 30))
    rows = rows.filter(u < int((1 << 30) * min(1.0, max_labelled / max(n, 1))))
    rows = saved(featured(rows, "_url").withColumn("_half", F.pmod(F.xxhash64(F.col("_url"), F.lit(11)), F.lit(2)).cast("int")).drop("_url"), "labelled")
    prior = rows.agg(F.avg("_y")).first()[0]
    prior = 0.0 if prior is None else round(prior, 9)
    half = rows.filter("_half = 0").select(F.posexplode("_s").alias("k", "suffix"), "_y").groupBy((F.col("k") + 1).alias("k"), "suffix")
    rates = half.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y")).filter(F.col("n") >= LEAST_URLS)
    rates = saved(rates.select("k", "suffix", F.round((F.col("y") + PRIOR * prior) / (F.col("n") + PRIOR), 9).alias("rate")), "rates")
    model = UrlModel(prior, rates)
    train = saved(model.with_rates(rows.filter("_half = 1")).select("_y", *[feature(k).alias(k) for k in FEATURES]), "train")
    limits = train.agg(*[F.array_distinct(F.percentile(k, F.array(*[F.lit(q / BINS) for q in range(1, BINS)]))).alias(k) for k in FEATURES]).first()
    cuts = {k: sorted(limits[k] or []) for k in FEATURES}
    bin_of = lambda k: sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0)).cast("int")
    packed = saved(train.select("_y", F.array(*[bin_of(k) for k in FEATURES]).alias("b")).groupBy("_y", "b").agg(F.count(F.lit(1)).cast("double").alias("w")).coalesce(FILES), "bins")
    base = min(max(prior, 1e-3), 1 - 1e-3)
    import math

    start = math.log(base / (1 - base))
    model.trees = [start]
    if not 0 < prior < 1:
        return model
    grown: list = []  # over bins
    score = F.lit(start)
    for _ in range(trees):
        tree = grow(packed, score, depth, cuts)
        grown.append(tree)
        score = score + bin_column(tree)
        model.trees.append(on_values(tree, cuts))
    return model


def bin_column(tree: tuple | float) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    i, most, left, right = tree
    return F.when(F.col("b")[i] <= most, bin_column(left)).otherwise(bin_column(right))


def on_values(tree: tuple | float, cuts: dict[str, list[float]]) -> tuple | float:
    if not isinstance(tree, tuple):
        return tree
    i, most, left, right = tree
    name = FEATURES[i]
    return (name, cuts[name][most], on_values(left, cuts), on_values(right, cuts))


def grow(packed: DataFrame, score: Column, depth: int, cuts: dict[str, list[float]]) -> tuple | float:
    """One tree over bins: (feature's place, most bin of the left side, left, right) or a leaf's value."""
    p = 1 / (1 + F.exp(-score))
    rows = packed.select("b", ((F.col("_y") - p) * F.col("w")).alias("g"), (p * (1 - p) * F.col("w")).alias("h"))
    splits: dict[int, tuple[int, int]] = {}  # node -> feature, bin; node's children are 2 n and 2 n + 1
    leaves: dict[int, float] = {}
    open_nodes = [1]
    leaf = lambda g, h: round(RATE * g / (h + 1), 9)
    for level in range(depth):
        if not open_nodes:
            break
        node = place(splits, 1)
        sums = rows.withColumn("node", node).filter(F.col("node").isin(open_nodes)).select("node", F.posexplode("b").alias("f", "bin"), "g", "h")
        found = sums.groupBy("node", "f", "bin").agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("h"), 9).alias("h")).collect()  # nodes x features x bins
        coming = []
        for n in open_nodes:
            table = {(r["f"], r["bin"]): (r["g"], r["h"]) for r in found if r["node"] == n}
            g = sum(v[0] for (f, _), v in table.items() if f == 0)
            h = sum(v[1] for (f, _), v in table.items() if f == 0)
            best = (1e-6, None, (0.0, 0.0))
            for f, name in enumerate(FEATURES):
                gl = hl = 0.0
                for b in range(len(cuts[name])):
                    dg, dh = table.get((f, b), (0.0, 0.0))
                    gl, hl = gl + dg, hl + dh
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if min(hl, h - hl) > 0.1 and gain > best[0] + 1e-9:
                        best = (gain, (f, b), (gl, hl))
            if best[1] is None:
                leaves[n] = leaf(g, h)
                continue
            splits[n] = best[1]
            if level + 1 < depth:
                coming += [2 * n, 2 * n + 1]
            else:  # the last level's sums are known from the split
                gl, hl = best[2]
                leaves |= {2 * n: leaf(gl, hl), 2 * n + 1: leaf(g - gl, h - hl)}
        open_nodes = coming

    def built(n: int) -> tuple | float:
        return (*splits[n], built(2 * n), built(2 * n + 1)) if n in splits else leaves.get(n, 0.0)

    return built(1)


def place(splits: dict[int, tuple[int, int]], n: int) -> Column:
    if n not in splits:
        return F.lit(n)
    f, b = splits[n]
    return F.when(F.col("b")[f] <= b, place(splits, 2 * n)).otherwise(place(splits, 2 * n + 1))


def judge(df: DataFrame, model: UrlModel, rules: dict[str, str], url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and score (log odds of block by the trees).

    rules: rule string -> allow or block. The longest fitting rule decides, else the trees: block where the score is
    above 0. Null and other strings without :// have an empty host and path, fit no rule and are judged by the trees.
    Where df has a column of such a name, the new one gets an underscore in front.
    """
    names = [free_name(df, n) for n in ("host", "path", "rule", "verdict", "score")]
    columns = df.columns
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{url}`").alias("_url"))
    rows = model.with_rates(featured(held, "_url"))
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = rows.withColumn("_host", host).withColumn("_path", path).withColumn("_score", F.round(model.score(), 9))
    rows = rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("_rule") == rule, verdict).otherwise(said)
    verdict = F.coalesce(said, F.when(F.col("_score") > 0, "block").otherwise("allow"))
    return rows.select(*[F.col(f"_row.`{c}`") for c in columns], *[c.alias(n) for c, n in zip([F.col("_host"), F.col("_path"), F.col("_rule"), verdict, F.col("_score")], names, strict=True)])


def weak_labels(df: DataFrame, url: str = "url", terms: tuple[str, ...] = UNWANTED_TERMS) -> DataFrame:
    """(url, label): 1 where a whole word of the host is one of terms, else 0; null URLs and those without a host are left out."""
    words = F.split(host_of(F.col(f"`{url}`")), r"[^a-z]+")
    label = F.arrays_overlap(words, F.array(*map(F.lit, terms))).cast("int")
    return df.select(F.col(f"`{url}`").alias("url"), label.alias("label")).filter(host_of(F.col("url")) != "")
