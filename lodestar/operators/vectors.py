"""Cosine search over unit vectors, and blending its hits with name matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import dot
from ..model import Weights

TRUSTED, MARGIN, ADDED_AT_MOST, PER_FILE = 0.75, 0.02, 10, 1
#: Queries that a batch broadcasts at a time: 384 dimensions of 4 bytes are 1.5 MB for 1000.
QUERY_BLOCK = 1000
#: Vectors of one block where queries go in blocks.
VECTOR_BLOCK = 100_000


def top_k(vectors: DataFrame, query: list[float], k: int, least: float = -1.0) -> DataFrame:
    """(id, cosine): the k nearest of all vectors, in one scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(dot(F.col("embedding"), q), 6).alias("cosine")).filter(F.col("cosine") >= least).orderBy(F.desc("cosine"), "id").limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, cosine, place): the k nearest for each query of (query, q), in one plan whatever their number.

    Up to QUERY_BLOCK queries go past all vectors by broadcast. More are dealt into blocks of about that size, and
    vectors into blocks of VECTOR_BLOCK; both are joined by their numbers. Windows that rank under a limit keep k rows
    of a query in each task before the shuffle. Queries that share an id are ranked by themselves; null ids stay.
    """
    n = queries.count()
    queries = queries.select("query", "q", F.xxhash64("query", "q").alias("own"))
    cosine = F.round(dot(F.col("embedding"), F.col("q")), 6).alias("cosine")
    if n <= QUERY_BLOCK:
        pairs = vectors.crossJoin(F.broadcast(queries)).select("query", "own", "id", cosine)
    else:
        blocks, parts = -(-n // QUERY_BLOCK), max(1, -(-vectors.count() // VECTOR_BLOCK))
        left = queries.withColumn("block", F.pmod("own", F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = left.join(right, ["block", "part"]).select("query", "own", "id", cosine)
    place = F.row_number().over(Window.partitionBy("query", "own").orderBy(F.desc("cosine"), "id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).select("query", "id", "cosine", "place")


class HashingEmbedder:
    """An embedder that needs no model: words hashed into `size` signed places, normalised. Same texts, same vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm > 1e-9 else v)
        return out


def embedded(rows: DataFrame, embedder: HashingEmbedder) -> DataFrame:
    """(id, embedding, digest) of rows (id, text, digest), in Arrow batches; embedder: anything with embed(texts)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield b[["id", "digest"]].assign(embedding=embedder.embed(list(b["text"])))[["id", "embedding", "digest"]]

    return rows.select("id", "text", "digest").mapInPandas(run, f"id {kind}, embedding array<float>, digest string")


def synced(vectors: DataFrame, live: DataFrame, embedder: HashingEmbedder) -> DataFrame:
    """vectors brought up to live (id, text, digest): what is gone is dropped, what is new or changed embedded, the rest kept."""
    todo, _ = stale(vectors, live)
    kept = vectors.join(live.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "embedding", "digest")
    return kept.unionByName(embedded(todo, embedder))


def coverage(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """One row: live rows, those with a vector of their text, those to embed, vectors to drop, whether to rewrite the store."""
    todo, gone = stale(vectors, live)
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    row = n(live, "live").crossJoin(n(todo, "to_embed")).crossJoin(n(gone, "to_drop"))
    full = F.col("live") + F.col("to_drop")
    return row.withColumns({"current": F.col("live") - F.col("to_embed"), "compact": (F.col("to_drop") > 0) & ((F.col("to_drop") * 4 > full) | (full < 4096))})


def vector_score(cosine: Column, best_name: Column, w: Weights) -> Column:
    """A ramp from vector_score to vector_strong_score; under TRUSTED capped below the best name match."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - w.vector_min_score) / (1 - w.vector_min_score)))
    ramp = w.vector_score + t * (w.vector_strong_score - w.vector_score)
    return F.when((cosine < TRUSTED) & (best_name > 0), F.least(ramp, best_name - MARGIN)).otherwise(ramp)


def blend(hits: DataFrame, known: DataFrame, best_name: float, w: Weights | None = None) -> DataFrame:
    """(id, path, score, reason) of vector hits (id, path, cosine) beside known (id, score).

    A known id is raised where the vector says more. New ones: the nearest of each file, ten in all.
    """
    w = w or Weights()
    rows = hits.filter(F.col("cosine") >= w.vector_min_score).withColumn("vector", vector_score(F.col("cosine"), F.lit(best_name), w)).filter("vector > 0")
    rows = rows.join(known.select("id", F.col("score").alias("before")), "id", "left")
    raised = rows.filter("before < vector")
    fresh = rows.filter("before is null").withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cosine"), "id"))).filter(F.col("place") <= PER_FILE)
    fresh = fresh.orderBy(F.desc("cosine"), "id").limit(ADDED_AT_MOST).drop("place")
    reason = F.concat(F.lit("vector match ("), F.format_number("cosine", 2), F.lit(" cosine)"))
    return raised.unionByName(fresh).select("id", "path", F.round("vector", 6).alias("score"), reason.alias("reason"))


def stale(vectors: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to embed anew (no vector of this digest) and which vectors to drop (no live row)."""
    return live.join(vectors.select("id", "digest"), ["id", "digest"], "left_anti"), vectors.join(live.select("id"), "id", "left_anti")


def embed_text(symbols: DataFrame) -> DataFrame:
    """(id, text, digest) of symbols to embed: kind, words of the name, signature, doc and path."""
    words = F.array_join(C.identifier_words(F.col("name")), " ")
    text = F.concat_ws(" ", "kind", words, "signature", "doc_summary", "path")
    return symbols.select("id", text.alias("text")).withColumn("digest", F.sha2("text", 256))


def needs_compaction(live: int, dead: int) -> bool:
    """Rewrite a store with over a quarter of dead rows, or a small one with any."""
    return dead > 0 and (dead * 4 > live + dead or live + dead < 4096)
