"""The context question: strategies as one union, the first to name a symbol counting, then a diverse packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import detect_intent, expand, wants_tests
from ..model import Weights, top_k
from ..operators import ranking, search, vectors


def held(rows: DataFrame) -> DataFrame:
    """A few rows, bounded by the budget, made once and kept in the plan."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def strategies(symbols: DataFrame, files: DataFrame, relations: DataFrame, text: str, budget: str, w: Weights, hits: DataFrame | None = None) -> DataFrame:
    """(id, path, name, score, why, ordinal): names, symbols of matching files, their imports, siblings, vector hits."""
    k = top_k(budget)
    q = expand(text)
    shown = lambda d, rank, why: d.select("id", "path", "name", "score", "ordinal", F.lit(rank).alias("rank"), F.lit(why).alias("why"))
    by_name = search.scored(symbols, q).withColumn("score", F.col("score") * w.exact_name).orderBy(F.desc("score"), "ordinal").limit(4 * k)
    by_name = held(by_name.select("id", "path", "name", "score", "ordinal"))  # 4 k rows, scored once for all strategies
    matched = search.find_files(files, symbols, text, k)
    in_files = symbols.join(matched.select("path", F.col("score").alias("file_score")), "path")
    relevant = C.any_of([C.name_strength(t, F.col("name_lower"), F.col("name_words")) > 0 for t in q.tokens])
    own = in_files.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc(relevant), "ordinal"))).filter("place <= 3")
    own = own.withColumn("score", F.col("file_score") * w.file_symbols)
    near = relations.filter("kind = 'imports'").join(files.select(F.col("id").alias("source_id"), "path").join(matched.select("path"), "path"), "source_id").select(F.col("target_id").alias("file_id")).distinct()
    imported = symbols.join(near, "file_id", "left_semi").filter("exported").orderBy("ordinal").limit(2 * k).withColumn("score", F.lit(w.import_neighbours))
    siblings = symbols.join(by_name.select("path").distinct(), "path", "left_semi").filter(relevant | F.col("exported"))
    siblings = siblings.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc(relevant), F.desc("exported"), "ordinal"))).filter("place <= 3").withColumn("score", F.lit(w.siblings))
    rows = shown(by_name, 0, "name match").unionByName(shown(own, 1, "in matching file")).unionByName(shown(imported, 2, "imported by match")).unionByName(shown(siblings, 3, "beside match"))
    if hits is not None:
        best = by_name.agg(F.max("score")).first()[0] or 0.0
        blended = vectors.blend(hits, by_name.select("id", "score"), best, w)
        rows = rows.unionByName(shown(blended.drop("path").join(symbols.drop("score") if "score" in symbols.columns else symbols, "id"), 4, "vector match"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).filter("place = 1").drop("place", "rank")
    demotion = F.lit(1.0) if wants_tests(q.words) else F.when(C.is_test_path(F.col("path")), w.test_demotion).otherwise(1.0)
    return first.withColumn("score", F.round(F.col("score") * demotion, 6))


def ask(symbols: DataFrame, files: DataFrame, relations: DataFrame, text: str, budget: str = "small", weights: Weights | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, intent, rank, path, name, score, why): the packet that answers a question."""
    w = weights or Weights()
    pool = held(strategies(symbols, files, relations, text, budget, w, hits).withColumn("query_id", F.lit(text)))  # some rows for each of 4 k names and k files
    picked = ranking.diverse(pool, top_k(budget), w)
    why = pool.groupBy("path", "name").agg(F.max_by("why", "score").alias("why"))
    return picked.join(why, ["path", "name"]).select("query_id", F.lit(detect_intent(text.lower().split())).alias("intent"), "rank", "path", "name", "score", "why")


def edit_context(symbols: DataFrame, relations: DataFrame, lines: DataFrame, memories: DataFrame, name: str) -> DataFrame:
    """One row for a symbol to edit: body, neighbours in its file (30), callers (10) and their count, rationale (5)."""
    own = symbols.filter(F.col("name_lower") == name.lower()).orderBy("ordinal").limit(1)
    held = own.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("span.start_line").alias("a"), F.col("span.end_line").alias("b"))
    body = lines.join(F.broadcast(held), (F.col("path") == F.col("o_path")) & F.col("line").between(F.col("a"), F.col("b"))).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    beside = symbols.join(F.broadcast(held), F.col("path") == F.col("o_path")).filter("id <> o_id").orderBy("ordinal").limit(30).agg(F.collect_list("name").alias("neighbours"))
    calling = relations.filter("kind = 'calls'").join(F.broadcast(held), F.col("target_id") == F.col("o_id")).select(F.col("source_id").alias("id")).distinct()
    shown = symbols.join(calling, "id", "left_semi").orderBy("ordinal").limit(10).agg(F.collect_list("name").alias("callers"))
    said = memories.join(F.broadcast(held), (F.col("symbol_id") == F.col("o_id")) | ((F.col("path") == F.col("o_path")) & (F.col("line_range.start") <= F.col("b")) & (F.col("line_range.end") >= F.col("a"))))
    reasons = said.orderBy(F.desc("weight"), "id").limit(5).agg(F.collect_list(F.col("text")).alias("rationale"))
    return own.select("id", "path", "name", "signature").crossJoin(body).crossJoin(beside).crossJoin(shown).crossJoin(calling.agg(F.count(F.lit(1)).alias("n_callers"))).crossJoin(reasons)
