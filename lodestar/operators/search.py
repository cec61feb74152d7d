"""Name, path and concept search over symbols and files.

Scores are columns over literals that the driver prepared, so a search is one projection over a scan, and its top-k a
TakeOrderedAndProject. Several questions at once are a union of such projections over one cached table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import Query, Token, expand


def with_search_columns(symbols: DataFrame) -> DataFrame:
    """symbols with name_lower, sig_lower, path_lower and name_words; written at index time, so that searches only read them."""
    return symbols.withColumns({
        "name_lower": F.lower("name"), "sig_lower": F.lower(F.coalesce("signature", F.lit(""))), "path_lower": F.lower("path"),
        "name_words": C.identifier_words(F.col("name")),
    })


def token_strengths(t: Token, stems: Column | None) -> tuple[Column, Column]:
    """How strongly a token is in a symbol's name, and in its signature or path."""
    name = C.name_strength(t, F.col("name_lower"), F.col("name_words"), stems)
    return name, F.greatest(C.text_strength(t, F.col("sig_lower")), C.text_strength(t, F.col("path_lower")))


def strength(phrase: Column, name: Column, text: Column) -> Column:
    """A token's strength in a question: over 0 in the name, under 0 in the rest; 1 throughout where the phrase is there."""
    return F.when(phrase > 0, 1.0).when(name > 0, name).otherwise(-text)


def rarity(used: list[Column], names: list[str]) -> list[Column]:
    """The weight of each token, ln(1 + n / (1 + df)) over the symbols that match any, as aggregates."""
    n = F.sum(F.when(C.any_of([s != 0 for s in used]), 1).otherwise(0))
    return [F.log(1 + n / (1 + F.sum(F.when(s != 0, 1).otherwise(0)))).alias(name) for s, name in zip(used, names, strict=True)]


def combined(q: Query, phrase: Column, used: list[Column], weights: list[Column]) -> Column:
    """A symbol's score from its phrase score, or the strengths weighed by rarity."""
    whole = sum(weights, F.lit(0.0))
    ratio = sum((F.abs(s) * w for s, w in zip(used, weights, strict=True)), F.lit(0.0)) / whole
    score = F.least(F.when(C.any_of([s > 0 for s in used]), ratio * 0.9 + C.name_bonus(q, F.col("name_lower"), F.col("name_words"))).otherwise(ratio * 0.6), F.lit(0.94))
    return F.when(phrase > 0, phrase).otherwise(score)


def multi_scored(symbols: DataFrame, q: Query) -> DataFrame:
    """symbols with `score` for a question of several tokens: phrase, or strengths weighed by rarity.

    The weights are one row of partial sums, joined by broadcast: its size is the number of tokens.
    """
    stems = F.col("name_word_stems") if "name_word_stems" in symbols.columns else None
    phrase = C.phrase_score(q, F.col("name_lower"), F.col("sig_lower"))
    own = [strength(F.col("phrase"), *token_strengths(t, stems)) for t in q.tokens]
    s, w = [f"s{i}" for i in range(len(own))], [f"w{i}" for i in range(len(own))]
    rows = symbols.withColumn("phrase", phrase).withColumns(dict(zip(s, own, strict=True)))
    used = [F.col(c) for c in s]
    rows = rows.filter(C.any_of([c != 0 for c in used]))
    scored = rows.crossJoin(F.broadcast(rows.agg(*rarity(used, w)))).withColumn("score", combined(q, F.col("phrase"), used, [F.col(c) for c in w]))
    return scored.drop("phrase", *s, *w)


#: Questions whose scores one plan makes at once.
BATCH = 20


def batch(symbols: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(question, id, score, place): find_symbol() for many questions in two scans for each BATCH of them.

    The first scan sums the rarity of all tokens into one row; the second scores every question at each symbol, so that
    the table is read once however many questions there are, and keeps k rows a question in each task.
    """
    out = None
    stems = F.col("name_word_stems") if "name_word_stems" in symbols.columns else None
    for start in range(0, len(texts), BATCH):
        asked = list(enumerate(map(expand, texts[start : start + BATCH])))
        several = {i: q for i, q in asked if len(q.tokens) > 1}
        # Tokens, strengths and scores are columns of their own projections: each is made once, a token's for all questions.
        tokens = {t: k for k, t in enumerate(dict.fromkeys(t for q in several.values() for t in q.tokens))}
        held, cols = symbols, {}
        if several:
            held = held.withColumns({f"{side}{k}": c for t, k in tokens.items() for side, c in zip("tx", token_strengths(t, stems), strict=True)} | {f"p{i}": C.phrase_score(q, F.col("name_lower"), F.col("sig_lower")) for i, q in several.items()})
            cols = {i: ([strength(F.col(f"p{i}"), F.col(f"t{tokens[t]}"), F.col(f"x{tokens[t]}")) for t in q.tokens], [f"w{i}_{j}" for j in range(len(q.tokens))]) for i, q in several.items()}
            held = held.crossJoin(F.broadcast(held.agg(*[c for s, w in cols.values() for c in rarity(s, w)])))
        scores = {i: C.single_score(q.tokens[0], F.col("name_lower"), F.col("name_words")) for i, q in asked if len(q.tokens) == 1}
        scores |= {i: F.when(C.any_of([c != 0 for c in s]), combined(several[i], F.col(f"p{i}"), s, [F.col(c) for c in w])).otherwise(0.0) for i, (s, w) in cols.items()}
        whole = lambda q, s: F.when(F.col("name") == q.text, 1.01).when(F.col("name_lower") == q.text.lower(), 1.0).otherwise(s)
        held = held.select("id", "ordinal", *[whole(q, scores.get(i, F.lit(0.0))).cast("double").alias(f"score{i}") for i, q in asked])
        all_ = F.array(*[F.struct(F.lit(start + i).alias("n"), F.col(f"score{i}").alias("score")) for i, _ in asked])
        rows = held.select("id", "ordinal", F.explode(all_).alias("s")).filter("s.score > 0").select(F.col("s.n").alias("n"), "id", "ordinal", "s.score")
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "ordinal"))
    names = F.element_at(F.array(*map(F.lit, texts)), F.col("n") + 1)
    return out.withColumn("place", place).filter(F.col("place") <= k).select(names.alias("question"), "id", "score", "place")


def scored(symbols: DataFrame, q: Query) -> DataFrame:
    """symbols that match the question, with `score`; a name that is the question counts 1.0, in its case 1.01."""
    if len(q.tokens) > 1:
        rows = multi_scored(symbols, q)
    elif q.tokens:
        rows = symbols.withColumn("score", C.single_score(q.tokens[0], F.col("name_lower"), F.col("name_words")))
    else:
        rows = symbols.withColumn("score", F.lit(0.0))
    whole = F.when(F.col("name") == q.text, 1.01).when(F.col("name_lower") == q.text.lower(), 1.0).otherwise(F.col("score"))
    return rows.withColumn("score", whole).filter("score > 0")


def find_symbol(symbols: DataFrame, text: str, k: int) -> DataFrame:
    return scored(symbols, expand(text)).orderBy(F.desc("score"), "ordinal").limit(k)


def get_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name, else of Parent.method."""
    parent, _, method = name.lower().partition(".")
    exact = F.col("name_lower") == name.lower()
    dotted = (F.col("name_lower") == method) & F.lower(F.coalesce("parent_symbol_id", F.lit(""))).contains(parent) if method else F.lit(False)
    return symbols.filter(exact | dotted).orderBy(F.desc(exact), "ordinal").limit(1)


def find_files(files: DataFrame, symbols: DataFrame, text: str, k: int, scope: str | None = None) -> DataFrame:
    """(path, score, reason): the better of the path's score and 0.8 times that of the file's best symbol.

    A scope (path prefix) filters before the top-k.
    """
    q = expand(text)
    best = scored(symbols, q).groupBy("path").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("ordinal"))).alias("best"))
    rows = files.filter(F.col("path").startswith(scope)) if scope else files
    rows = rows.select("path").join(best, "path", "left")
    by_path, by_symbol = C.path_score(q, F.lower("path")), F.coalesce(F.col("best.score") * 0.8, F.lit(0.0))
    rows = rows.withColumn("score", F.greatest(by_path, by_symbol))
    reason = F.when(by_symbol > by_path, F.concat(F.lit("symbol "), F.col("best.name"))).otherwise("path")
    return rows.filter("score > 0").select("path", "score", reason.alias("reason")).orderBy(F.desc("score"), "path").limit(k)


def find_related(files: DataFrame, symbols: DataFrame, relations: DataFrame, path: str, k: int) -> DataFrame:
    """(path, score): files near a file by relations, directory, shared prefix, shared names, stem and language."""
    target = files.filter((F.col("path") == path) | F.col("path").endswith(path) | F.lit(path).endswith(F.col("path"))).orderBy("path").limit(1)
    target = target.select(F.col("id").alias("t_id"), F.col("path").alias("t_path"), F.col("language").alias("t_language"))
    weight = lambda out: F.when(F.col("kind") == "imports", 0.7 if out else 0.6).when(F.col("kind") == "test_for", 0.8).when(F.col("kind") == "config_for", 0.4).otherwise(0.0)
    held = F.broadcast(target)  # one row
    out = relations.join(held, F.col("source_id") == F.col("t_id")).select(F.col("target_id").alias("id"), weight(True).alias("w"))
    back = relations.join(held, F.col("target_id") == F.col("t_id")).select(F.col("source_id").alias("id"), weight(False).alias("w"))
    edges = out.unionByName(back).groupBy("id").agg(F.sum("w").alias("edges"))
    names = symbols.select(F.col("file_id").alias("id"), F.col("name_lower")).distinct()
    own = names.join(held, F.col("id") == F.col("t_id")).select("name_lower")
    shared = names.join(own, "name_lower").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    n_own = own.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_own"))
    rows = files.crossJoin(held).crossJoin(F.broadcast(n_own)).filter("path <> t_path").join(edges, "id", "left").join(shared, "id", "left")
    a, b = F.split("t_path", "/"), F.split("path", "/")
    equal = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    prefix = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal))
    stem = lambda c: F.regexp_replace(F.lower(C.file_name(F.col(c))), r"\.[^.]*$", "")
    pair = C.is_test_path(F.col("path")) | C.is_test_path(F.col("t_path"))
    score = (
        F.coalesce("edges", F.lit(0.0))
        + F.when((C.dir_of(F.col("path")) == C.dir_of(F.col("t_path"))) & (C.dir_of(F.col("t_path")) != ""), 0.3).otherwise(0.0)
        + prefix / F.size(a) * 0.2
        + F.least(F.coalesce("shared", F.lit(0)) / F.col("n_own"), F.lit(1.0)) * 0.3
        + F.when(stem("path").contains(stem("t_path")) | stem("t_path").contains(stem("path")), F.when(pair, 0.3).otherwise(0.1)).otherwise(0.0)
        + F.when(F.col("language").eqNullSafe(F.col("t_language")), 0.05).otherwise(0.0)
    )
    return rows.withColumn("score", F.round(score, 6)).filter("score > 0.05").select("path", "score").orderBy(F.desc("score"), "path").limit(k)


def semantic_keyword(symbols: DataFrame, text: str, k: int, demotion: float = 0.5) -> DataFrame:
    """The keyword form of a concept search: variants count, test code is demoted."""
    rows = scored(symbols, expand(text)).withColumn("score", F.col("score") * F.when(C.is_test_path(F.col("path")), demotion).otherwise(1.0))
    return rows.orderBy(F.desc("score"), "ordinal").limit(k)


def best_definition(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """For each `wanted` name the best of the symbols of that name: source over test, exact case, kind, size, exported."""
    rank = F.when(F.col("kind").isin("struct", "class", "enum", "trait", "interface"), 0).when(F.col("kind").isin("function", "method"), 1).otherwise(2)
    size = F.col("span.end_line") - F.col("span.start_line")
    order = [F.col("test"), F.desc(F.col("name") == F.col("wanted")), rank, F.desc(size), F.desc("exported"), F.col("ordinal")]
    rows = symbols.withColumn("test", C.is_test_path(F.col("path"))).join(names, F.col("name_lower") == F.lower("wanted"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("wanted").orderBy(*order))).filter("place = 1").drop("place", "test")


def key_symbols(symbols: DataFrame, n: int) -> DataFrame:
    """The first n symbols of each file, exported ones first."""
    w = Window.partitionBy("path").orderBy(F.desc("exported"), "span.start_line", "ordinal")
    return symbols.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def grep(lines: DataFrame, words: list[str], files: int) -> DataFrame:
    """(path, line, text): the first line of each of the first `files` paths that holds any of the words."""
    hit = C.any_of([F.lower("text").contains(w) for w in words])
    return lines.filter(hit).groupBy("path").agg(F.min_by(F.struct("line", "text"), "line").alias("l")).select("path", "l.line", "l.text").orderBy("path").limit(files)


def keyword_lines(lines: DataFrame, words: list[str]) -> DataFrame:
    """(path, line, text, gap): lines that hold a word and their neighbours; gap marks a jump from the line shown before."""
    w = Window.partitionBy("path").orderBy("line")
    hit = C.any_of([F.lower("text").contains(x) for x in words]).cast("int")
    near = lines.withColumn("near", F.max(hit).over(w.rowsBetween(-1, 1))).filter("near = 1")
    gap = F.coalesce(F.col("line") - F.lag("line").over(w) > 1, F.lit(False))
    return near.select("path", "line", "text", gap.alias("gap"))


def in_scope(rows: DataFrame, prefix: str, path: Column | str = "path") -> DataFrame:
    return rows.filter((F.col(path) if isinstance(path, str) else path).startswith(prefix))
