"""Column builders: matching, scoring and path predicates in built-in functions, so that scoring stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LANGUAGES
from .text import BOUNDARY, Query, Token, camel, stem_variants

EXACT, STEM, SYNONYM = 1.0, 0.95, 0.72
#: Directories and file-name endings that mark tests.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "testdata")
TEST_NAME = r"(?i)(_test|_tests|_unittest|_spec)(\.[^./]*)?$|\.(test|spec)\."
#: File tag -> what a path segment, file name or import must hold.
FILE_TAGS = {
    "entrypoint": ("main", "index", "app", "server", "__main__"),
    "config": ("config", "settings", "conf", "env"),
    "auth": ("auth", "login", "session", "oauth", "jwt"),
    "database": ("db", "database", "sql", "migrations", "models", "schema"),
    "http": ("http", "api", "routes", "handlers", "controllers"),
    "cli": ("cli", "cmd", "commands"),
    "types": ("types", "interfaces", "dto"),
}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def identifier_words(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, BOUNDARY), F.lower), lambda w: w != "")


def words_within(words: Column, variant: str, whole: Column) -> Column:
    """A whole word, or from four letters on any part of the name."""
    hit = F.array_contains(words, variant)
    return hit | whole.contains(variant) if len(variant.encode()) >= 4 else hit


def name_strength(t: Token, name: Column, words: Column, word_stems: Column | None = None) -> Column:
    """How strongly a token is in a name: exact, stem (from either side) or synonym; else 0."""
    stems = any_of([words_within(words, s, name) for s in t.stems])
    if word_stems is not None:
        stems = stems | F.array_contains(word_stems, t.exact)
    synonyms = any_of([words_within(words, s, name) for s in t.synonyms])
    return F.when(words_within(words, t.exact, name), EXACT).when(stems, STEM).when(synonyms, SYNONYM).otherwise(0.0)


def contains_word(text: Column, word: str) -> Column:
    """word between characters that are neither letters nor digits."""
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}])\Q{word}\E([^\p{{L}}\p{{N}}]|$)")


def text_strength(t: Token, text: Column) -> Column:
    """How strongly a token is in a signature or path; short tokens only as whole words."""
    own = text.contains(t.exact) if len(t.exact.encode()) >= 4 else contains_word(text, t.exact)
    some = lambda variants: any_of([text.contains(v) for v in variants if len(v.encode()) >= 4])
    return F.when(own, EXACT).when(some(t.stems), STEM).when(some(t.synonyms), SYNONYM).otherwise(0.0)


def coverage(part: str, whole: Column) -> Column:
    return F.lit(float(len(part.encode()))) / F.octet_length(whole)


def single_score(t: Token, name: Column, words: Column, name_stems: Column | None = None) -> Column:
    """The graded match of one token with a lower-case name; below all tiers a synonym that the name holds."""
    q = t.exact
    tiers = F.when(name == q, 1.0).when(name.startswith(q), 0.9).when(name.contains(q), 0.4 + coverage(q, name) * 0.4)
    roots = [s for s in t.stems if s not in stem_variants(q)]
    for s in (s for s in t.stems if s not in roots):
        tiers = tiers.when(name.contains(s), 0.35 + coverage(s, name) * 0.3)
    for r in roots:
        tiers = tiers.when(name.contains(r), 0.4)
    if name_stems is not None:
        tiers = tiers.when(F.array_contains(name_stems, q), 0.55)
        tiers = tiers.when(F.exists(name_stems, lambda s: s.contains(q) | F.lit(q).contains(s)), 0.4)
    if len(q.encode()) >= 4:
        tiers = tiers.when(name.rlike(".*".join(rf"\Q{c}\E" for c in q)), 0.2 + coverage(q, name) * 0.2)
    fallback = F.lit(0.0)
    for s in t.synonyms:
        fallback = F.greatest(fallback, F.when(words_within(words, s, name), 0.3 + F.least(coverage(s, name), F.lit(1.0)) * 0.35).otherwise(0.0))
    return tiers.otherwise(fallback)


def phrase_score(q: Query, name: Column, signature: Column) -> Column:
    """0.98 for a name that is the phrase, 0.95 for one (or a signature) that holds it, else 0."""
    spaced, snake, joined = " ".join(q.words), "_".join(q.words), "".join(q.words)
    whole = name.isin(list(dict.fromkeys([spaced, snake, joined, camel(q.words).lower()])))
    part = any_of([name.contains(p) for p in (spaced, snake, joined)] + [signature.contains(p) for p in (spaced, snake)])
    return F.when(whole, 0.98).when(part, 0.95).otherwise(0.0)


def name_bonus(q: Query, name: Column, words: Column) -> Column:
    """0.04 by the share of name words that tokens explain, 0.03 if two tokens stand side by side."""
    explained = F.filter(words, lambda w: any_of([w.contains(t) for t in q.words]))
    pairs = [name.contains(a + s + b) for a, b in zip(q.words, q.words[1:], strict=False) for s in ("", "_")]
    return 0.04 * F.size(explained) / F.greatest(F.size(words), F.lit(1)) + F.when(any_of(pairs), 0.03).otherwise(0.0)


def path_score(q: Query, path: Column) -> Column:
    """How well a lower-case path answers a question."""
    if len(q.tokens) > 1:
        return sum((text_strength(t, path) for t in q.tokens), F.lit(0.0)) / len(q.tokens)
    if not q.tokens:
        return F.lit(0.0)
    whole = q.text.lower()
    s = text_strength(q.tokens[0], path)
    weaker = F.when(s >= EXACT, 0.6).when(s >= STEM, 0.5).when(s > 0, 0.4).otherwise(0.0)
    return F.when(F.substring_index(path, "/", -1).contains(whole), 0.9).when(path.contains(whole), 0.6).otherwise(weaker)


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(extension(path))), F.lit("unknown"))


def is_test_path(path: Column) -> Column:
    """A test directory on the way, or a file name that marks a test."""
    dirs = F.transform(F.split(path, "/"), F.lower)
    name = file_name(path)
    own = name.rlike(r"^(?i:test_.*|conftest)\.py$|^(?i:test_.*)\.(c|cc|cpp|cxx)$|^(?i:tests?)\.rs$|.Tests?\.(java|kt|cs)$")
    return F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS))) | name.rlike(TEST_NAME) | own


def file_tags(path: Column) -> Column:
    """Tags that segments and the stem of a path give, in the order tests, then FILE_TAGS."""
    parts = F.split(F.lower(path), r"[/._-]+")
    tags = [F.when(is_test_path(path), "tests")] + [F.when(F.arrays_overlap(parts, F.array(*map(F.lit, own))), tag) for tag, own in FILE_TAGS.items()]
    return F.array_compact(F.array(*tags))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_sentence(text: Column, n: int) -> Column:
    """Up to the first full stop before a space; longer ones cut with three dots within n characters."""
    one = F.trim(F.substring_index(text, ". ", 1))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 3), F.lit("..."))).otherwise(one)


def paths_overlap(a: Column, b: Column) -> Column:
    return a.endswith(b) | b.endswith(a)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-9, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def compression_ratio(raw: Column, served: Column) -> Column:
    return F.when((raw > 0) & (served > 0), raw / served)


def risk_level(entries: Column, test_files: Column) -> Column:
    return F.when((entries > 20) | (test_files > 5), "HIGH").when((entries > 5) | (test_files > 2), "MEDIUM").otherwise("LOW")


def comment_kind(text: Column) -> Column:
    """todo, fixme, note, hack, xxx by prefix, else regular."""
    t = F.upper(F.trim(text))
    out = F.lit("regular")
    for k in ("XXX", "HACK", "NOTE", "FIXME", "TODO"):
        out = F.when(t.startswith(k), k.lower()).otherwise(out)
    return out


#: What a memory of a kind weighs.
KIND_WEIGHTS = {"fixme": 0.9, "decision": 0.9, "todo": 0.8, "note": 0.7, "hack": 0.7, "xxx": 0.7, "doc": 0.6, "doc_section": 0.5}


def kind_weight(kind: Column) -> Column:
    out = F.lit(0.5)
    for k, w in KIND_WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def intent_of(text: Column) -> Column:
    """The intent of the first trigger word of a text; lookup without any."""
    from .text import INTENTS

    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    by = F.create_map(*[F.lit(x) for k, own in INTENTS.items() for w in own for x in (w, k)])
    hits = F.filter(F.transform(words, lambda w: F.try_element_at(by, w)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("lookup"))


def memory_terms(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct lower-case terms of three characters or more that are no stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(list(stop))))


def version_of(tag: Column) -> Column:
    """A release tag like v2.6.1-rc1 as its three numbers (the last 0 where missing); null for anything else."""
    form = r"^\s*v*([0-9]+)\.([0-9]+)(?:\.([0-9]+))?(?:[-+].*)?\s*$"
    part = lambda i: F.regexp_extract(tag, form, i)
    return F.when(tag.rlike(form), F.array(part(1).cast("long"), part(2).cast("long"), F.coalesce(F.nullif(part(3), F.lit("")).cast("long"), F.lit(0))))


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether one release tag is above another; false where either is none."""
    a, b = version_of(candidate), version_of(current)
    order = F.when(a[0] != b[0], a[0] > b[0]).when(a[1] != b[1], a[1] > b[1]).otherwise(a[2] > b[2])
    return F.coalesce(order, F.lit(False))
