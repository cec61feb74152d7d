"""Query text, analysed once on the driver: identifiers, stems, synonyms, intent. Results become literals in columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_TOKENS, MAX_SYNONYMS = 10, 16

#: Word boundaries inside an identifier, for Java's and Python's regular expressions alike (ASCII classes in the latter).
BOUNDARY = r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"

#: Suffix families, longest first. The first family with a matching suffix gives the candidates: each
#: ending is put behind what the suffix leaves; "=" stands for the suffix without its last letter, "~" for the rest
#: with one of two equal final consonants dropped, "!" for a final i turned into y.
STEM_RULES = (
    (("ization", "isation"), ("ize", "e", "")),
    (("ication",), ("icate", "y", "ic", "")),
    (("ations",), ("ation", "", "e", "ate")),
    (("ation",), ("", "e", "ate")),
    (("ies",), ("y", "")),
    (("ied",), ("y",)),
    (("tion",), ("", "te", "e")),
    (("sion",), ("", "t", "e")),
    (("ment",), ("",)),
    (("ness",), ("", "!")),
    (("ing",), ("", "e", "~")),
    (("eed",), ("=",)),
    (("ed",), ("", "e", "~")),
    (("ers", "ors"), ("=", "", "e", "~")),
    (("er", "or"), ("", "e", "~")),
    (("ity",), ("", "e")),
    (("able", "ible"), ("", "e")),
    (("less", "ful", "ous", "ive", "ize", "ise", "ly", "al"), ("",)),
    (("es",), ("", "e")),
)

#: A starting vocabulary of interchangeable words; pass your own groups to expand() for a project's.
SYNONYMS = (
    ("auth", "authentication", "login", "signin"), ("config", "configuration", "settings", "options"), ("db", "database", "storage", "store"),
    ("delete", "remove", "drop"), ("create", "make", "new", "build"), ("fetch", "get", "load", "retrieve"), ("update", "modify", "change"),
    ("error", "exception", "failure"), ("log", "logger", "logging", "trace"), ("msg", "message"), ("req", "request"), ("resp", "response", "reply"),
    ("ctx", "context"), ("ws", "websocket"), ("small", "tiny", "little"), ("big", "large", "huge"), ("init", "initialize", "setup"), ("exec", "execute", "run"),
    ("param", "parameter", "argument", "arg"), ("doc", "document", "documentation"),
)

#: Words that decide a question's intent, the first one found counting.
INTENTS = {
    "lookup": ("find", "where", "locate", "show", "get", "lookup", "search"),
    "debug": ("bug", "fix", "error", "crash", "broken", "fail", "debug", "wrong", "issue", "panic"),
    "understand": ("how", "explain", "understand", "what", "why", "does", "works", "overview"),
    "impact": ("impact", "affects", "uses", "calls", "callers", "consumers", "depends", "dependents", "change", "refactor", "rename", "remove", "delete"),
}
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")


def split_identifier(name: str) -> list[str]:
    """Lower-case words of an identifier: camel, Pascal, snake and kebab case, digits apart, acronyms together."""
    words, start = [], 0
    for i in range(1, len(name) + 1):
        if i < len(name):
            a, b = name[i - 1], name[i]
            after = name[i + 1] if i + 1 < len(name) else ""
            case = b.isupper() and (a.islower() or (a.isupper() and after.islower()))
            digit = (a in "0123456789") != (b in "0123456789")
            if a.isalnum() and b.isalnum() and not case and not digit:
                continue
        piece = "".join(c for c in name[start:i] if c.isalnum())
        if piece:
            words.append(piece.lower())
        start = i
    return words


def double_consonant(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and s[-1].isalpha() and s[-1] not in "aeiou"


def stem_variants(word: str) -> list[str]:
    """Candidate stems of an ASCII word of four letters or more, the likeliest first, without the word itself."""
    if len(word) < 4 or not word.isascii():
        return []
    found: list[str] = []
    for suffixes, endings in STEM_RULES:
        suffix = next((s for s in suffixes if word.endswith(s)), None)
        if suffix is None:
            continue
        rest = word[: len(word) - len(suffix)]
        for ending in endings:
            if ending == "=":
                found.append(word[:-1])
            elif ending == "~":
                found += [rest[:-1]] if double_consonant(rest) else []
            elif ending == "!":
                found += [rest[:-1] + "y"] if rest.endswith("i") else []
            else:
                found.append(rest + ending)
        break
    else:
        if word.endswith("s") and not word.endswith(("ss", "us", "is")):
            found.append(word[:-1])
    return list(dict.fromkeys(s for s in found if len(s) >= 3 and s != word))


def short_root(word: str) -> str | None:
    """The beginning that an abbreviation of a long word keeps: up to the first change between vowel and consonant."""
    if len(word) < 8 or not word.isascii() or "_" in word or "-" in word:
        return None
    vowel = [c in "aeiou" for c in word]
    cut = next((n for n in (4, 5, 6) if vowel[n] != vowel[n - 1]), 4 if len(word) >= 10 else None)
    return word[:cut] if cut else None


def synonyms_for(token: str, stems: list[str], groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> list[str]:
    """Other members of the groups that hold the token or one of its stems, and their stems; MAX_SYNONYMS at most."""
    own = {token, *stems}
    found = list(dict.fromkeys(m for g in groups if own & set(g) for m in g if m not in own))
    more = [v for s in found for v in stem_variants(s) if len(v) >= 4 and v != token]
    return list(dict.fromkeys(found + more))[:MAX_SYNONYMS]


def abbreviates(short: str, long: str) -> bool:
    """Whether a word is a usual short form: a beginning of three letters or more, or the first letter and consonants in order."""
    if not (2 <= len(short) < len(long) and short[0] == long[0] and short.isascii() and long.isascii()):
        return False
    if long.startswith(short):
        return len(short) >= 3
    rest = iter(long[1:])
    return len(long) >= 5 and all(c not in "aeiou" and c in rest for c in short[1:])


def groups_of(vocabulary: list[str], groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> tuple[tuple[str, ...], ...]:
    """groups, and one for each word of a project's vocabulary that others abbreviate: for expand()."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(vocabulary)):
        if w:
            by_letter.setdefault(w[0], []).append(w)
    found = [(long, *shorts) for own in by_letter.values() for long in own if (shorts := [x for x in own if abbreviates(x, long)])]
    return (*groups, *found)


def primary_stem(word: str) -> str | None:
    return next(iter(stem_variants(word)), None)


@dataclass(frozen=True)
class Token:
    exact: str
    stems: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """A question's tokens with their variants."""

    text: str
    tokens: tuple[Token, ...] = field(default_factory=tuple)

    @property
    def words(self) -> list[str]:
        return [t.exact for t in self.tokens]


def expand(text: str, groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> Query:
    """Tokens: identifier words of two letters or more that are no number, each once; else the first word as it is."""
    raw = text.lower().split()
    parts = dict.fromkeys(p for w in raw for p in split_identifier(w) if len(p) > 1 and not re.fullmatch("[0-9]+", p))
    words = list(parts)[:MAX_TOKENS] or raw[:1]
    tokens = []
    for w in words:
        stems = stem_variants(w)
        root = short_root(w)
        stems += [root] if root and root not in stems else []
        tokens.append(Token(w, tuple(stems), tuple(synonyms_for(w, stems, groups))))
    return Query(text, tuple(tokens))


#: What else is said where a concept is meant; a starting vocabulary, pass your own for a project's.
CONCEPTS = {
    "auth": ("login", "token", "session", "password"), "login": ("auth", "session", "credential"), "permission": ("role", "access", "policy"), "database": ("query", "connection", "schema", "pool"),
    "cache": ("store", "invalidate", "expire"), "request": ("handler", "route", "endpoint"), "route": ("handler", "endpoint", "controller"), "middleware": ("handler", "filter", "chain"),
    "error": ("exception", "panic", "fail"), "retry": ("backoff", "attempt", "fallback"), "async": ("await", "future", "task"), "thread": ("lock", "mutex", "pool"),
    "parse": ("token", "lexer", "syntax"), "test": ("assert", "mock", "fixture"), "config": ("settings", "env", "options"), "log": ("trace", "metrics", "span"),
    "file": ("path", "read", "write"), "render": ("view", "template", "layout"), "search": ("index", "query", "rank"), "event": ("listener", "emit", "handler"),
}


def with_concepts(words: list[str], concepts: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """words, then the concepts' terms for them (by the word or its stem), each once."""
    table = CONCEPTS if concepts is None else concepts
    more = [t for w in words for key in [w, *stem_variants(w)] if key in table for t in table[key]]
    return list(dict.fromkeys([*words, *more]))


def new_terms(words: list[str], concepts: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """What with_concepts() adds to the words."""
    return [w for w in with_concepts(words, concepts) if w not in words]


def camel(words: list[str]) -> str:
    return words[0] + "".join(w[:1].upper() + w[1:] for w in words[1:]) if words else ""


def detect_intent(words: list[str]) -> str:
    by_word = {w: intent for intent, own in INTENTS.items() for w in own}
    return next((by_word[w] for w in words if w in by_word), "lookup")


def wants_tests(words: list[str]) -> bool:
    return bool({"test", "tests", "testing", "spec", "specs"} & set(words))


def wants_config(words: list[str]) -> bool:
    return bool({"config", "configuration", "settings", "toml", "yaml", "env"} & set(words))
