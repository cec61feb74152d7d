"""Names of callables that every program of a language calls and that say nothing about who depends on whom."""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, SparkSession

#: Names that mean collections, strings, logging or construction nearly everywhere.
COMMON = (
    "new", "default", "clone", "copy", "len", "size", "count", "is_empty", "clear", "get", "set", "add", "insert", "remove", "delete", "push", "pop", "append", "extend", "contains",
    "keys", "values", "items", "iter", "next", "map", "filter", "reduce", "find", "any", "all", "sort", "reverse", "min", "max", "sum", "join", "split", "replace", "trim", "format", "parse",
    "print", "println", "toString", "to_string", "equals", "hash", "close", "open", "read", "write", "log", "debug", "info", "warn", "error",
)
#: A few names more of each group of languages that share a library.
OWN = {
    "rust": ("unwrap", "expect", "into", "from", "as_ref", "as_str", "collect", "iter_mut", "ok", "err", "map_err", "and_then", "unwrap_or", "to_owned", "borrow", "lock", "deref", "fmt"),
    "javascript": ("forEach", "indexOf", "includes", "then", "catch", "toLowerCase", "toUpperCase", "stringify", "addEventListener", "querySelector", "setTimeout", "require", "bind", "call", "apply"),
    "go": ("make", "panic", "recover", "cap", "Errorf", "Sprintf", "Printf", "Println", "Error", "String", "Lock", "Unlock", "Done", "Wait"),
    "java": ("hashCode", "valueOf", "isEmpty", "containsKey", "put", "stream", "forEach", "getClass", "let", "also", "listOf", "mapOf", "require"),
    "csharp": ("ToString", "Equals", "GetHashCode", "GetType", "Dispose", "WriteLine", "Add", "Remove", "Contains", "ToList", "Select", "Where", "ConfigureAwait"),
    "c": ("malloc", "free", "memcpy", "memset", "strlen", "strcmp", "printf", "fprintf", "sizeof", "assert", "exit", "begin", "end", "push_back", "emplace_back", "c_str", "make_unique", "make_shared"),
}
#: Languages that share the names of another.
GROUPS = {"typescript": "javascript", "kotlin": "java", "cpp": "c"}


def python_names() -> tuple[str, ...]:
    """What Python's own types and functions are called."""
    own = {n for n in dir(builtins) if n.islower() and not n.startswith("_")}
    for kind in (str, bytes, list, dict, set, int, float):
        own |= {n for n in dir(kind) if not n.startswith("_")}
    return tuple(sorted(own))


def group(language: str) -> str:
    return GROUPS.get(language, language)


def names(language: str | None = None) -> frozenset[str]:
    """The names of a language's group; of all for an unknown one."""
    tables = OWN | {"python": python_names()}
    own = tables.get(group(language)) if language else None
    return frozenset(COMMON) | frozenset(own if own is not None else (n for t in tables.values() for n in t))


def is_ubiquitous(name: str, language: str | None = None) -> bool:
    return name in names(language)


def stop_table(spark: SparkSession) -> DataFrame:
    """(name, language): a row for each name of each group; a null language means all."""
    rows = [(n, None) for n in COMMON] + [(n, g) for g, own in (OWN | {"python": python_names()}).items() for n in own]
    return spark.createDataFrame(sorted(set(rows), key=repr), "name string, language string")
