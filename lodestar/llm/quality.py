"""Quality rules by repetition coverage.

For every text: the share of its word characters that lie inside duplicated n-grams, for several n, and inside
duplicated lines. n-grams are found by rolling 64-bit hashes of words in numpy, a slice of texts at a time, in one
pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, free_name, mix, rolling, slices

#: The most that duplicated n-grams may cover of a text's word characters, by n.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The most that duplicated lines may cover of a text's word characters.
LINE_LIMIT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_N = 3
SYMBOLS = b"#*$%&|<>"

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "dup_line_chars": "long", "ngram_cover": "array<double>", "line_cover": "double"}


def covered(words: Words, n: int, chars: np.ndarray | None, every: bool) -> np.ndarray:
    """Of each text, the words (or their characters) inside n-word windows that the text has twice or more.

    every: count the first window of equal ones too, else only the later ones.
    """
    out = np.zeros(len(words.counts), np.int64)
    h = rolling(words.hashes, n)
    at = np.flatnonzero(words.left[: len(h)] >= n)
    if not len(at):
        return out
    keys = mix(h[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.concatenate(([False], same))
    hit = later | np.concatenate((same, [False])) if every else later
    marks = np.zeros(len(words.hashes) + n + 1, np.int64)
    starts = at[order[hit]]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    inside = np.cumsum(marks)[: len(words.hashes)] > 0
    weights = np.ones(len(inside), np.int64) if chars is None else chars
    np.add.at(out, words.doc[inside], weights[inside])
    return out


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line of the text, and the bytes of their words that start a code point."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            if own := line.split():
                n += 1
                chars += sum(len(w.decode("utf-8", "replace")) for w in own)
        else:
            seen.add(line)
    return n, chars


def measured(texts: list[bytes], lengths: list[int]) -> dict[str, list]:
    words = Words(texts)
    chars = words.chars()
    total = np.zeros(len(texts), np.int64)
    np.add.at(total, words.doc, chars)
    lines = [duplicate_lines(t) for t in texts]
    whole = np.maximum(total, 1)
    cover = np.stack([covered(words, n, chars, every=False) / whole for n in lengths], axis=1) if lengths else np.zeros((len(texts), 0))
    return {
        "n_words": words.counts.tolist(),
        "word_chars": total.tolist(),
        "n_symbols": [sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) for t in texts],
        "n_dup_lines": [n for n, _ in lines],
        "n_repeat_words": covered(words, BASE_N, None, every=True).tolist(),
        "dup_line_chars": [c for _, c in lines],
        "ngram_cover": cover.tolist(),
        "line_cover": (np.array([c for _, c in lines]) / whole).tolist(),
    }


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None, lengths: list[int] | None = None, out: str = "quality") -> DataFrame:
    """The columns keep (default: all) of df and a struct `out` of MEASURES, a row for each row.

    Null and empty texts measure 0 throughout. Texts are never cut. Other columns pass unchanged, whatever their names;
    where df has a column `out`, the struct's name gets an underscore in front.
    """
    lengths = sorted(NGRAM_LIMITS) if lengths is None else lengths
    keep = df.columns if keep is None else keep
    name, hidden = free_name(df, out), free_name(df, "text_to_measure")
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    fields = ", ".join(f"{k}: {v}" for k, v in MEASURES.items())
    schema = given.drop(hidden).withColumn(name, F.lit(None).cast(f"struct<{fields}>")).schema
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, hidden):
                found = measured(binary(part[hidden]).to_pylist(), lengths)
                struct = pa.StructArray.from_arrays([pa.array(found[k], kinds[v]) for k, v in MEASURES.items()], names=list(MEASURES))
                yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [struct], names=[*keep, name])

    return given.mapInArrow(run, schema)


def verdicts(q: str, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> tuple[F.Column, F.Column]:
    """base_failed and kept of a struct column q that measure() made with the lengths of limits."""
    limits = NGRAM_LIMITS if limits is None else limits
    failed = (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))
    good = F.col(f"{q}.line_cover") <= line_limit
    for i, n in enumerate(sorted(limits)):
        good &= F.col(f"{q}.ngram_cover")[i] <= limits[n]
    return failed, ~failed & good


def rejected_removed(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose text passes the base rules and the coverage limits, with df's columns."""
    judged = measure(df, text)
    q = judged.columns[-1]
    return judged.filter(verdicts(q)[1]).drop(q)
