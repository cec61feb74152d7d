"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words, counted from its start; their hashes are the index.
Every rolling window of BLOCK words of every document probes it. As a window of WINDOW >= 2 * BLOCK - 1 words holds a
whole block, a sequence of WINDOW words that occurs twice has a block of either occurrence under a rolling window of
the other, so the probes that hit another place's block (or whose own block another place's probe hits) mark all
candidates. Hits are extended left and right to every WINDOW-word window around them; windows that occur twice (by a
62-bit hash of all their words) are exact repeats, and their union is the maximal repeats' words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rolling
from .repeats import NARROW, WIDE, Plan, among, chunked, keys, packed, per_chunk, repeated, sent, spread, with_hits, words_of, known

WINDOW = 35


def windows(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a text has n words from there on, and the hash of these."""
    h = rolling(w.hashes, n)
    at = np.flatnonzero(w.left[: len(h)] >= n)
    return at, h[at]


def repeated_words_removed(df: DataFrame, row_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row_id, n_words, n_removed, kept): a row for each row of df, without the words of repeated windows.

    A word goes if a window of `window` consecutive words of its document covers it whose words also start anywhere
    else, in the same document too. All windows are judged on the input. kept: the other words joined by one space.
    Null and empty texts have no words and an empty kept. Equal rows are occurrences of their own, so all their windows
    are repeats. Null ids stay. Other columns are not read. An empty table gives an empty result.
    """
    block = (window + 1) // 2
    plan = Plan(df, text)
    docs = chunked(df, plan, row_id, text)

    def anchors(table: pa.Table) -> pa.Table:
        w = words_of(table)
        at, h = windows(w, block)
        own_start = w.starts[w.doc[at]]
        return sent(table["chunk"][0].as_py(), packed(h, (at - own_start) % block == 0, plan, NARROW))

    hits = repeated(per_chunk(docs, anchors, "bucket int, chunk int, values binary"), plan, NARROW, marked=True)

    def candidates(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return sent(0, [])
        w = words_of(table)
        at, h = windows(w, block)
        at = at[among(keys(h, plan, NARROW), known(found, plan, NARROW))]
        near = spread(at, window - block, 1, len(w.hashes))
        starts, h = windows(w, window)
        return sent(table["chunk"][0].as_py(), packed(h[near[starts]], None, plan, WIDE))

    twice = repeated(with_hits(docs, hits, candidates, "bucket int, chunk int, values binary"), plan, WIDE, marked=False)
    kind = df.schema[row_id].dataType.simpleString()

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        w = words_of(table)
        gone = np.zeros(len(w.hashes), bool)
        if found.num_rows:
            at, h = windows(w, window)
            gone = spread(at[among(keys(h, plan, WIDE), known(found, plan, WIDE))], 0, window, len(w.hashes))
        kept, removed = [], []
        vocabulary, places = w.vocabulary, w.places
        for a, b in zip(w.starts[:-1], w.starts[1:], strict=True):
            here = places[a:b][~gone[a:b]]
            removed.append(int(b - a - len(here)))
            kept.append(b" ".join(map(vocabulary.__getitem__, here.tolist())))
        return pa.table({"id": table["id"], "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return with_hits(docs, twice, remove, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", row_id)
