"""Choosing a packet: greedy marginal relevance, which is sequential by nature, on at most 200 candidates a question."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import Weights

CANDIDATES = 200


def candidates(rows: DataFrame) -> DataFrame:
    """The CANDIDATES best of each question, one for each (path, name)."""
    best = Window.partitionBy("query_id", "path", "name").orderBy(F.desc("score"), "ordinal")
    rows = rows.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal"))).filter(F.col("place") <= CANDIDATES)


def pick(pool: pd.DataFrame, k: int, file_decay: float, dir_decay: float) -> pd.DataFrame:
    """Rows in the order picked: each time the highest score after decay by what the packet has of its file and directory."""
    pool = pool.sort_values("place", kind="stable").reset_index(drop=True)
    left, picked = list(range(len(pool))), []
    files: dict[str, int] = {}
    dirs: dict[str, int] = {}
    while left and len(picked) < k:
        worth = []
        for i in left:
            same_file = files.get(pool.path[i], 0)
            worth.append(pool.score[i] * file_decay**same_file * dir_decay ** max(0, dirs.get(pool.dir[i], 0) - same_file))
        i = left.pop(max(range(len(left)), key=lambda j: (worth[j], -j)))
        files[pool.path[i]] = files.get(pool.path[i], 0) + 1
        dirs[pool.dir[i]] = dirs.get(pool.dir[i], 0) + 1
        picked.append(i)
    return pool.iloc[picked].assign(rank=range(1, len(picked) + 1))


def diverse(rows: DataFrame, k: int, w: Weights | None = None) -> DataFrame:
    """(query_id, rank, path, name, score) for rows (query_id, path, name, score, ordinal)."""
    w = w or Weights()
    pool = candidates(rows).select("query_id", "path", "name", "score", "place", C.dir_of(F.col("path")).alias("dir"))
    kind = pool.schema["query_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pick(pdf, k, w.same_file_decay, w.same_dir_decay)[["query_id", "rank", "path", "name", "score"]]

    return pool.groupBy("query_id").applyInPandas(run, f"query_id {kind}, rank int, path string, name string, score double")
