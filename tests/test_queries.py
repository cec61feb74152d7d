"""Every query against its DuckDB SQL on the smallest tables; the corpus subpackage has tests of its own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.queries import prose

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(prose.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    mine = prose.QUERIES[name](spark, sf_dir)
    found = con.execute(prose.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows(mine.columns, mine.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(prose.QUERIES) - set(prose.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert prose.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
