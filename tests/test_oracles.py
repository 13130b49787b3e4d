"""Every registered query that has SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from mediastrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(x):
    return int(x) if isinstance(x, Decimal) and x == int(x) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([_plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    got = sorted(repr([_plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == want
