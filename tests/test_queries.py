"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from predia import registry

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ORACLES = {name: sql for name, (_, sql) in registry.load().items() if sql is not None}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, name):
    got = E.queries()[name](spark, DATA).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)

    def bag(df):
        return Counter(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))

    assert bag(got) == bag(expected)


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["listing_id", "corregimiento", "tipo_inmueble", "price_usd", "score_zona", "total"]
    assert df.count() == 20


def test_every_query_has_sql():
    assert set(registry.load()) == set(ORACLES)
