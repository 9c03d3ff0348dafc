"""The inverted file against exact search and plain numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predia.operators import vector_index as I
from predia.operators.vector_search import vector_topk


def clustered(n, seed, dims=12, centres=9, noise=0.15):
    r = np.random.default_rng(seed)
    around = r.normal(size=(centres, dims))
    return [(around[r.integers(centres)] + noise * r.normal(size=dims)).tolist() for _ in range(n)]


def frames(spark, n=900, queries=40):
    vectors = clustered(n, 1)
    vectors[5] = vectors[4]  # a tie
    rows = [(i, v, float(i % 7)) for i, v in enumerate(vectors)] + [(n, [0.0] * 12, 1.0), (n + 1, None, 1.0)]
    df = spark.createDataFrame(rows, "listing_id long, embedding array<float>, precio double")
    probes = df.filter(F.col("listing_id") % (n // queries) == 0).select(F.col("listing_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(3.0).alias("tope"))
    return df, probes


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("slices", [50_000, 40])
def test_exact_mode_equals_exact_search(spark, monkeypatch, slices):
    monkeypatch.setattr(I, "SLICE_ROWS", slices)
    df, probes = frames(spark)
    index = I.build_index(df, lists=25)
    assert index.sizes.sum() == 900
    assert rows(I.search(index, probes, 7)) == rows(vector_topk(probes, df, 7))


def test_exact_mode_with_bounds_of_each_query(spark):
    df, probes = frames(spark)
    index = I.build_index(df, lists=25, keep=["precio"])
    bounds = [("tope", "le", "precio")]
    assert rows(I.search(index, probes, 7, criteria=bounds)) == rows(vector_topk(probes, df, 7, criteria=bounds))
    few = probes.withColumn("tope", F.lit(-1.0))
    assert I.search(index, few, 7, criteria=bounds).count() == 0


def test_lists_and_rows_out_of_reach_are_not_met(spark):
    df, probes = frames(spark)
    index = I.build_index(df, lists=25)
    one = probes.limit(1)
    near = I.search(index, one, 3).agg(F.max("distancia")).first()[0]
    reached = one.select("query_id", F.col("vector").cast("array<double>").alias("qv"), F.lit(float(np.sqrt(2 * near))).alias("reach"))
    met = reached.mapInPandas(I._pairs(index, None), "query_id long, qv array<double>, reach double, list int, d double")
    assert met.count() < (index.sizes > 0).sum() / 2


def test_fast_mode_reaches_the_recall_it_was_set_to(spark):
    df, probes = frames(spark)
    index = I.build_index(df, lists=25)
    lists = I.lists_for(index, 7, 0.95, queries=60)
    assert lists < 25
    got = I.recall(I.search(index, probes, 7, lists), I.search(index, probes, 7), "query_id", "listing_id").first()
    assert got["n"] == 7 * probes.count() and got["recall"] >= 0.9


def test_empty_and_short_tables(spark):
    df, probes = frames(spark, 60, 5)
    empty = I.build_index(df.limit(0))
    assert I.search(empty, probes, 3).count() == 0
    small = I.build_index(df.limit(2), lists=9)
    assert I.search(small, probes, 5).groupBy("query_id").count().filter("count <> 2").count() == 0
    assert I.search(small, probes.limit(0), 5).count() == 0
