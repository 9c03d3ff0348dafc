"""Vectors in runs past blocks of queries, against plain numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predia.operators import vector_search as VS

CRITERIA = [("pide", "eq", "zona"), ("desde", "ge", "precio"), ("hasta", "le", "precio"), ("cuartos", "ge", "dorm")]


def tables(rows=700, distinct=60, queries=90, dims=6, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(distinct, dims)).astype("float32")
    which = np.where(r.random(rows) < 0.3, 0, r.integers(0, distinct, rows))  # one vector is held by a third
    v = pd.DataFrame({
        "id": r.permutation(rows), "v": [base[i] for i in which], "zona": r.choice(["A", "B", None], rows),
        "precio": np.where(r.random(rows) < 0.1, np.nan, r.integers(0, 100, rows)), "dorm": r.integers(0, 5, rows).astype(float)})
    bound = lambda x: np.where(r.random(queries) < 0.5, np.nan, x)
    q = pd.DataFrame({
        "query_id": np.arange(queries), "qv": [(base[i % distinct] + (i % 3) * r.normal(size=dims)).astype(float) for i in range(queries)],
        "pide": r.choice(["A", "B", "nowhere", None], queries), "desde": bound(r.integers(0, 100, queries)), "hasta": bound(r.integers(0, 100, queries)),
        "cuartos": bound(r.integers(0, 6, queries))})
    return q, v


def plain(q, v, k):
    m = np.vstack(v["v"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = []
    for x in q.itertuples():
        u = np.asarray(x.qv)
        d = np.round(1 - m @ (u / np.linalg.norm(u)), 9) + 0.0
        ok = np.ones(len(v), bool)
        if x.pide is not None:
            ok &= (v.zona == x.pide).to_numpy(bool)
        for b, test in ((x.desde, v.precio >= x.desde), (x.hasta, v.precio <= x.hasta), (x.cuartos, v.dorm >= x.cuartos)):
            if b == b:
                ok &= test.to_numpy()
        near = np.flatnonzero(ok)
        for i in near[np.lexsort((v.id.to_numpy()[near], d[near]))][:k]:
            found.append((x.query_id, int(v.id[i]), round(float(d[i]), 8)))
    return sorted(found)


@pytest.mark.parametrize("shared,product", [(1, 1_000_000), (10**9, 40), (4, 700)])
def test_runs_past_queries_equal_plain_search(monkeypatch, shared, product):
    monkeypatch.setattr(VS, "SHARED", shared)
    monkeypatch.setattr(VS, "PRODUCT_CELLS", product)
    monkeypatch.setattr(VS, "HITS", 50)
    q, v = tables()
    got = VS._search(q, VS._unit_of(q, "qv"), (v.iloc[i:i + 130].reset_index(drop=True) for i in range(0, len(v), 130)), 4, CRITERIA)
    assert sorted((a, b, round(c, 8)) for a, b, c in got.itertuples(index=False, name=None)) == plain(q, v, 4)


def test_equal_vectors_of_a_run_are_compared_once():
    _, v = tables(rows=1000, distinct=7)
    run = VS._run_of(v, CRITERIA)
    assert len(run.unit) == 7 and len(run.ids) == 1000 and (np.diff(run.at) >= 0).all()


def test_many_queries_are_not_copied_per_slice(spark, monkeypatch):
    """Blocks of queries and runs of vectors meet from the checkpoint; what is shuffled does not grow with their product."""
    monkeypatch.setattr(VS, "MAX_QUERY_CELLS", 300)
    monkeypatch.setattr(VS, "RUN_ROWS", 100)
    q, v = tables()
    queries = spark.createDataFrame(q.replace({np.nan: None}), "query_id long, qv array<double>, pide string, desde double, hasta double, cuartos double")
    vectors = spark.createDataFrame(v.replace({np.nan: None}), "id long, v array<float>, zona string, precio double, dorm double")
    got = VS.vector_topk(queries, vectors, 4, query_vector="qv", vector_id="id", vector="v", criteria=CRITERIA)
    assert sorted((r.query_id, r.id, round(r.distancia, 8)) for r in got.collect()) == plain(q, v, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_null_ids_and_copies_of_rows_are_kept(spark, monkeypatch):
    monkeypatch.setattr(VS, "SCAN_CELLS", 1)
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])], "listing_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    got = VS.vector_topk(queries, vectors, 3).orderBy("rank").collect()
    assert [(r["listing_id"], r["distancia"]) for r in got] == [(None, 0.0), (5, 0.0), (5, 0.0)]


def test_memory_of_a_group_does_not_follow_its_pairs():
    import tracemalloc

    r = np.random.default_rng(8)
    q = pd.DataFrame({"query_id": np.arange(3000), "qv": list(r.normal(size=(3000, 16)))})
    v = pd.DataFrame({"id": np.arange(4000), "v": list(r.normal(size=(4000, 16)).astype("float32"))})
    unit = VS._unit_of(q, "qv")
    tracemalloc.start()
    got = VS._search(q, unit, iter([v]), 10, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 30_000 and peak < 60e6
