"""Exact silhouettes against a plain version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from predia.operators import silhouette as S
from predia.operators.silhouette import point_silhouettes, silhouette


def brute(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(labels):
        same = labels == c
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.mark.parametrize("block", [2048, 50])
def test_equals_plain_version(spark, block):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (120, 3)), r.normal(4, 1, (90, 3)), np.full((40, 3), 2.0), [[99.0, 0, 0]]])
    one, two = (x[:, 0] > 2).astype(int), np.where(x[:, 0] > 50, 3, r.integers(0, 3, len(x)))
    two[210:250] = 1  # equal points share their labels
    df = spark.createDataFrame([(*map(float, p), int(a), int(b)) for p, a, b in zip(x, one, two)], "a double, b double, c double, uno int, dos int")
    got = silhouette(df, ["a", "b", "c"], ["uno", "dos"], block).collect()
    for name, labels in (("uno", one), ("dos", two)):
        s = brute(x, labels)
        expected = {int(c): (int((labels == c).sum()), pytest.approx(s[labels == c].mean(), abs=1e-9)) for c in set(labels)}
        assert {g.cluster: (g.n, g.silueta) for g in got if g.labelling == name} == expected


def test_single_cluster_and_empty(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 0)], "a double, k int")
    assert [tuple(r) for r in silhouette(df, ["a"], ["k"]).collect()] == [("k", 0, 2, None)]
    assert silhouette(df.filter("a > 5"), ["a"], ["k"]).count() == 0
    assert point_silhouettes(df.withColumn("k", F.col("a").cast("int") - 1), ["a"], ["k"]).select("s").distinct().collect()[0][0] == 0.0


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Once the blocks are packed, what is left is one pass over them per task."""
    df = spark.range(3000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("k"))
    plan = point_silhouettes(df, ["a"], ["k"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_centres_of_the_types_are_derived_once(spark, monkeypatch):
    """The frame of assigned rows reads a stored table of centres, not the listings again."""
    from predia.registry import valuation as R

    listings = spark.range(40).select(
        F.col("id").alias("listing_id"), F.concat(F.lit("T"), F.col("id") % 3).alias("tipo_inmueble"),
        F.col("id").cast("double").alias("area_m2"), (F.col("id") * 1000.0).alias("price_usd"))
    grouped = listings.groupBy("listing_id", "tipo_inmueble").agg(F.max("area_m2").alias("area_m2"), F.max("price_usd").alias("price_usd"))
    monkeypatch.setattr(R.V, "listing", lambda spark, d: grouped)
    monkeypatch.setattr(R, "pool", lambda spark, d: R.cut(grouped))
    got = R.assigned(spark, "")
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.groupBy("cluster_id").count().count() <= 3 and got.count() == 40


@pytest.mark.parametrize("dims", [1, 2])
def test_far_blocks_meet_at_nodes(spark, dims):
    """Enough points for blocks that lie far apart: the values are those of all pairs."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.uniform(0, 100, (4900, dims)), r.normal(30, 0.5, (480, dims)), np.full((19, dims), 7.0), np.full((1, dims), 1e4)])
    labels = np.where(x[:, 0] > 40, 2, r.integers(0, 2, len(x)))
    labels[-20:-1] = 1
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(*map(float, p), int(c)) for p, c in zip(x, labels)], ", ".join(f"{n} double" for n in names) + ", k int")
    s = brute(x, labels)
    got = {g.cluster: (g.n, g.silueta) for g in silhouette(df, names, ["k"]).collect()}
    assert got == {c: ((labels == c).sum(), pytest.approx(s[labels == c].mean(), abs=1e-10)) for c in range(3)}


def test_nodes_stand_for_points_within_a_bound():
    """Single distances between boxes at the least gap, not only sums, in which errors would level out."""
    r, starts = np.random.default_rng(7), np.array([0, 1])

    def block(points):
        low, high = points.min(0), points.max(0)
        return S._Block(points, np.zeros((len(points), 1), np.int32), np.ones(len(points)), (low + high) / 2, (high - low) / 2)

    corners = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]])
    own = block(np.concatenate([corners, r.random((200, 2))]))
    for shift in ([2.001, 0], [0, -2.001], [1.71, 1.71], [2.3, 0.4]):
        other = block(np.concatenate([corners, r.random((200, 2))]) + shift)
        assert own.far_from(other)
        got = own.spread() @ S._by_nodes(own.nodes(), other.nodes(), other.spread().T)
        exact = np.sqrt(((own.points[:, None] - other.points[None]) ** 2).sum(2))
        assert np.abs(got / exact - 1).max() < 1e-10
        assert np.allclose(S._direct(own, other, starts)[:, 0], exact.sum(1), rtol=1e-13)
    assert not own.far_from(block(corners + [1.9, 0]))
    assert S._direct(own, own, starts)[0] == pytest.approx(np.sqrt((own.points**2).sum(1)).sum(), rel=1e-13)


def test_equal_points_with_other_labels_are_at_zero(spark):
    df = spark.createDataFrame([(1e5 + i // 2 * 1e-3, 1e5, 3.0, i % 2) for i in range(40)], "a double, b double, c double, k int")
    x, labels = np.array([[1e5 + i // 2 * 1e-3] for i in range(40)]), np.array([i % 2 for i in range(40)])
    s = brute(x, labels)
    got = {g.cluster: g.silueta for g in silhouette(df, ["a", "b", "c"], ["k"]).collect()}
    assert got == {c: pytest.approx(s[labels == c].mean(), abs=1e-9) for c in (0, 1)}


@pytest.mark.parametrize("groups", [3, 400])
def test_sums_over_runs_of_labels(groups):
    """Points in five dimensions, ordered by their labels or not, against plain distances."""
    r, starts = np.random.default_rng(11), np.array([0, 4, 9])
    x, labels, weights = r.normal(size=(500, 5)) + 1000, np.stack([r.integers(0, 4, 500), r.integers(0, 5, 500)], 1).astype(np.int32), r.integers(1, 4, 500).astype(float)
    if groups == 3:
        labels = labels[np.sort(r.integers(0, 3, 500))]
    block = S._Block(x, labels, weights, x.mean(0), np.ptp(x, axis=0) / 2)
    plain = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) @ block.members(starts)
    assert np.allclose(S._direct(block, block, starts), plain, rtol=1e-12)
