"""Profiles from a table against the per-list forms and plain loops."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from predia.operators import overlap as O
from predia.plans import matching as M, profile_tables as T

PROFILES = [
    {"perfil": "a", "corregimientos": ["X", "Y"], "price_usd_min": 100, "bedrooms_min": 2},
    {"perfil": "b", "corregimientos": ["Z"], "price_usd_max": 500, "area_m2_max": 90},
    {"perfil": "c", "corregimientos": ["nowhere"]},
    {"perfil": "d", "corregimientos": ["X"], "price_usd_min": 50, "price_usd_max": 900, "bedrooms_max": 3, "area_m2_min": 20},
]


def listings(spark, n=300):
    draw = random.Random(3)
    some = lambda v: None if draw.random() < 0.1 else v
    rows = [(i, some(draw.choice("XYZ")), some(draw.uniform(0, 1000)), some(draw.randint(0, 5)), some(draw.uniform(10, 200)),
             some([draw.gauss(0, 1) for _ in range(4)])) for i in range(n)]
    rows[7] = (*rows[7][:5], [0.0] * 4)
    return spark.createDataFrame(rows, "listing_id long, corregimiento string, price_usd double, bedrooms int, area_m2 double, embedding array<float>")


def profiles(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 1.0, 0.0]), ("c", None), ("d", [-1.0, 0.5, 0.0, 2.0])], "perfil string, vector array<double>")
    return M.profile_table(spark, PROFILES).join(vectors, "perfil"), vectors


@pytest.fixture(params=[(512, 8192), (2, 37)])
def sized(request, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_PROFILES", request.param[0])
    monkeypatch.setattr(T, "SLICE_LISTINGS", request.param[1])


def bag(df, *columns):
    return Counter(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_pairs_equal_the_scores_of_a_list(spark, sized):
    rows, (table, vectors) = listings(spark), profiles(spark)
    columns = ["perfil", "listing_id", "score_estructurado", "coseno"]
    assert bag(T.pair_scores(rows, table), *columns) == bag(M.profile_scores(rows, vectors, PROFILES), *columns)


def test_best_listings_equal_the_ranking_of_a_list(spark, sized):
    rows, (table, vectors) = listings(spark), profiles(spark)
    whole = M.ranking(M.hybrid(M.profile_scores(rows, vectors, PROFILES)).filter("coseno IS NOT NULL"))
    columns = ["perfil", "listing_id", "score_hibrido", "rank"]
    assert bag(T.best_listings(rows, table, 9), *columns) == bag(whole.filter("rank <= 9"), *columns)


def test_listings_pass_the_profiles_without_a_shuffle(spark):
    """Neither side is copied for the other: once packed, all that is left is a pass per task."""
    plan = T.pair_scores(listings(spark, 50), profiles(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_no_profiles_or_no_listings(spark):
    rows, (table, _) = listings(spark, 20), profiles(spark)
    assert T.best_listings(rows, table.limit(0), 3).count() == 0
    assert T.pair_scores(rows.limit(0), table).count() == 0


def test_overlaps_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_GROUPS", 4)
    draw = random.Random(8)
    rows = [(f"g{draw.randint(0, 14):02}", draw.randint(0, 60)) for _ in range(500)] + [("alone", 999)] + [(f"g{i:02}", 7) for i in range(15)]
    members = spark.createDataFrame(rows + rows[:50], "perfil string, listing_id long")
    sets = {}
    for g, k in rows:
        sets.setdefault(g, set()).add(k)
    expected = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert {(r[0], r[1]): tuple(r)[2:] for r in O.overlap_table(members).collect()} == expected
    got = {(r[0], r[1]): r[2] for r in O.overlap(members, ["g03", "g01", "alone", "absent"]).collect()}
    assert got == {("absent", "alone"): 0, ("absent", "g01"): 0, ("absent", "g03"): 0, ("alone", "g01"): 0, ("alone", "g03"): 0, ("g01", "g03"): len(sets["g01"] & sets["g03"])}


def test_overlaps_of_nothing(spark):
    assert O.overlap_table(spark.createDataFrame([], "perfil string, listing_id long")).count() == 0


@pytest.mark.parametrize("sparse", [0, 10_000])
def test_a_hint_of_neighbours_changes_no_overlap(spark, monkeypatch, sparse):
    """Groups numbered by zone, sets multiplied and counted one by one: the same pairs, a before b by name."""
    monkeypatch.setattr(O, "SPARSE", sparse)
    draw = random.Random(5)
    rows = [(f"g{draw.randint(0, 200):03}", draw.randint(0, 300)) for _ in range(6000)]
    members = spark.createDataFrame([(g, k, f"z{(int(g[1:]) * 7) % 5}") for g, k in rows], "perfil string, listing_id long, zona string")
    sets = {}
    for g, k in rows:
        sets.setdefault(g, set()).add(k)
    expected = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert {(r[0], r[1]): tuple(r)[2:] for r in O.overlap_table(members, near="zona").collect()} == expected


def plain_best(profiles, listings, cosines, k, weights):
    """Every pair scored, none left out."""
    out = []
    for p, c in zip(profiles.itertuples(), cosines):
        s = T.structural_matrix(profiles.loc[[p.Index]], listings)[0]
        m = np.where(p.hi > p.lo, (c - p.lo) / np.where(p.hi > p.lo, p.hi - p.lo, 1), 0.0)
        h = np.round(weights[0] * s + weights[1] * m, 9)
        found = sorted((-x, i) for x, i, y in zip(h, listings["listing_id"], c) if not np.isnan(y))[:k]
        out += [(p.perfil, i, round(-x, 9)) for x, i in found]
    return sorted(out)


@pytest.mark.parametrize("weights", [(0.6, 0.4), (1.0, 0.0), (0.0, 1.0), (0.5, -0.5)])
@pytest.mark.parametrize("k", [3, 500])
def test_best_of_runs_equal_the_best_of_all_pairs(weights, k):
    r = np.random.default_rng(4)
    n, m = 40, 900
    listings = pd.DataFrame({
        "listing_id": r.permutation(m) // 2, "corregimiento": r.choice(["X", "Y", "Z", None], m), "price_usd": r.uniform(0, 1000, m).round(),
        "bedrooms": np.where(r.random(m) < 0.1, np.nan, r.integers(0, 5, m)), "area_m2": r.uniform(10, 200, m)})
    profiles = pd.DataFrame({
        "perfil": [f"p{i:02}" for i in range(n)], "corregimientos": [[["X"], ["Y", "nowhere"], None, ["X", None, "Z"]][i % 4] for i in range(n)],
        "price_usd_min": np.nan, "price_usd_max": r.choice([np.nan, -5, 3, 500], n), "bedrooms_min": r.choice([np.nan, 2], n), "bedrooms_max": r.choice([np.nan, 4], n),
        "area_m2_min": np.nan, "area_m2_max": np.nan})
    places, vectors, known = np.arange(n) % 3, r.normal(size=(3, 4)), r.normal(size=(50, 4))
    known[0], own = 0.0, r.integers(0, 50, m)
    units = T._unit(known, 4)
    cosines = np.round(T._unit(vectors, 4) @ units.T, 9)
    profiles["lo"], profiles["hi"] = np.nanmin(cosines, 1)[places], np.nanmax(cosines, 1)[places]
    profiles.loc[5, "hi"] = profiles.loc[5, "lo"]
    block = T._Best(profiles, places, vectors, k, weights)
    for start in range(0, m, 250):
        part = listings.iloc[start:start + 250].reset_index(drop=True)
        block.meet(part, own[start:start + 250], units)
    got = block.rows()
    assert sorted(zip(got["perfil"], got["listing_id"], got["score_hibrido"].round(9))) == plain_best(profiles, listings, cosines[places][:, own], k, weights)


def test_few_pairs_are_tested_for_the_best(monkeypatch):
    """A run goes past a profile only as far as a listing could still be among its best."""
    r, tested = np.random.default_rng(6), []
    n, m = 200, 20_000
    listings = pd.DataFrame({"listing_id": np.arange(m), "corregimiento": r.choice(list("UVWXYZ"), m), "price_usd": r.uniform(0, 1000, m), "bedrooms": r.integers(0, 5, m), "area_m2": 50.0})
    profiles = pd.DataFrame({"perfil": [f"p{i}" for i in range(n)], "corregimientos": [["UVWXYZ"[i % 6]] for i in range(n)], "price_usd_max": r.uniform(100, 900, n), "lo": -1.0, "hi": 1.0})
    profiles = profiles.assign(**{c: np.nan for c in ("price_usd_min", "bedrooms_min", "bedrooms_max", "area_m2_min", "area_m2_max")})
    plain = T._Best._test
    monkeypatch.setattr(T._Best, "_test", lambda self, own, numbers, *rest: (tested.append(len(own) * len(numbers)), plain(self, own, numbers, *rest)))
    vectors, units = r.normal(size=(5, 8)), T._unit(r.normal(size=(m, 8)), 8)
    block = T._Best(profiles, np.arange(n) % 5, vectors, 10, (0.6, 0.4))
    block.meet(listings, np.arange(m), units)
    got = block.rows()
    assert sum(tested) < n * m / 20
    assert sorted(zip(got["perfil"], got["listing_id"], got["score_hibrido"].round(9))) == plain_best(profiles, listings, block.distinct_cosines(units)[block.places], 10, (0.6, 0.4))


def test_tasks_of_best_listings_hold_bounded_profiles(spark, monkeypatch):
    monkeypatch.setattr(T, "BEST_PROFILES", 1)
    rows, (table, vectors) = listings(spark, 60), profiles(spark)
    whole = M.ranking(M.hybrid(M.profile_scores(rows, vectors, PROFILES)).filter("coseno IS NOT NULL"))
    columns = ["perfil", "listing_id", "score_hibrido", "rank"]
    assert bag(T.best_listings(rows, table, 4), *columns) == bag(whole.filter("rank <= 4"), *columns)
