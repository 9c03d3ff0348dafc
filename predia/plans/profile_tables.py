"""Matching of listings with a table of profiles of any size, block against block.

A profile is a row: zones, bounds and a vector. A task holds a bounded number of profiles, and all listings
pass them in runs of bounded length, read from the checkpoint; rules and cosines of a block of profiles and a
run are computed at once, as matrices. What leaves a task is what is asked for: scores of all pairs, extremes
per profile, or the best k per profile. For the best, a run goes past a profile by falling cosine and only as far
as a listing that met every criterion the run can meet could still be among them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from predia import constants as K
from predia.operators.scale import top_per_group
from predia.operators.vector_search import ROUND
from predia.plans.matching import RULE_COLUMNS
from predia.session import cut

BLOCK_PROFILES = 512
TASK_PROFILES = 2048
BEST_PROFILES = 65_536  # of a task that keeps only the best k of each
SLICE_LISTINGS = 8192
SLICES = 8  # of a run where no pairs are written
STRIP = 64  # profiles whose scores are held at once
FIRST = 16  # listings of a run that are tested first; each further lot is twice as long
ENTRIES = 131_072  # scores of a lot that are held at once
SLACK = 2 * 10.0**-ROUND  # scores are rounded below
PAIR = "perfil string, listing_id bigint, score_estructurado double, coseno double"
EXTREMES = "clave bigint, lo double, hi double"
BEST = "perfil string, listing_id bigint, score_estructurado double, score_semantico double, score_hibrido double"
KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
ARROW = {s: [(c.split()[0], KINDS[c.split()[1]]) for c in s.split(", ")] for s in (PAIR, EXTREMES, BEST)}


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows; a null or all-zero vector has no direction and gives null cosines."""
    m = np.array([[0.0] * width if v is None else v for v in vectors], float).reshape(-1, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def structural_matrix(profiles: pd.DataFrame, listings: pd.DataFrame) -> np.ndarray:
    """Mean of 0/1 over the criteria each profile states, profiles by listings; a null value scores 0."""
    codes, zones = pd.factorize(listings["corregimiento"])
    known = {z: i for i, z in enumerate(zones)}
    wanted = np.zeros((len(profiles), len(zones) + 1))
    for i, own in enumerate(profiles["corregimientos"]):
        wanted[i, [known[z] for z in ([] if own is None else own) if z in known]] = 1.0
    points, criteria = wanted[:, codes], np.ones(len(profiles))
    for c in RULE_COLUMNS:
        value = listings[c].to_numpy(dtype="float64", na_value=np.nan)
        for side, meets in (("min", np.greater_equal), ("max", np.less_equal)):
            bound = profiles[f"{c}_{side}"].to_numpy(dtype="float64", na_value=np.nan)
            stated = ~np.isnan(bound)
            criteria += stated
            with np.errstate(invalid="ignore"):
                points[stated] += meets(value[None, :], bound[stated][:, None])
    return points / criteria[:, None]


def cosine_matrix(profiles: pd.DataFrame, listings: pd.DataFrame) -> np.ndarray:
    known = [v for v in [*profiles["vector"], *listings["embedding"]] if v is not None]
    width = len(known[0]) if known else 1
    return np.round(_unit(profiles["vector"], width) @ _unit(listings["embedding"], width).T, ROUND)


def _vectors(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row among the distinct vectors, the distinct vectors as rows)."""
    known = [np.asarray(v) for v in column if v is not None]
    width = len(known[0]) if known else 1
    kind = np.float32 if known and all(v.dtype == np.float32 for v in known) else np.float64
    places, distinct = pd.factorize(np.array([b"" if v is None else np.asarray(v, kind).tobytes() for v in column], dtype=object))
    return places, np.array([np.frombuffer(x, kind) if x else np.zeros(width, kind) for x in distinct], kind).reshape(len(distinct), width)


def _packed(vector: str, most: int):
    """Rows in runs of bounded length, each run one binary value; equal vectors of a run are kept once."""

    def value(parts: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(parts, ignore_index=True)
        kept = part.drop(columns=[vector])
        if "corregimiento" in kept:
            kept["corregimiento"] = kept["corregimiento"].astype("category")
        return pd.DataFrame({"rows": [pickle.dumps((kept, *_vectors(part[vector])))]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for batch in batches:
            start = 0
            while start < len(batch):
                part = batch.iloc[start:start + most - n]
                waiting, n, start = [*waiting, part], n + len(part), start + len(part)
                if n == most:
                    yield value(waiting)
                    waiting, n = [], 0
        if waiting:
            yield value(waiting)

    return run


class _Block:
    """A run of profiles that meets runs of listings."""

    def __init__(self, profiles: pd.DataFrame, places: np.ndarray, vectors: np.ndarray):
        self.profiles, self.places, self.units = profiles, places, _unit(vectors, vectors.shape[1])

    def distinct_cosines(self, units: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Cosines of the distinct vectors of both sides; a side without any vector has no width to compare."""
        own = self.units[start:stop]
        if own.shape[1] != units.shape[1]:
            return np.full((len(own), len(units)), np.nan)
        return np.round(own @ units.T, ROUND)

    def meet(self, listings: pd.DataFrame, places: np.ndarray, units: np.ndarray) -> pd.DataFrame | None:
        """What the block writes at once."""

    def rows(self) -> pd.DataFrame | None:
        """What it writes when all listings have passed."""


class _Pairs(_Block):
    def meet(self, listings: pd.DataFrame, places: np.ndarray, units: np.ndarray) -> pd.DataFrame:
        p, v = self.profiles, listings
        s, c = structural_matrix(p, v), self.distinct_cosines(units)[self.places][:, places]
        return pd.DataFrame({
            "perfil": np.repeat(p["perfil"].to_numpy(), len(v)), "listing_id": np.tile(v["listing_id"].to_numpy(), len(p)),
            "score_estructurado": s.ravel(), "coseno": pd.array(np.where(np.isnan(c), 0, c).ravel(), "Float64"),
        }).assign(coseno=lambda d: d["coseno"].mask(np.isnan(c).ravel()))


class _Extremes(_Block):
    def __init__(self, profiles: pd.DataFrame, places: np.ndarray, vectors: np.ndarray):
        super().__init__(profiles, places, vectors)
        self.lo, self.hi = np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)

    def meet(self, listings: pd.DataFrame, places: np.ndarray, units: np.ndarray) -> None:
        for start in range(0, len(self.units), STRIP):
            c, at = self.distinct_cosines(units, start, start + STRIP), slice(start, start + STRIP)
            self.lo[at] = np.minimum(self.lo[at], np.where(np.isnan(c), np.inf, c).min(1))
            self.hi[at] = np.maximum(self.hi[at], np.where(np.isnan(c), -np.inf, c).max(1))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"clave": self.profiles["clave"], "lo": self.lo[self.places], "hi": self.hi[self.places]})


class _Zones:
    """Zone lists of profiles as numbers, one list after another."""

    def __init__(self, lists: pd.Series):
        lists = [[] if own is None else [z for z in own if z is not None] for own in lists]
        self.known: dict[str, int] = {}
        self.flat = np.array([self.known.setdefault(z, len(self.known)) for own in lists for z in own], np.int64)
        self.ends = np.cumsum([0, *map(len, lists)])
        self.none = len(self.known)

    def numbers(self, zones: pd.Series) -> np.ndarray:
        """The number of each zone; those no profile names share one."""
        codes, names = pd.factorize(zones)
        return np.array([*(self.known.get(z, self.none) for z in names), self.none])[codes]

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the given profiles, zone) of all their zones."""
        counts = self.ends[own + 1] - self.ends[own]
        first = np.repeat(self.ends[own] - (np.cumsum(counts) - counts), counts)
        return np.repeat(np.arange(len(own)), counts), self.flat[first + np.arange(len(first))]

    def met(self, own: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """1 where the zone is on the list of the profile, profiles by zones."""
        present, at = np.unique(numbers, return_inverse=True)
        column = np.full(self.none + 1, len(present))
        column[present] = np.arange(len(present))
        column[self.none] = len(present)
        wanted, (row, zone) = np.zeros((len(own), len(present) + 1), np.uint8), self.of(own)
        wanted[row, column[zone]] = 1
        wanted[:, len(present)] = 0
        return wanted[:, np.where(numbers == self.none, len(present), at)]


class _Best(_Block):
    """The best k of each profile. Scores are those of all pairs; a pair is left out only where a bound excludes it."""

    def __init__(self, profiles: pd.DataFrame, places: np.ndarray, vectors: np.ndarray, k: int, weights: tuple[float, float]):
        super().__init__(profiles, places, vectors)
        self.k, self.weights, n = k, weights, len(profiles)
        self.zones = _Zones(profiles["corregimientos"])
        self.low = profiles["lo"].to_numpy(float, na_value=np.nan)
        self.span = profiles["hi"].to_numpy(float, na_value=np.nan) - self.low
        self.bounds, self.criteria = [], np.ones(n)
        for c in RULE_COLUMNS:
            for side, meets in (("min", np.greater_equal), ("max", np.less_equal)):
                bound = profiles[f"{c}_{side}"].to_numpy(float, na_value=np.nan)
                if not np.isnan(bound).all():
                    self.bounds.append((c, meets, bound))  # nothing meets a bound that is not stated
                    self.criteria += ~np.isnan(bound)
        order = np.argsort(places, kind="stable")
        self.sharing = np.split(order, np.cumsum(np.bincount(places, minlength=len(vectors)))[:-1])
        # Scores (hybrid, structural, semantic) and ids of the best so far, and the score to reach.
        self.best, self.ids, self.worst = np.zeros((3, n, 0)), np.zeros((n, 0), np.int64), np.full(n, -np.inf)

    def meet(self, listings: pd.DataFrame, places: np.ndarray, units: np.ndarray) -> None:
        numbers, ids = self.zones.numbers(listings["corregimiento"]), listings["listing_id"].to_numpy()
        values = {c: listings[c].to_numpy(float, na_value=np.nan) for c in RULE_COLUMNS}
        reach = self._reach(numbers, values)
        for start in range(0, len(self.units), STRIP):
            for i, cosines in enumerate(self.distinct_cosines(units, start, start + STRIP), start):
                own, c = self.sharing[i], cosines[places]
                need = self._needed(own, reach)
                near = np.flatnonzero(c >= need.min())
                near = near[np.argsort(-c[near])]
                at, lot = 0, FIRST
                while at < len(near):
                    own = own[need <= c[near[at]]]
                    if not len(own):
                        break
                    part, rows = near[at:at + lot], max(1, ENTRIES // lot)
                    for s in range(0, len(own), rows):
                        self._test(own[s:s + rows], numbers[part], {x: v[part] for x, v in values.items()}, c[part], ids[part])
                    at, lot, need = at + lot, min(2 * lot, SLICE_LISTINGS), self._needed(own, reach)

    def _reach(self, numbers: np.ndarray, values: dict[str, np.ndarray]) -> np.ndarray:
        """The greatest structural part of a score that each profile can have in the run."""
        present = np.zeros(self.zones.none + 1, bool)
        present[numbers] = True
        present[self.zones.none] = False
        row, zone = self.zones.of(np.arange(len(self.worst)))
        points = (np.bincount(row, present[zone], len(self.worst)) > 0).astype(float)
        for c, meets, bound in self.bounds:
            known = values[c][~np.isnan(values[c])]
            points += meets(known.max() if meets is np.greater_equal else known.min(), bound) if len(known) else 0
        return np.maximum(self.weights[0] * points / self.criteria, 0.0)

    def _needed(self, own: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The least cosine with which a listing could be among the best of each profile."""
        missing, span = self.worst[own] - SLACK - reach[own], self.span[own]
        if self.weights[1] <= 0:
            return np.where(missing <= 0, -np.inf, np.inf)
        with np.errstate(invalid="ignore"):
            least = self.low[own] + span * (missing / self.weights[1])
        return np.where(span > 0, least, np.where(missing <= 0, -np.inf, np.inf))

    def _test(self, own: np.ndarray, numbers: np.ndarray, values: dict[str, np.ndarray], cosines: np.ndarray, ids: np.ndarray) -> None:
        points, low, span = self.zones.met(own, numbers), self.low[own], self.span[own]
        for c, meets, bound in self.bounds:
            points += meets(values[c], bound[own, None])
        # Scores up to a constant of the profile; those within reach are then computed as they are.
        slope = np.divide(self.weights[1], span, out=np.zeros(len(own)), where=span > 0)
        rough = points * (self.weights[0] / self.criteria[own])[:, None]
        rough += slope[:, None] * cosines
        i, j = np.nonzero(rough >= (self.worst[own] - SLACK + slope * np.where(span > 0, low, 0.0))[:, None])
        if not len(i):
            return
        structural = points[i, j] / self.criteria[own[i]]
        semantic = np.divide(cosines[j] - low[i], span[i], out=np.zeros(len(i)), where=span[i] > 0)
        hybrid = np.round(self.weights[0] * structural + self.weights[1] * semantic, ROUND)
        self._keep(own, i, np.stack([hybrid, structural, semantic]), ids[j])

    def _keep(self, own: np.ndarray, i: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        changed, i = np.unique(i, return_inverse=True)
        who, width = own[changed], self.best.shape[2]
        at = np.concatenate([np.repeat(np.arange(len(who)), width), i])
        scores = np.concatenate([self.best[:, who].reshape(3, -1), found], 1)
        ids = np.concatenate([self.ids[who].ravel(), ids])
        order = np.lexsort((ids, -scores[0], at))
        counts = np.bincount(at)
        place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, place = order[place < self.k], place[place < self.k]
        if (more := place.max() + 1 - width) > 0:  # empty places come last
            self.best = np.concatenate([self.best, np.full((3, len(self.worst), more), -np.inf)], 2)
            self.ids = np.concatenate([self.ids, np.zeros((len(self.worst), more), np.int64)], 1)
        self.best[:, who[at[order]], place], self.ids[who[at[order]], place] = scores[:, order], ids[order]
        if self.best.shape[2] == self.k:
            self.worst[who] = self.best[0, who, -1]

    def rows(self) -> pd.DataFrame:
        i, place = np.nonzero(self.best[0] > -np.inf)
        score, structural, semantic = self.best[:, i, place]
        return pd.DataFrame({
            "perfil": self.profiles["perfil"].to_numpy()[i], "listing_id": self.ids[i, place],
            "score_estructurado": structural, "score_semantico": semantic, "score_hibrido": score})


def _runs(listings: DataFrame, most: int) -> DataFrame:
    """Listings in numbered runs, kept, as all tasks read them."""
    v = listings.select(F.col("listing_id").cast("bigint"), "corregimiento", *[F.col(c).cast("double") for c in RULE_COLUMNS], "embedding")
    return cut(v.mapInPandas(_packed("embedding", most), "rows binary").select(F.monotonically_increasing_id().alias("run"), "rows"))


def _met(runs: DataFrame, profiles: DataFrame, block: Callable[..., _Block], schema: str, whole: bool = False) -> DataFrame:
    """What blocks of profiles write when all listings have passed them.

    Runs of listings are read from the checkpoint by every task, not shuffled; a task holds a bounded
    number of profiles, with `whole` as one block. With few profiles the listings are dealt over several
    tasks, so a profile may write more than once.
    """
    spark = profiles.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profiles = cut(profiles)
    n = profiles.count()
    shares = max(1, -(-n // TASK_PROFILES))
    if whole:  # every share reads all runs, and what a profile keeps grows with the parts that it meets
        tasks = spark.sparkContext.defaultParallelism
        shares = max(1, -(-n // BEST_PROFILES), min(tasks, shares))
        shares = shares if shares < tasks else -(-shares // tasks) * tasks
    own = profiles.repartition(shares, F.xxhash64(*profiles.columns)).mapInPandas(_packed("vector", BEST_PROFILES if whole else BLOCK_PROFILES), "rows binary")
    own = cut(own.select(F.monotonically_increasing_id().alias("block"), F.col("rows").alias("own")))
    pairs = runs.coalesce(-(-tasks // shares)).hint("shuffle_replicate_nl").crossJoin(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        passing, at = None, None
        into = pa.schema(ARROW[schema])
        for batch in batches:
            for number, rows, key, packed in zip(*(batch.column(c) for c in ("run", "rows", "block", "own"))):
                if number.as_py() != at:
                    at, (listed, places, vectors) = number.as_py(), pickle.loads(rows.as_py())
                    passing = listed, places, _unit(vectors, vectors.shape[1])
                if (key := key.as_py()) not in held:
                    held[key] = block(*pickle.loads(packed.as_py()))
                written = held[key].meet(*passing)
                if written is not None:
                    yield pa.RecordBatch.from_pandas(written, into, preserve_index=False)
        for one in held.values():
            written = one.rows()
            if written is not None:
                yield pa.RecordBatch.from_pandas(written, into, preserve_index=False)

    return pairs.mapInArrow(run, schema)


def _ready(profiles: DataFrame) -> DataFrame:
    rules = [f"{c}_{s}" for c in RULE_COLUMNS for s in ("min", "max")]
    extra = [c for c in ("lo", "hi") if c in profiles.columns]
    return profiles.select("perfil", "corregimientos", *[F.col(c).cast("double") for c in rules], F.col("vector").cast("array<double>").alias("vector"), *extra)


def pair_scores(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(perfil, listing_id, score_estructurado, coseno) of every listing with every profile."""
    return _met(_runs(listings, SLICE_LISTINGS), _ready(profiles), _Pairs, PAIR)


def cosine_extremes(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(perfil, lo, hi): least and greatest cosine of each profile; no pair leaves a task. Profiles with
    equal vectors have the same ones, so distinct vectors meet the listings."""
    return _extremes(_runs(listings, SLICES * SLICE_LISTINGS), profiles)


def _extremes(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    named = cut(profiles.select("perfil", F.col("vector").cast("array<double>").alias("vector")))
    distinct = cut(named.select("vector").distinct().withColumn("clave", F.monotonically_increasing_id()))
    found = _met(runs, distinct, _Extremes, EXTREMES).groupBy("clave").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    keyed = found.join(distinct, "clave").select(F.col("vector").alias("v"), "lo", "hi")
    return named.join(keyed, F.col("vector").eqNullSafe(F.col("v"))).groupBy("perfil").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def best_listings(
    listings: DataFrame, profiles: DataFrame, k: int,
    weights: tuple[float, float] = (K.WEIGHT_STRUCTURAL, K.WEIGHT_SEMANTIC),
) -> DataFrame:
    """(perfil, rank, listing_id, score_estructurado, score_semantico, score_hibrido): the best k of every profile.

    The cosine is min-max scored over all listings of the profile, 0 where they are all equal; a pair
    without a cosine has no hybrid score and is left out. Ties go to the lower id.
    """
    profiles, runs = cut(profiles), _runs(listings, SLICES * SLICE_LISTINGS)  # each is read twice
    ready = profiles.join(cut(_extremes(runs, profiles)), "perfil")
    found = _met(runs, _ready(ready), partial(_Best, k=k, weights=weights), BEST, whole=True)
    return top_per_group(found, ["perfil"], [F.desc("score_hibrido"), F.col("listing_id")], k)
