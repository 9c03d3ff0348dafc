"""Exact Euclidean silhouettes of one or several labellings, block against block.

A silhouette needs the mean distance of every point to every cluster, so the work is quadratic by
definition. Equal points are one weighted row; rows are packed into blocks; a pair of blocks gives sums
of distances per point and cluster, never pairs of points. A task holds a few blocks and their sums while
all blocks pass it, read from the checkpoint and not shuffled; what leaves it is a row per point, so only
the time grows with the square. All labellings share the distances.

In one or two dimensions blocks are compact. The distance is smooth between two that lie far apart, so there
it is taken between Chebyshev nodes of their boxes instead of points, with a relative error below 1e-10: the work
then grows with the power 4/3 of the points. In more dimensions nodes would be more than points.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from predia.session import cut

BLOCK = 2048
LEAST = 256  # points of a block that is not divided further for the sake of more tasks
TASK_BLOCKS = 16
STRIP = 16  # points whose distances to a passing block are held at once
NODES = 16  # of a box in each dimension
FAR = 2.0  # gap between two boxes, in half lengths, beyond which nodes stand for points
SMALL = 1e-6  # squared distances below this part of the squared norms are taken from differences
NEAR = 12  # blocks a point is compared with point by point in two dimensions, about


def _at_nodes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Chebyshev nodes of [-1, 1], weight of each node for each place)."""
    angles, k = (np.arange(NODES) + 0.5) * np.pi / NODES, np.arange(NODES)
    parts = np.cos(np.outer(np.arccos(np.clip(t, -1, 1)), k)) * np.where(k, 2.0, 1.0)
    return np.cos(angles), parts @ np.cos(np.outer(k, angles)) / NODES


@dataclass
class _Block:
    """Points ordered by their labels, the place of their box, and in few dimensions their weights moved to its nodes."""

    points: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    half: np.ndarray
    moved: np.ndarray | None = None

    def nodes(self) -> np.ndarray:
        line = _at_nodes(np.zeros(0))[0]
        grid = np.meshgrid(*[m + h * line for m, h in zip(self.middle, self.half)], indexing="ij")
        return np.stack([g.ravel() for g in grid], 1)

    def spread(self) -> np.ndarray:
        """Weight of each node for each point."""
        found = np.ones((len(self.points), 1))
        for x, m, h in zip(self.points.T, self.middle, self.half):
            own = _at_nodes((x - m) / h if h else np.zeros(len(x)))[1]
            found = (found[:, :, None] * own[:, None, :]).reshape(len(x), -1)
        return found

    def members(self, starts: np.ndarray) -> np.ndarray:
        """Weights of the points, in the column of their cluster in each labelling."""
        found = np.zeros((len(self.points), starts[-1]))
        for i, start in enumerate(starts[:-1]):
            found[np.arange(len(found)), start + self.labels[:, i]] = self.weights
        return found

    def far_from(self, other: _Block) -> bool:
        gaps = np.maximum(np.abs(self.middle - other.middle) - self.half - other.half, 0)
        return np.sqrt((gaps * gaps).sum()) > FAR * max(self.half.max(), other.half.max())


def _packed(dims: int, starts: np.ndarray, most: int, compact: bool):
    """Blocks of consecutive rows, each one binary value."""

    def block(rows: np.ndarray) -> bytes:
        labels = rows[:, dims:-1].astype(np.int32)
        order = np.lexsort(labels.T)
        points = np.ascontiguousarray(rows[order, :dims])
        low, high = points.min(0), points.max(0)
        made = _Block(points, labels[order], rows[order, -1].copy(), (low + high) / 2, (high - low) / 2)
        if compact:
            made.moved = made.spread().T @ made.members(starts)
        return pickle.dumps(tuple(vars(made).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((0, dims + len(starts)))
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            waiting = np.concatenate([waiting, rows])
            while len(waiting) >= most:
                yield pa.RecordBatch.from_pydict({"rows": pa.array([block(waiting[:most])], pa.binary())})
                waiting = waiting[most:]
        if len(waiting):
            yield pa.RecordBatch.from_pydict({"rows": pa.array([block(waiting)], pa.binary())})

    return run


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task as one value."""
    held = [rows for batch in batches for rows in batch.column("rows").to_pylist()]
    if held:
        yield pa.RecordBatch.from_pydict({"points": pa.array([pickle.dumps(held)], pa.binary())})


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of points: a left one times a right one is the table of their squared distances."""
    n, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
    return np.hstack([x, n, one]), np.ascontiguousarray(np.hstack([-2 * x, one, n]).T)


def _direct(own: _Block, other: _Block, starts: np.ndarray) -> np.ndarray:
    """Sums of the distances of each own point to the points of the other block, by cluster."""
    x, y = own.points - own.middle, other.points - own.middle
    left, right = _sides(x)[0], _sides(y)[1]
    small = SMALL * (left[:, -2].max() + right[-1].max())
    firsts = np.flatnonzero(np.r_[True, (other.labels[1:] != other.labels[:-1]).any(1)])
    members = other.members(starts)
    few = len(firsts) < starts[-1]  # runs of equal labels are summed first
    if few:
        ends, to = np.r_[firsts[1:], len(y)], (members[firsts] > 0).astype(float)
    sums, held = np.zeros((len(x), len(firsts) if few else starts[-1])), np.empty((STRIP, len(y)))
    for start in range(0, len(x), STRIP):
        strip = x[start:start + STRIP]
        d = np.matmul(left[start:start + STRIP], right, out=held[:len(strip)])
        if d.min() < small:  # differences, not dot products: equal points are at exactly zero
            i, j = np.nonzero(d < small)
            gaps = strip[i] - y[j]
            d[i, j] = (gaps * gaps).sum(1)
        np.sqrt(d, out=d)
        if few:
            for g, (s, e) in enumerate(zip(firsts, ends)):
                sums[start:start + STRIP, g] = d[:, s:e] @ other.weights[s:e]
        else:
            sums[start:start + STRIP] = d @ members
    return sums @ to if few else sums


def _by_nodes(own: np.ndarray, other: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Sums of the distances of each own node; far apart, products lose nothing to speak of."""
    middle = own.mean(0)
    d = _sides(own - middle)[0] @ _sides(other - middle)[1]
    return np.sqrt(d, out=d) @ moved


def _point_silhouettes(sizes: list[int]):
    """(i, cluster, weight, s) of the points of a task's own blocks, once all blocks have gone past them."""
    starts = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Block]] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        local: dict[tuple[int, int], np.ndarray] = {}
        nodes: dict[tuple[int, int], np.ndarray] = {}
        totals, met = np.zeros(starts[-1]), None
        load = lambda value: [_Block(*pickle.loads(x)) for x in pickle.loads(value.as_py())]
        for batch in batches:
            for key, points, number, others in zip(*(batch.column(c) for c in ("block", "points", "met", "other"))):
                if number.as_py() != met:  # a passing bundle meets all own ones before the next comes
                    met, passing = number.as_py(), load(others)
                    places = [b.nodes() if b.moved is not None else None for b in passing]
                    totals += sum(b.members(starts).sum(0) for b in passing)
                if (key := key.as_py()) not in held:
                    held[key] = load(points)
                    for n, own in enumerate(held[key]):
                        sums[key, n] = np.zeros((len(own.points), starts[-1]))
                        if own.moved is not None:
                            nodes[key, n], local[key, n] = own.nodes(), np.zeros(own.moved.shape)
                for n, own in enumerate(held[key]):
                    for other, place in zip(passing, places):
                        if place is not None and len(place) ** 2 < len(own.points) * len(other.points) and own.far_from(other):
                            local[key, n] += _by_nodes(nodes[key, n], place, other.moved)
                        else:
                            sums[key, n] += _direct(own, other, starts)
        for key, blocks in held.items():
            for n, own in enumerate(blocks):
                if (key, n) in local:
                    sums[key, n] += own.spread() @ local[key, n]
                for i, (start, stop) in enumerate(zip(starts, starts[1:])):
                    yield _values(i, own.labels[:, i], own.weights, sums[key, n][:, start:stop], totals[start:stop])

    return run


def _values(i: int, cluster: np.ndarray, weight: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(cluster))
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.where(n > 0, sums / n, np.inf)
        a = sums[at, cluster] / (n[cluster] - 1)
        means[at, cluster] = np.inf
        b = means.min(1)
        most = np.maximum(a, b)
        # Cancelled differences of equal points are exact; 0 where all distances are 0.
        s = np.where((n[cluster] == 1) | (most == 0), 0.0, (b - a) / most)
    return pa.RecordBatch.from_pydict({
        "i": pa.array(np.full(len(at), i, np.int32)), "cluster": pa.array(cluster.astype(np.int32)),
        "weight": pa.array(weight.astype(np.int64)), "s": pa.array(s, mask=np.isinf(b))})


def point_silhouettes(df: DataFrame, features: list[str], labels: list[str], block_rows: int = BLOCK) -> DataFrame:
    """(labelling, cluster, weight, s): a row per distinct point and labelling, with the number of its
    copies. Labels are integers from 0 in a bounded range; a point alone in its cluster has 0, and where
    there is a single cluster nothing is defined (null)."""
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], *[F.col(c).cast("double").alias(f"l{i}") for i, c in enumerate(labels)])
    rows = rows.dropna().groupBy(*rows.columns).agg(F.count("*").cast("double").alias("w"))
    rows, dims = cut(rows), len(features)
    limits = [f(f"f{i}") for i in range(dims) for f in (F.min, F.max)]
    top = rows.agg(F.count("*"), *[F.max(f"l{i}") for i in range(len(labels))], *limits).first()
    n, sizes = top[0], [int(x or 0) + 1 for x in top[1:1 + len(labels)]]
    if not n:
        return df.sparkSession.createDataFrame([], "labelling string, cluster int, weight bigint, s double")
    tasks = df.sparkSession.sparkContext.defaultParallelism
    compact = dims <= 2
    # Larger blocks mean fewer pairs of nodes and more pairs of points: both cost the same at this size.
    most = max(block_rows, round((2 * n * NODES ** (2 * dims) / NEAR) ** (1 / 3))) if compact else block_rows
    most = min(most, max(LEAST, -(-n // (2 * tasks)))) if block_rows > LEAST else most
    blocks = -(-n // most)
    if compact:  # slabs, and pieces of slabs, of about equal sides
        spans = [(high - low) or 1.0 for low, high in zip(top[1 + len(labels)::2], top[2 + len(labels)::2])]
        slabs = round((blocks * spans[0] / spans[1]) ** 0.5) if dims == 2 else blocks
        slabs, order = min(max(slabs, 1), blocks), ["f1", "f0"] if dims == 2 else ["f0"]
        spread = rows.repartitionByRange(slabs, "f0").sortWithinPartitions(*order)
    else:  # points of equal labels side by side
        order = [f"l{i}" for i in range(len(labels))]
        spread = rows.repartitionByRange(min(blocks, 2 * tasks), *order, "f0").sortWithinPartitions(*order)
    made = spread.mapInArrow(_packed(dims, np.cumsum([0, *sizes]), most, compact), "rows binary")
    # Few blocks a task, however many there are: a task holds its own and the sums of their points.
    dealt = made.repartition(max(1, min(blocks, 2 * tasks), -(-blocks // TASK_BLOCKS)))
    packed = cut(dealt.mapInArrow(_bundled, "points binary").select(F.monotonically_increasing_id().alias("block"), "points"))
    # Every task reads the blocks one after another from the checkpoint; its own ones are the right side.
    passing = packed.coalesce(1).select(F.col("block").alias("met"), F.col("points").alias("other"))
    pairs = passing.hint("shuffle_replicate_nl").crossJoin(packed).select("block", "points", "met", "other")
    s = pairs.mapInArrow(_point_silhouettes(sizes), "i int, cluster int, weight long, s double")
    return s.select(F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("i") + 1).alias("labelling"), "cluster", "weight", "s")


def silhouette(df: DataFrame, features: list[str], labels: list[str], block_rows: int = BLOCK) -> DataFrame:
    """(labelling, cluster, n, silueta): the mean over the points of each cluster."""
    points = point_silhouettes(df, features, labels, block_rows)
    return points.groupBy("labelling", "cluster").agg(F.sum("weight").alias("n"), (F.sum(F.col("s") * F.col("weight")) / F.sum("weight")).alias("silueta"))
