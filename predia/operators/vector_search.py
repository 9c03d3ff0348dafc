"""Top-k vector search by cosine distance, exact and by hashing.

Vectors pass queries in runs. Equal vectors of a run are one, with their rows by id; a product in single
precision, less its proven error, tells which vectors can still be among a query's k best, and only
those are measured in double precision. So a vector held by many rows is compared once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from predia.operators.scale import top_per_group
from predia.session import cut

ROUND = 9  # distances closer than 1e-9 are ties and go to the lower id
MAX_QUERY_CELLS = 4_000_000  # vector entries one task holds of the query side, about 32 MB
SCAN_CELLS = 64_000  # vector entries of few queries: they go to every task, the vectors stay where they are
RUN_ROWS = 50_000
PRODUCT_CELLS = 1_000_000  # similarities held at once
HITS = 16_384  # similarities measured again at once
SHARED = 64  # queries of a block with equal bounds, from which on rows are tested once for all of them
NO_ID = -(2**63)  # a null id, which sorts first


def _unit(block: np.ndarray) -> np.ndarray:
    return block / np.linalg.norm(block, axis=1, keepdims=True)


# A criterion compares a query column with a vector column: (query column, "eq"|"ge"|"le", column).
Criteria = list[tuple[str, str, str]]


def _unit_of(rows: pd.DataFrame, column: str) -> np.ndarray:
    """Unit vectors; one without a direction (all zero) has no distance to anything."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return _unit(np.vstack(rows[column].to_list()).astype("float64"))


def _numbers(column: pd.Series) -> np.ndarray:
    """As doubles; a missing value compares false with everything."""
    return column.to_numpy(dtype="float64", na_value=np.nan)


class _Run:
    """Rows that pass queries, sorted by vector and id: distinct vectors and the place of each row among them.

    `codes` has the columns compared for equality as (value to number, numbers), `numbers` the others.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, vectors: np.ndarray, codes: dict, numbers: dict):
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = _unit(vectors.astype("float64"))
        directed = np.isfinite(unit).all(1)  # one without a direction is not found
        if not directed.all():
            kept, unit = directed[at], unit[directed]
            ids, at = ids[kept], (np.cumsum(directed) - 1)[at[kept]]
            codes, numbers = {c: (v, x[kept]) for c, (v, x) in codes.items()}, {c: x[kept] for c, x in numbers.items()}
        self.ids, self.at, self.unit, self.codes, self.numbers = ids, at, unit, codes, numbers
        self.coarse = unit.astype("float32")

    def equal(self, bounds: tuple) -> np.ndarray:
        rows = np.ones(len(self.ids), bool)
        for c, value in bounds:
            known, codes = self.codes[c]
            rows &= codes == known.get(value, -2)
        return np.flatnonzero(rows)


def _sorted_run(ids: np.ndarray, vectors: np.ndarray, equal: dict[str, pd.Series], numbers: dict[str, pd.Series]) -> tuple:
    """What makes a _Run, from rows in any order."""
    vectors = np.ascontiguousarray(vectors, "float32")
    whole = vectors.view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel()
    at, distinct = pd.factorize(np.fromiter((x.tobytes() for x in whole), object, len(whole)))
    order = np.lexsort((ids, at))
    codes = {}
    for c, column in equal.items():
        number, known = pd.factorize(column.astype(object))
        codes[c] = ({v: i for i, v in enumerate(known.tolist())}, number[order].astype("int32"))
    return (ids[order], at[order].astype("int32"), np.frombuffer(b"".join(distinct), "float32").reshape(len(distinct), -1),
            codes, {c: _numbers(x)[order] for c, x in numbers.items()})


def _run_of(rows: pd.DataFrame, criteria: Criteria) -> _Run:
    equal, numbers = _compared(criteria)
    return _Run(*_sorted_run(rows["id"].to_numpy("int64"), np.vstack(rows["v"].to_list()), {c: rows[c] for c in equal}, {c: rows[c] for c in numbers}))


def _compared(criteria: Criteria) -> tuple[list[str], list[str]]:
    """Columns of the vectors compared for equality, and by size."""
    return [*dict.fromkeys(c for _, op, c in criteria if op == "eq")], [*dict.fromkeys(c for _, op, c in criteria if op != "eq")]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the stretch, place) for every place of stretches that begin at `first`."""
    i = np.repeat(np.arange(len(first)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]


class _Nearest:
    """The k best rows so far of a block of queries that runs of vectors pass; ties by id.

    No bound in a query column (null) admits all rows. Queries with equal equality bounds meet only the
    rows that have those values. Where many queries share all bounds, or one has not yet found k rows, rows are
    tested first and only vectors with a fitting row are compared; else the few rows that are near enough are tested.
    """

    def __init__(self, queries: pd.DataFrame, unit: np.ndarray, k: int, criteria: Criteria):
        n = len(queries)
        self.query_id, self.k, self.unit, self.coarse = queries["query_id"].to_numpy(), k, unit, unit.astype("float32")
        self.error = (unit.shape[1] + 8) * 2.0**-24 * 1.1 + 2 * 10.0**-ROUND
        self.d, self.who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.bounds = [(op, c, _numbers(queries[q])) for q, op, c in criteria if op != "eq"]
        wanted = [(c, queries[q].to_list()) for q, op, c in criteria if op == "eq"]
        equal = [tuple((c, x[i]) for c, x in wanted if x[i] is not None and x[i] == x[i]) for i in range(n)]
        group = pd.factorize(np.fromiter(equal, object, n))[0]
        order = np.argsort(group, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if n else []
        self.groups = [(equal[part[0]], part) for part in parts]
        # Queries with all bounds equal have one number.
        bytes_of = np.column_stack([group.astype("float64"), *[b for _, _, b in self.bounds]])
        self.kind = np.unique(np.where(np.isnan(bytes_of), -np.inf, bytes_of), axis=0, return_inverse=True)[1].ravel() if n else group
        self.shared = np.bincount(self.kind, minlength=1) >= SHARED

    def meet(self, run: _Run) -> None:
        for equal, members in self.groups:
            rows = run.equal(equal)
            if not len(rows):
                continue
            first = self.shared[self.kind[members]] | np.isinf(self.d[members, -1])
            for kind in np.unique(self.kind[members[first]]):
                own = members[first & (self.kind[members] == kind)]
                fit = rows[self._fits(np.full(len(rows), own[0]), rows, run)] if self.bounds else rows
                self._compare(own, fit, run, False)
            self._compare(members[~first], rows, run, True)

    def _fits(self, q: np.ndarray, rows: np.ndarray, run: _Run) -> np.ndarray:
        ok = np.ones(len(rows), bool)
        for op, c, bound in self.bounds:
            b, x = bound[q], run.numbers[c][rows]
            ok &= np.isnan(b) | (x >= b if op == "ge" else x <= b)
        return ok

    def _floor(self, q: np.ndarray) -> np.ndarray:
        """Similarities below this cannot be among the k best."""
        return np.nextafter((1.0 - self.d[q, -1] - self.error).astype("float32"), np.float32(-np.inf))[:, None]

    def _compare(self, queries: np.ndarray, rows: np.ndarray, run: _Run, test: bool) -> None:
        if not len(rows) or not len(queries):
            return
        at = run.at[rows]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count, coarse = np.diff(np.append(first, len(rows))), run.coarse[at[first]]
        # All of a vector's rows fit, so k of them do for it, or some must be tested.
        few = 8 * self.k if test else self.k
        step = max(1, PRODUCT_CELLS // len(first))
        for start in range(0, len(queries), step):
            part = queries[start:start + step]
            near = self.coarse[part] @ coarse.T
            hits = near >= self._floor(part)
            if len(first) > few and np.count_nonzero(hits) > 4 * few * len(part):
                close = np.partition(near, len(first) - few, axis=1)[:, len(first) - few, None]
                if not test:  # k fitting vectors are as near as this, but for the error
                    close = np.nextafter((close - 2 * self.error).astype("float32"), np.float32(-np.inf))
                closest = near >= close
                self._measure(part, hits & closest, at, first, count, rows, run, test)
                hits = (near >= self._floor(part)) & ~closest if test else None
            if hits is not None:
                self._measure(part, hits, at, first, count, rows, run, test)

    def _measure(self, part, hits, at, first, count, rows, run, test) -> None:
        i, v = np.nonzero(hits)
        for start in range(0, len(i), HITS):
            q, f = part[i[start:start + HITS]], first[v[start:start + HITS]]
            n = count[v[start:start + HITS]]
            d = np.round(1.0 - np.einsum("ij,ij->i", self.unit[q], run.unit[at[f]]), ROUND) + 0.0  # no negative zero
            ok = d <= self.d[q, -1]
            q, f, n, d = q[ok], f[ok], n[ok], d[ok]
            if not test:
                j, row = _spread(f, np.minimum(n, self.k))
                self._keep(q[j], d[j], run.ids[rows[row]])
                continue
            found = np.zeros(len(q), np.int64)
            while len(q):  # rows of a vector in turn, until k of them fit
                span = max(4 * self.k, PRODUCT_CELLS // len(q))
                j, row = _spread(f, np.minimum(n, span))
                fit = self._fits(q[j], rows[row], run)
                j, row = j[fit], row[fit]
                self._keep(q[j], d[j], run.ids[rows[row]])
                found += np.bincount(j, minlength=len(q))
                more = (n > span) & (found < self.k)
                q, d, found, f, n = q[more], d[more], found[more], f[more] + span, n[more] - span

    def _keep(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        i, _ = _spread(start, np.diff(np.append(start, len(q))))
        place = np.arange(len(q)) - start[i]
        best, i, place, touched = place < self.k, i, place, q[start]
        new_d, new_id = np.full((len(touched), self.k), np.inf), np.full((len(touched), self.k), np.iinfo(np.int64).max)
        new_d[i[best], place[best]], new_id[i[best], place[best]] = d[best], ids[best]
        both_d, both_id = np.hstack([self.d[touched], new_d]), np.hstack([self.who[touched], new_id])
        order = np.lexsort((both_id, both_d))[:, :self.k]
        self.d[touched], self.who[touched] = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_id, order, 1)

    def rows(self) -> pd.DataFrame:
        q, place = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"query_id": self.query_id[q], "id": self.who[q, place], "distancia": self.d[q, place]})


def _search(queries: pd.DataFrame, q_unit: np.ndarray, batches: Iterator[pd.DataFrame], k: int, criteria: Criteria) -> pd.DataFrame:
    """k nearest over all batches for every query; what leaves the task is k rows per query."""
    best = _Nearest(queries, q_unit, k, criteria)
    for batch in batches:
        if len(batch):
            best.meet(_run_of(batch, criteria))
    return best.rows()


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "vector",
    vector_id: str = "listing_id",
    vector: str = "embedding",
    criteria: Criteria | None = None,
) -> DataFrame:
    """Exact rows (query_id, rank, vector_id, distancia), k per query.

    A vector without a direction (null or all zero) has no cosine: it is neither found nor does it
    find anything. Filters shared by all queries belong on `vectors` before the call; `criteria` are bounds each
    query carries itself, applied before ranking. The query side is measured: few queries go
    to every task and the vectors are read once without a shuffle. A larger query table is packed into
    bounded blocks, and the vectors into bounded runs that pass them from the checkpoint; neither is copied in a
    shuffle. Only k rows per query leave a task.
    """
    criteria = criteria or []
    equal, numbers = _compared(criteria)
    known = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(NO_ID))
    qs = cut(queries.select(
        known(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("qv"),
        *dict.fromkeys(c for c, _, _ in criteria),
    ).filter(F.exists("qv", lambda x: x != 0)))
    vs = vectors.select(
        known(vector_id).alias("id"), F.col(vector).cast("array<float>").alias("v"), *dict.fromkeys([*equal, *numbers]),
    ).filter(F.exists("v", lambda x: x != 0))
    cells = qs.agg(F.sum(F.size("qv")).alias("n")).first()["n"] or 0
    if cells <= min(MAX_QUERY_CELLS, SCAN_CELLS):
        held = qs.toPandas() if cells else None
        if held is None:
            partial = vs.select(F.lit(0).cast("bigint").alias("query_id"), "id", F.lit(0.0).alias("distancia")).limit(0)
        else:
            q_unit = _unit_of(held, "qv")

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                yield _search(held, q_unit, batches, k, criteria)

            partial = vs.mapInPandas(scan, FOUND)
    else:
        partial = _passed(qs, vs, k, cells, criteria)
    ranked = top_per_group(partial, ["query_id"], [F.col("distancia"), F.col("id")], k)
    return ranked.select(
        F.nullif("query_id", F.lit(NO_ID)).alias(query_id), F.col("rank").cast("bigint").alias("rank"),
        F.nullif("id", F.lit(NO_ID)).alias(vector_id), "distancia",
    )


FOUND = "query_id bigint, id bigint, distancia double"


def _packed_queries(most: int):
    """Queries in blocks of bounded length, each one binary value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = []
        for batch in batches:
            while len(batch):
                room = most - sum(map(len, waiting))
                waiting.append(batch.iloc[:room])
                batch = batch.iloc[room:]
                if sum(map(len, waiting)) == most:
                    yield pack(waiting)
                    waiting = []
        if waiting:
            yield pack(waiting)

    def pack(waiting: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(waiting, ignore_index=True)
        return pd.DataFrame({"own": [pickle.dumps((part.drop(columns=["qv"]), _unit_of(part, "qv")))]})

    return run


def _packed_rows(criteria: Criteria, most: int):
    """Rows in runs of bounded length, each one binary value."""
    equal, numbers = _compared(criteria)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting, n = [*waiting, batch], n + len(batch)
            if n >= most:
                yield pack(waiting)
                waiting, n = [], 0
        if n:
            yield pack(waiting)

    def pack(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        v, dims = rows["v"], pc.unique(pc.list_value_length(rows["v"])).to_pylist()
        if len(dims) != 1:
            raise ValueError(f"vectors of different lengths: {dims}")
        matrix = pc.list_flatten(v).to_numpy().reshape(-1, dims[0])
        made = _sorted_run(rows["id"].to_numpy(), matrix, {c: rows[c].to_pandas() for c in equal}, {c: rows[c].to_pandas() for c in numbers})
        return pa.RecordBatch.from_pydict({"rows": pa.array([pickle.dumps(made)], pa.binary())})

    return run


def _passed(qs: DataFrame, vs: DataFrame, k: int, cells: int, criteria: Criteria) -> DataFrame:
    """k best per block of queries and share of the runs.

    Rows are dealt by ranges of the vector's hash, then the id's: equal vectors lie in one run, or in as many
    as they fill. Queries are dealt by their bounds. A task holds one block and reads its share of the runs.
    """
    tasks = int(qs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = qs.count()
    most = max(1, MAX_QUERY_CELLS // (2 * (cells // n + 4 * k)))
    bounds = [F.col(c) for c in dict.fromkeys(c for c, _, _ in criteria)]
    own = qs.repartitionByRange(-(-n // most), *bounds, F.xxhash64("query_id", "qv")).mapInPandas(_packed_queries(most), "own binary")
    own = cut(own.select(F.monotonically_increasing_id().alias("block"), "own"))
    spread = max(1, -(-vs.count() // RUN_ROWS))
    runs = cut(vs.repartitionByRange(spread, F.xxhash64("v"), F.xxhash64("id")).mapInArrow(_packed_rows(criteria, 2 * RUN_ROWS), "rows binary"))
    # A block comes with the first run of a task only, and is held.
    share = runs.coalesce(-(-tasks // -(-n // most))).select(F.monotonically_increasing_id().alias("run"), "rows")
    begins = F.col("run").bitwiseAND(F.lit(2**33 - 1)) == 0
    pairs = share.hint("shuffle_replicate_nl").crossJoin(own).select("run", "rows", "block", F.when(begins, F.col("own")).alias("own"))

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        at, passing = None, None
        for batch in batches:
            for number, rows, block, queries in zip(*(batch.column(c) for c in ("run", "rows", "block", "own"))):
                if number.as_py() != at:
                    at, passing = number.as_py(), _Run(*pickle.loads(rows.as_py()))
                if queries.is_valid:
                    held[block.as_py()] = _Nearest(*pickle.loads(queries.as_py()), k, criteria)
                held[block.as_py()].meet(passing)
        for one in held.values():
            yield pa.RecordBatch.from_pandas(one.rows(), preserve_index=False)

    return pairs.mapInArrow(pass_by, FOUND)


def vector_topk_hashed(
    vectors: DataFrame,
    query: list[float],
    k: int,
    vector_id: str = "listing_id",
    vector: str = "embedding",
    bucket: float = 0.5,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Approximate top-k of one query by random projections of the unit vectors."""
    size = float(np.linalg.norm(query))
    unit = F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.col("_norm"))
    squares = F.aggregate(
        F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x
    )
    features = (
        vectors.withColumn("_norm", F.sqrt(squares))
        .select(vector_id, array_to_vector(unit).alias("features"))
    )
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed
    )
    from pyspark.ml.linalg import Vectors

    key = Vectors.dense([float(x) / size for x in query])
    near = lsh.fit(features).approxNearestNeighbors(features, key, k, distCol="d")
    # On unit vectors the squared straight distance is twice the cosine distance.
    return near.select(vector_id, F.round(F.col("d") * F.col("d") / 2, ROUND).alias("distancia"))
