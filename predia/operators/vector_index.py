"""An inverted-file index over unit vectors: lists around centres, searched by batches of queries.

Every vector lies in the list of its nearest centre, with its distance to that centre. A query meets
lists: the nearest ones in the fast mode, or all that the triangle inequality cannot exclude in the
exact mode. Distances here are straight ones between unit vectors; the cosine distance is half their
square, so their order is the same.

The centres are fitted on a bounded sample, the rows of the smallest id hashes; every row is indexed.
Centres are few and bounded (`MAX_CENTRES`), so they go to every task. Queries and lists meet in blocks
that are bounded on both sides, so neither a crowded list nor a popular one is a single task.

Defined results are those of `vector_topk`: a vector that is null or all zero is neither indexed nor
finds anything; distances are rounded and ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from predia.operators.scale import top_per_group
from predia.operators.vector_search import ROUND, Criteria, _search, _unit_of
from predia.session import cut, scratch_path

SAMPLE = 50_000
MAX_CENTRES = 4096
SLICE_ROWS = 20_000
MEET_CELLS = 1_000_000  # entries of the queries and of their best rows in a block, about 8 MB
FIRST_LISTS = 4  # lists that give the exact mode its first bound
SLACK = 1e-6  # rounding of distances between unit vectors


@dataclass
class VectorIndex:
    """`rows`: (list, id, v, gap, kept columns), sorted by list; `sizes` and `radii` per list."""

    centres: np.ndarray
    rows: DataFrame
    sizes: np.ndarray
    radii: np.ndarray


def _placed(centres: np.ndarray, name: str):
    """Nearest centre and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit_of(batch, name)
                d2 = (unit * unit).sum(1)[:, None] - 2 * unit @ centres.T + (centres * centres).sum(1)
                near = d2.argmin(1)
                gap = np.linalg.norm(unit - centres[near], axis=1)
                yield batch.assign(list=near.astype("int32"), gap=gap)

    return run


def build_index(
    vectors: DataFrame, vector_id: str = "listing_id", vector: str = "embedding", lists: int | None = None,
    keep: list[str] | None = None, sample: int = SAMPLE, seed: int = 42,
) -> VectorIndex:
    """Index written in the shared folder. By default the number of lists is the root of the row count;
    `keep` names columns that later criteria compare."""
    spark, keep = vectors.sparkSession, keep or []
    rows = vectors.select(
        F.col(vector_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"), *keep
    ).filter(F.exists("v", lambda x: x != 0))
    n = rows.count()
    lists = max(1, min(lists or round(n ** 0.5), MAX_CENTRES, n))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    unit = F.transform(F.col("v").cast("array<double>"), lambda x: x / F.sqrt(F.col("square")))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("square", square)
    centres = np.zeros((0, 1))
    if n:
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(cut(drawn.select(array_to_vector(unit).alias("features"))))
        centres = np.array(model.clusterCenters())
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"id bigint, v array<float>, {''.join(f'`{c}` {kinds[c]}, ' for c in keep)}list int, gap double"])
    path = scratch_path(spark, "vector_index")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInPandas(_placed(centres, "v"), schema)
    # By range of list and hash: a list that holds a third of all rows lies in a third of the files.
    placed.repartitionByRange(spread, F.col("list"), F.xxhash64("id")).sortWithinPartitions("list").write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect():
        sizes[r.list], radii[r.list] = r.n, r.radius
    return VectorIndex(centres, stored, sizes, radii)


def _pairs(index: VectorIndex, nearest: int | None, beyond: int = 0):
    """(query, list, d): the `nearest` lists of a query, or those after the first `beyond` within its reach."""
    held = np.flatnonzero(index.sizes)
    centres, radii = index.centres[held], index.radii[held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches if len(held) else ():
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                unit = _unit_of(part, "qv")
                d = np.sqrt(np.maximum((unit * unit).sum(1)[:, None] - 2 * unit @ centres.T + (centres * centres).sum(1), 0))
                order = np.argsort(d, axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                if nearest is not None:
                    wanted = place < nearest
                else:
                    wanted = (place >= beyond) & (d - radii <= part["reach"].to_numpy()[:, None] + SLACK)
                q, c = np.nonzero(wanted)
                yield part.iloc[q].assign(list=held[c].astype("int32"), d=d[q, c])

    return run


def _meet(index: VectorIndex, pairs: DataFrame, k: int, criteria: Criteria) -> DataFrame:
    """k best (query_id, id, distancia) per block of queries and slice of a list."""
    spark = pairs.sparkSession
    # What a list is asked for: at most MAX_CENTRES rows here, and two small numbers per list.
    asked = {r.list: r.n for r in pairs.groupBy("list").agg(F.count("*").alias("n")).collect()}
    a_block = max(1, MEET_CELLS // (max(index.centres.shape[1], 1) + 4 * k))
    plan = spark.createDataFrame(
        [(int(c), -(-int(index.sizes[c]) // SLICE_ROWS), -(-n // a_block)) for c, n in asked.items()], "list int, slices int, blocks int")
    plan = F.broadcast(plan)
    left = pairs.join(plan, "list").select(
        *pairs.columns, F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = index.rows.join(plan, "list").select(
        *index.rows.columns, F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "id": [], "distancia": []})
        # A vector nearer to the query than its reach lies about as far from the centre as the query does.
        gap, d, reach = v["gap"].to_numpy(), q["d"].to_numpy(), q["reach"].to_numpy() + SLACK
        near = np.full(len(v), bool(np.isinf(reach).any()))
        for a, r in zip(d, reach) if not near.all() else ():
            near |= np.abs(gap - a) <= r
        return _search(q, _unit_of(q, "qv"), iter([v[near]]), k, criteria)

    keys = ["list", "slice", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id bigint, id bigint, distancia double")


def search(
    index: VectorIndex, queries: DataFrame, k: int, lists: int | None = None, query_id: str = "query_id",
    query_vector: str = "vector", vector_id: str = "listing_id", criteria: Criteria | None = None,
) -> DataFrame:
    """Rows (query_id, rank, vector_id, distancia). With `lists` only the nearest so many lists are read;
    without, the result is exact: the first lists bound the k-th distance, and every list and row that the
    bound cannot exclude follows."""
    criteria = criteria or []
    qs = queries.select(
        F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).cast("array<double>").alias("qv"),
        *dict.fromkeys(c for c, _, _ in criteria), F.lit(float("inf")).alias("reach"),
    ).filter(F.exists("qv", lambda x: x != 0))
    qs = cut(qs)
    kinds = dict(qs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in qs.columns), "list int, d double"])
    first = _meet(index, qs.mapInPandas(_pairs(index, lists or FIRST_LISTS), schema), k, criteria)
    ranked = top_per_group(first, ["query_id"], [F.col("distancia"), F.col("id")], k)
    if lists is None:
        ranked = cut(ranked)
        worst = ranked.filter(F.col("rank") == k).select("query_id", F.sqrt(2 * (F.col("distancia") + 10.0**-ROUND)).alias("r"))
        reached = qs.drop("reach").join(worst, "query_id", "left").withColumn("reach", F.coalesce("r", F.lit(float("inf"))))
        more = _meet(index, reached.select(qs.columns).mapInPandas(_pairs(index, None, FIRST_LISTS), schema), k, criteria)
        ranked = top_per_group(ranked.drop("rank").unionByName(more), ["query_id"], [F.col("distancia"), F.col("id")], k)
    return ranked.select(
        F.col("query_id").alias(query_id), F.col("rank").cast("bigint").alias("rank"), F.col("id").alias(vector_id), "distancia")


def recall(found: DataFrame, exact: DataFrame, key: str, vector_id: str) -> DataFrame:
    """(n, aciertos, recall): how many of the exact hits were found."""
    hits = exact.select(key, vector_id).join(found.select(key, vector_id).withColumn("_hit", F.lit(1)), [key, vector_id], "left")
    return hits.agg(F.count("*").alias("n"), F.count("_hit").alias("aciertos")).withColumn("recall", F.col("aciertos") / F.col("n"))


def lists_for(index: VectorIndex, k: int, target: float, queries: int = 200) -> int:
    """The least number of lists that finds `target` of the exact neighbours of a bounded sample of the
    indexed vectors themselves, the ones of the smallest id hashes."""
    probe = cut(index.rows.orderBy(F.xxhash64("id"), "id").limit(queries).select(F.col("id").alias("query_id"), F.col("v").alias("vector")))
    exact = cut(search(index, probe, k))
    low, high = 1, max(1, int((index.sizes > 0).sum()))
    while low < high:
        middle = (low + high) // 2
        share = recall(search(index, probe, k, middle), exact, "query_id", "listing_id").first()["recall"] or 1.0
        low, high = (low, middle) if share >= target else (middle + 1, high)
    return low
