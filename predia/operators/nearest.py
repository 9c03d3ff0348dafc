"""Exact k-nearest-neighbour join on a few numeric features, without all-pairs work.

Distance: sum of weight * (difference)^2, plus a fixed penalty when the category differs (the
one-hot form of a category adds exactly 2). Ties go to the lower reference id.

1. Equal reference vectors share one row that keeps only the lowest ids any answer can use, and
   equal query vectors are searched once. A vector held by a third of all rows is one row.
2. Space is cut into grids of halving width, from one cell that holds everything down to 2^-49 of it.
   Only cells that still hold enough references are cut further, a few grids per pass, so the depth
   follows the population: two dense clusters far apart are cut as finely as one. A cell keeps its
   count and the box its references fill.
3. The finest cell around a query that holds k references gives, by its box, a proven upper bound of
   the k-th distance. The query is joined by equality to the cells its bound can reach, on the finest
   grid as wide as the bound. A reached cell that is crowded, because the query stands outside of a
   cluster, is replaced by its children, whose boxes tighten the bound, until none is.
4. Only references within the bound are ranked. Nothing is capped: where fewer than k references
   exist, the one cell that holds everything is met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from predia.session import cut

ANY = "*"
MAX_LISTED_ANCHORS = 64
SLACK = 1 + 1e-9  # cells are found with rounded arithmetic, so the bound is widened a little
DEPTH = 49  # halvings below the one cell; cell numbers stay exact in doubles
STEP = 6  # grids counted in one pass over the references
LEAF = 24  # distinct vectors of a cell that is not cut further
CROWD = 512  # distinct vectors of a cell that are met as they are


def _extent(frames: list[DataFrame], scaled: list[Column]) -> list[tuple[float, float]]:
    """Least and greatest value per axis."""
    both = reduce(DataFrame.unionByName, [df.select(*[c.alias(f"x{i}") for i, c in enumerate(scaled)]) for df in frames])
    row = both.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(scaled)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [(row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i in range(len(scaled))]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


class _Grids:
    """Cells of the references and how many they hold, as deep as their population asks for."""

    def __init__(self, protos: DataFrame, by: list[str], dims: int, need: int, width: float):
        self.by, self.dims, self.need, self.width = by, dims, need, width
        self.gs, self.cs, self.ss = ([f"{n}{i}" for i in range(dims)] for n in "gcs")
        self.boxes = [f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]
        self.cells, self.lowest = self._count(protos)

    def at(self, level: Column | int) -> list[Column]:
        shift = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
        return [F.floor(F.col(c) / shift).alias(g) for c, g in zip(self.cs, self.gs)]

    def _grouped(self, rows: DataFrame, n: Column, v: Column, lo: str, hi: str, keys: list[str]) -> DataFrame:
        box = [f(f"{src}{i}").alias(f"{out}{i}") for i in range(self.dims) for f, src, out in ((F.min, lo, "lo"), (F.max, hi, "hi"))]
        return rows.groupBy(*keys).agg(n.alias("n"), v.alias("v"), *box)

    def _count(self, protos: DataFrame) -> tuple[DataFrame, int]:
        """(by, space, level, cell, n, v, box): references and distinct vectors per category and over all.

        Each pass counts a few grids; the references of cells that can still give a finer bound go on.
        """
        active = protos.select(*self.by, "cat", *self.cs, *self.ss, F.size("members").alias("n"))
        found, level = [], DEPTH
        while True:
            last = max(level - STEP + 1, 0)
            spread = active.select(*self.by, "cat", *self.cs, *self.ss, "n", F.explode(F.sequence(F.lit(last), F.lit(level))).alias("level"))
            spread = spread.select(*self.by, "cat", "level", *self.at(F.col("level")), *self.ss, "n")
            keys = [*self.by, "level", *self.gs]
            own = self._grouped(spread, F.sum("n"), F.count("*"), "s", "s", ["cat", *keys])  # one shuffle, used twice
            every = self._grouped(own, F.sum("n"), F.sum("v"), "lo", "hi", keys)
            named = own.withColumn("space", F.concat(F.lit("="), F.col("cat"))).drop("cat")
            both = cut(named.unionByName(every.withColumn("space", F.lit(ANY))))
            found.append(both)
            deeper = both.filter((F.col("space") == ANY) & (F.col("level") == last) & (F.col("n") >= self.need) & (F.col("v") > LEAF))
            if last == 0 or deeper.isEmpty():
                return reduce(DataFrame.unionByName, found), last
            inside = active.select("*", *self.at(last)).join(deeper.select(*self.by, *self.gs), [*self.by, *self.gs], "left_semi")
            active, level = cut(inside.drop(*self.gs)), last - 1

    def bounds(self, vectors: DataFrame) -> DataFrame:
        """Per query cell of the lowest grid the finest cell with enough references around it, of its own
        category (`own`) and over all (`every`)."""
        places = vectors.select(*self.by, "cat", *self.at(self.lowest)).distinct().withColumnsRenamed(dict(zip(self.gs, self.cs)))
        over = places.select(*self.by, "cat", *self.cs, F.explode(F.sequence(F.lit(self.lowest), F.lit(DEPTH))).alias("level"))
        over = over.select("*", *self.at(F.col("level") - self.lowest))
        enough = self.cells.filter(F.col("n") >= self.need)
        keys = [*self.by, "space", "level", *self.gs]
        spaces = over.withColumn("space", F.explode(F.array(F.lit(ANY), F.concat(F.lit("="), F.col("cat")))))
        met = spaces.join(enough, keys).withColumn("b", F.struct("level", *self.boxes))
        best = met.groupBy(*self.by, "cat", *self.cs).agg(
            F.min(F.when(F.col("space") == ANY, F.col("b"))).alias("every"), F.min(F.when(F.col("space") != ANY, F.col("b"))).alias("own"))
        return best.withColumnsRenamed(dict(zip(self.cs, self.gs)))

    def farthest(self, box: str = "") -> Column:
        """Squared distance from the query to the farthest corner of a box."""
        far = [F.greatest(F.abs(F.col(f"s{i}") - F.col(f"{box}lo{i}")), F.abs(F.col(f"{box}hi{i}") - F.col(f"s{i}"))) for i in range(self.dims)]
        return _total([d * d for d in far])


def nearest_join(
    queries: DataFrame,
    refs: DataFrame,
    query_id: str,
    ref_id: str,
    features: list[str],
    k: int,
    weights: list[float] | None = None,
    category: str | None = None,
    penalty: float = 2.0,
    payload: list[str] | None = None,
    exclude_self: bool = False,
    by: list[str] | None = None,
    crowd: int = CROWD,
) -> DataFrame:
    """Rows (by, query_id, rank, ref_id, payload, distance), at most k per query.

    `by` columns must be equal on both sides; `exclude_self` drops the reference whose id is the
    query's own. Features must not be null.
    """
    by, payload = by or [], payload or []
    weights = weights or [1.0] * len(features)
    need = k + 1 if exclude_self else k
    dims = len(features)
    fs = [f"f{i}" for i in range(dims)]
    cat = F.col(category) if category else F.lit("")
    keys = [*by, cat.alias("cat"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, fs)]]

    # 1. distinct vectors on both sides; both are read several times below, so computed once
    load = F.struct(*[F.col(p) for p in payload]) if payload else F.lit(None).cast("string")
    lowest = Window.partitionBy(*by, "cat", *fs).orderBy("id")
    protos = cut(
        refs.select(*keys, F.col(ref_id).alias("id"), load.alias("load"))
        .withColumn("_n", F.row_number().over(lowest))
        .filter(F.col("_n") <= need)
        .groupBy(*by, "cat", *fs)
        .agg(F.collect_list(F.struct("id", "load")).alias("members"))
    )
    vectors = cut(queries.select(*keys).distinct())
    scaled = [F.col(f) * (w ** 0.5) for f, w in zip(fs, weights)]
    extent = _extent([vectors, protos], scaled)
    span = max(hi - lo for lo, hi in extent) * SLACK or 1.0
    finest = span / 2.0**DEPTH
    fuzz = finest + 4e-16 * dims * max(abs(x) for pair in extent for x in pair)  # rounding of coordinates
    places = [(x - F.lit(lo)).alias(f"s{i}") for i, (x, (lo, _)) in enumerate(zip(scaled, extent))]
    cells = [F.floor((x - F.lit(lo)) / finest).alias(f"c{i}") for i, (x, (lo, _)) in enumerate(zip(scaled, extent))]
    protos = protos.select("*", *places, *cells)
    vectors = vectors.select("*", *places, *cells)

    # 2. and the bound of every query from the boxes around it
    grids = _Grids(protos, by, dims, need, finest)
    gs, ss = grids.gs, grids.ss
    own, every = F.when(F.col("own").isNotNull(), grids.farthest("own.")), F.when(F.col("every").isNotNull(), grids.farthest("every."))
    bounded = vectors.select(*by, "cat", *fs, *ss, *grids.at(grids.lowest)).join(grids.bounds(vectors), [*by, "cat", *gs], "left")
    widened = F.sqrt(F.least(own, every + penalty if category else every)) * SLACK + fuzz
    radius, w = F.sqrt("r2"), F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    # The search grid is the finest one at least as wide as the radius: 3 cells per axis at most.
    fitting = F.least(F.greatest(F.ceil(F.log2(radius / finest)), F.lit(grids.lowest)), F.lit(DEPTH))
    ready = bounded.select(*by, "cat", *fs, *ss, F.coalesce(widened * widened, F.lit(float("inf"))).alias("r2"))
    ready = ready.withColumn("level", F.when(F.col("r2") < float("inf"), fitting).otherwise(DEPTH).cast("int"))
    # A few bytes per vector here become many cells below, so the rows are spread evenly first.
    ready = ready.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # 3. equality join on the cells in reach
    highest = F.pow(F.lit(2.0), F.lit(DEPTH) - F.col("level")) - 1
    reached = ready
    for i in range(dims):
        low = F.greatest(F.floor((F.col(f"s{i}") - radius) / w), F.lit(0)).cast("bigint")
        high = F.least(F.floor((F.col(f"s{i}") + radius) / w).cast("double"), highest).cast("bigint")
        reached = reached.withColumn(f"g{i}", F.explode(F.sequence(low, F.greatest(high, low))))
    gaps = [F.greatest(F.col(g) * w - F.col(s) - fuzz, F.col(s) - F.col(g) * w - w - fuzz, F.lit(0.0)) for g, s in zip(gs, ss)]
    crosses = F.col("r2") > penalty if category else F.lit(True)
    space = F.when(crosses, ANY).otherwise(F.concat(F.lit("="), F.col("cat")))
    query, cell = [*by, "cat", *fs], [*by, "space", "level", *gs]
    pairs = cut(reached.withColumn("space", space).filter(_total([g * g for g in gaps]) <= F.col("r2")).select(*query, *ss, "r2", "space", "level", *gs))
    pairs = _descended(pairs, grids, query, cell, need, max(crowd, need, LEAF), penalty if category else 0.0, fuzz)

    # 4. the references of those cells. Which grids are met: at most two rows per level.
    used = pairs.select("level", (F.col("space") == ANY).alias("anywhere")).distinct().collect()
    met = F.array(*[
        F.struct(
            F.lit(g["level"]).alias("level"),
            (F.lit(ANY) if g["anywhere"] else F.concat(F.lit("="), F.col("cat"))).alias("space"),
        )
        for g in used
    ]) if used else F.array().cast("array<struct<level:int,space:string>>")
    stored = (
        protos.select(*by, "cat", *fs, *grids.cs, "members", F.inline(met))
        .select(*by, F.col("cat").alias("rcat"), *[F.col(f).alias(f"r{f}") for f in fs], "members",
                "space", "level", *grids.at(F.col("level")))
    )
    d2 = _total([
        F.lit(weights[i]) * (F.col(f"f{i}") - F.col(f"rf{i}")) * (F.col(f"f{i}") - F.col(f"rf{i}"))
        for i in range(dims)
    ])
    if category:
        d2 = d2 + F.when(F.col("cat") == F.col("rcat"), 0.0).otherwise(F.lit(penalty))
    near = (
        pairs.join(stored, cell)
        .withColumn("d2", d2)
        .filter(F.col("d2") <= F.col("r2"))
        .select(*query, "d2", F.explode("members").alias("m"))
        .select(*query, "d2", "m.id", "m.load")
    )
    order = Window.partitionBy(*query).orderBy("d2", "id")
    found = (
        near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= need)
        .groupBy(*query)
        .agg(F.sort_array(F.collect_list(F.struct("_r", "id", "load", "d2"))).alias("hits"))
    )

    # back to the query rows; the answer of a vector is at most k+1 entries long
    rows = queries.select(*keys, F.col(query_id).alias("_qid"))
    hits = F.col("hits")
    if exclude_self:
        hits = F.filter(hits, lambda h: h["id"] != F.col("_qid"))
    joined = rows.join(found, query).select(
        *by, "_qid", F.posexplode(F.slice(hits, 1, k))
    )
    return joined.select(
        *by,
        F.col("_qid").alias(query_id),
        (F.col("pos") + 1).alias("rank"),
        F.col("col.id").alias(ref_id if ref_id != query_id else "vecino_id"),
        *[F.col(f"col.load.{p}").alias(p) for p in payload],
        F.sqrt("col.d2").alias("distancia"),
    )


def _descended(
    pairs: DataFrame, grids: _Grids, query: list[str], cell: list[str], need: int, crowd: int, penalty: float, fuzz: float
) -> DataFrame:
    """(query, cell) pairs with every crowded cell replaced by those of its children that the query can
    need. The children's counts and boxes lower the query's bound at each turn, so what is left of a
    cluster is its side towards the query."""
    crowded = grids.cells.filter((F.col("v") > crowd) & (F.col("level") > 0)).select(*cell)
    if crowded.isEmpty():
        return pairs
    crowded, columns = cut(crowded), pairs.columns
    settled = []
    while True:
        dense = pairs.join(crowded, cell, "left_semi")
        if dense.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, pairs])
        settled.append(pairs.join(crowded, cell, "left_anti"))
        children = dense.withColumn("level", F.col("level") - 1)
        for g in grids.gs:
            children = children.withColumn(g, F.explode(F.array(F.col(g) * 2, F.col(g) * 2 + 1)))
        held = children.join(grids.cells, cell)
        far = F.sqrt(grids.farthest() + F.when(F.col("space") == ANY, penalty).otherwise(0.0)) * SLACK + fuzz
        gaps = [F.greatest(F.col(f"lo{i}") - F.col(s) - fuzz, F.col(s) - F.col(f"hi{i}") - fuzz, F.lit(0.0)) for i, s in enumerate(grids.ss)]
        by_far = Window.partitionBy(*query).orderBy("far2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = held.withColumn("far2", far * far).withColumn("within", F.sum("n").over(by_far))
        bound = F.min(F.when(F.col("within") >= need, F.col("far2"))).over(Window.partitionBy(*query))
        tightened = summed.withColumn("r2", F.least("r2", bound)).filter(_total([g * g for g in gaps]) <= F.col("r2"))
        pairs = cut(tightened.select(*columns))


def nearest_on_earth(
    anchors: DataFrame, points: DataFrame, anchor_id: str, point_id: str, by: list[str] | None = None
) -> DataFrame:
    """Nearest point per anchor (columns lat, lng) with the haversine distance in metres; ties go to
    the lower point id.

    A short list of anchors is measured and goes to every point's row: one scan of the points and one
    row per anchor out of each task. More anchors meet the points in the neighbour join.
    """
    from predia.functions.geo import haversine_m, unit_sphere

    by = by or []
    listed = anchors.select(*by, anchor_id, F.col("lat").cast("double"), F.col("lng").cast("double")).limit(MAX_LISTED_ANCHORS + 1).collect()
    if len(listed) <= MAX_LISTED_ANCHORS:
        names = [f"_a{i}" for i in range(len(by))]
        types = dict(anchors.select(*by, anchor_id).dtypes)
        one = ", ".join(f"{n}: {types[b]}" for n, b in zip([*names, "_anchor"], [*by, anchor_id]))
        kind = f"array<struct<{one}, _lat: double, _lng: double>>"
        rows = F.array(*[F.struct(*[F.lit(v) for v in r]) for r in listed]).cast(kind)
        met = points.select(*[F.col(b).alias(f"_p{i}") for i, b in enumerate(by)], F.col(point_id).alias("_point"), "lat", "lng", F.inline(rows))
        for i in range(len(by)):
            met = met.filter(F.col(f"_p{i}") == F.col(f"_a{i}"))
        distance = haversine_m("_lat", "_lng", "lat", "lng")
        best = met.filter(distance.isNotNull()).groupBy(*names, "_anchor").agg(F.min(F.struct(distance.alias("d"), F.col("_point").alias("p"))).alias("b"))
        return best.select(*[F.col(n).alias(b) for n, b in zip(names, by)], F.col("_anchor").alias(anchor_id),
                           F.col("b.p").alias(point_id), F.col("b.d").alias("distancia_m"))

    def placed(df: DataFrame, key: str) -> DataFrame:
        xyz = [c.alias(n) for c, n in zip(unit_sphere("lat", "lng"), ("sx", "sy", "sz"))]
        return df.select(*(by or []), key, "lat", "lng", *xyz)

    pairs = nearest_join(
        placed(anchors, anchor_id), placed(points, point_id).withColumnsRenamed({"lat": "plat", "lng": "plng"}),
        anchor_id, point_id, ["sx", "sy", "sz"], 1, payload=["plat", "plng"], by=by,
    )
    return pairs.join(anchors.select(anchor_id, *(by or []), "lat", "lng"), [anchor_id, *(by or [])]).select(
        *(by or []), anchor_id, point_id,
        haversine_m("lat", "lng", "plat", "plng").alias("distancia_m"),
    )
