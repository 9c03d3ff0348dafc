"""Point-in-polygon join over a quadtree cover of each shape.

A shape is covered by square cells. The first are as wide as the shape; a cell that more than a few edges
cross is cut into sixteen, until few do. A border cell keeps the edges that cross it and whether its lower
left corner is inside; a cell without edges is inside as a whole, or left out. So a country has large inner
cells and small ones along its border, a street a few small ones, and no cell grows with the shape.

Whether a point of a cell is inside follows from the corner and the edges crossed on the way there, first
level, then down the cell's left side, so the edges of the cell are all that is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from predia.functions.geo import bounds, shape_edges
from predia.session import cut

MOST_EDGES = 16
STEP = 2  # halvings per turn
LEAST_SIZE = -40  # cells of 2^-40 degrees are not cut further, however many edges meet there
#: Cells begin at an odd place, so that coordinates of few digits never lie on their sides.
ORIGIN = -512.000001234567


def _size(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def _number(value: Column, k: Column) -> Column:
    return F.floor((value - F.lit(ORIGIN)) / _size(k)).cast("bigint")


def _side(number: Column, k: Column) -> Column:
    return number * _size(k) + F.lit(ORIGIN)


def _spans(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _meets(e: Column, y: Column) -> Column:
    """Where an edge that spans a height meets it."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def _odd(edges: Column, crossed) -> Column:
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crossed(e), 1).otherwise(0)) % 2 == 1


def _inside(corner: Column, edges: Column, left: Column, low: Column, x: Column, y: Column) -> Column:
    """Even-odd state of a place of the cell whose lower left corner (left, low) has the state `corner`."""

    def level(e: Column) -> Column:
        at = _meets(e, y)
        return _spans(e, y) & (at > left) & (at <= x)

    def upright(e: Column) -> Column:
        at = (e["y2"] - e["y1"]) * (left - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        return ((e["x1"] > left) != (e["x2"] > left)) & (at > low) & (at <= y)

    return (corner != _odd(edges, level)) != _odd(edges, upright)


def _touches(e: Column, x: Column, y: Column) -> Column:
    turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (turn == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _crossing(edges: Column, left: Column, low: Column, size: Column) -> Column:
    """Edges that may meet a cell: none that does is lost, as the cell is taken a hair wider."""
    half = size * (0.5 + 1e-6)
    x, y = left + size / 2, low + size / 2

    def near(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        apart = F.abs(dx * (y - e["y1"]) - dy * (x - e["x1"])) > (F.abs(dx) + F.abs(dy)) * half
        return (
            ~apart & (F.greatest(e["x1"], e["x2"]) >= x - half) & (F.least(e["x1"], e["x2"]) <= x + half)
            & (F.greatest(e["y1"], e["y2"]) >= y - half) & (F.least(e["y1"], e["y2"]) <= y + half)
        )

    return F.filter(edges, near)


def shape_cover(shapes: DataFrame, name: str = "nombre", geom: str = "geom", rank: str = "orden", most_edges: int | None = None) -> DataFrame:
    """(k, cx, cy, nombre, orden, corner, edges): the cells of every shape, 2^k degrees wide."""
    most = MOST_EDGES if most_edges is None else most_edges
    left, low, size = _side(F.col("cx"), F.col("k")), _side(F.col("cy"), F.col("k")), _size(F.col("k"))
    columns = ["nombre", "orden", "k", "cx", "cy", "corner", "edges"]
    rows = shapes.select(F.col(name).alias("nombre"), F.col(rank).alias("orden"), bounds(geom).alias("b"), shape_edges(geom).alias("all"))
    wide = F.greatest(F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y"), F.lit(2.0**LEAST_SIZE))
    rows = rows.withColumn("k", (F.ceil(F.log2(wide) / STEP) * STEP).cast("int"))
    for c, axis in (("cx", "x"), ("cy", "y")):
        rows = rows.withColumn(c, F.explode(F.sequence(_number(F.col(f"b.min_{axis}"), F.col("k")), _number(F.col(f"b.max_{axis}"), F.col("k")))))
    corner = _odd(F.col("all"), lambda e: _spans(e, low) & (_meets(e, low) > left))
    cells = cut(rows.select("nombre", "orden", "k", "cx", "cy", corner.alias("corner"), _crossing(F.col("all"), left, low, size).alias("edges")))
    settled = []
    while True:
        crowded = (F.size("edges") > most) & (F.col("k") > LEAST_SIZE)
        settled.append(cells.filter(~crowded & ((F.size("edges") > 0) | F.col("corner"))).select(columns))
        cells = cells.filter(crowded)
        if cells.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        within = F.sequence(F.lit(0), F.lit(2**STEP - 1))
        parts = cells.select("nombre", "orden", F.col("corner").alias("c0"), F.col("edges").alias("e0"), left.alias("left"), low.alias("low"),
                             (F.col("k") - STEP).alias("k"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        for own, parent in (("cx", "px"), ("cy", "py")):
            parts = parts.withColumn("i", F.explode(within)).withColumn(own, F.col(parent) * 2**STEP + F.col("i"))
        state = _inside(F.col("c0"), F.col("e0"), F.col("left"), F.col("low"), left, low)
        cells = cut(parts.select("nombre", "orden", "k", "cx", "cy", state.alias("corner"), _crossing(F.col("e0"), left, low, size).alias("edges")))


def assign_zone(
    points: DataFrame,
    shapes: DataFrame,
    point_id: str = "id",
    name: str = "nombre",
    geom: str = "geom",
    rank: str = "orden",
    lat: str = "lat",
    lng: str = "lng",
    out: str = "corregimiento_asignado",
    most_edges: int | None = None,
) -> DataFrame:
    """Every point with the first shape, by rank, that holds it or has it on its border; null outside all.

    Each place is searched once, however many points stand there, in its cell of every size in use: an
    equality join. A cell that is inside one shape as a whole needs no shape that comes later. Answers are
    the least of what a place meets, so shapes crowded in a cell are never gathered.
    """
    cover = cut(shape_cover(shapes, name, geom, rank, most_edges))
    cell = ["k", "cx", "cy"]
    order = F.struct("orden", "nombre")
    whole = cover.filter(F.size("edges") == 0).groupBy(*cell).agg(F.min(order).alias("first"))
    needed = cover.join(whole, cell, "left").filter(F.col("first").isNull() | (order <= F.col("first"))).drop("first")
    sizes = [r.k for r in cover.select("k").distinct().collect()]  # one per power of two in use
    x, y = F.col("_x"), F.col("_y")
    places = points.select(F.col(lng).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).dropna().distinct()
    placed = places.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>")))
    placed = placed.withColumn("cx", _number(x, F.col("k"))).withColumn("cy", _number(y, F.col("k")))
    state = _inside(F.col("corner"), F.col("edges"), _side(F.col("cx"), F.col("k")), _side(F.col("cy"), F.col("k")), x, y)
    held = placed.join(needed, cell).filter(state | F.exists("edges", lambda e: _touches(e, x, y)))
    found = held.groupBy("_x", "_y").agg(F.min(order)["nombre"].cast("string").alias("_zone"))
    joined = points.join(found, (F.col(lng).cast("double") == x) & (F.col(lat).cast("double") == y), "left")
    return joined.withColumn(out, F.col("_zone")).drop("_x", "_y", "_zone")
