"""Planar and spherical geometry on plain columns.

A point is two doubles, a ring is array<struct<x,y>>, a polygon is an array of rings whose
first ring is the shell, a multipolygon is an array of polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from predia import constants as K
from predia.functions.text import col

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"
MULTIPOLYGON = f"array<{POLYGON}>"


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = (col(c) for c in (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * K.EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_sphere(lat, lng) -> list[Column]:
    """Coordinates on a sphere of earth radius; straight distance there orders like haversine."""
    lat, lng = F.radians(col(lat)), F.radians(col(lng))
    r = F.lit(K.EARTH_RADIUS_M)
    return [r * F.cos(lat) * F.cos(lng), r * F.cos(lat) * F.sin(lng), r * F.sin(lat)]


def ring_edges(ring: str | Column) -> Column:
    """Consecutive vertex pairs, closing the ring if it is open."""
    ring = col(ring)
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        shifted,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def let(value: Column, body) -> Column:
    """`body` of a value computed once; repeating a large expression would slow planning badly."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, names: list[str], terms) -> Column:
    """Struct of running sums of several terms in one pass over an array."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def step(acc: Column, e: Column) -> Column:
        values = terms(e)
        return F.struct(*[(acc[n] + v).alias(n) for n, v in zip(names, values)])

    return F.aggregate(items, zero, step)


def ring_moments(ring: str | Column) -> Column:
    """Signed area and first moments about the first vertex, which is kept as (ox, oy)."""
    ring = col(ring)

    def about(origin: Column) -> Column:
        ox, oy = origin["x"], origin["y"]

        def terms(e: Column) -> list[Column]:
            cross = (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy)
            return [
                cross / 2,
                (e["x1"] + e["x2"] - 2 * ox) * cross / 6,
                (e["y1"] + e["y2"] - 2 * oy) * cross / 6,
            ]

        sums = _fold(ring_edges(ring), ["area", "mx", "my"], terms)
        return let(
            sums,
            lambda m: F.struct(
                m["area"].alias("area"), m["mx"].alias("mx"), m["my"].alias("my"),
                ox.alias("ox"), oy.alias("oy"),
            ),
        )

    return let(ring[0], about)


def ring_area(ring: str | Column) -> Column:
    return F.abs(ring_moments(ring)["area"])


def polygon_area(polygon: str | Column) -> Column:
    """Shell minus holes, in squared units of the coordinates."""
    signed = F.transform(
        col(polygon), lambda r, i: ring_area(r) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    )
    return F.aggregate(signed, F.lit(0.0), lambda acc, a: acc + a)


def multipolygon_centroid(shape: str | Column) -> Column:
    """Area-weighted centroid as struct (x, y); holes weigh negative."""

    def part(ring: Column, i: Column) -> Column:
        sign = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return let(
            ring_moments(ring),
            lambda m: F.struct(
                (sign * F.abs(m["area"])).alias("w"),
                (m["ox"] + m["mx"] / m["area"]).alias("cx"),
                (m["oy"] + m["my"] / m["area"]).alias("cy"),
            ),
        )

    parts = F.flatten(F.transform(col(shape), lambda polygon: F.transform(polygon, part)))
    sums = _fold(parts, ["w", "x", "y"], lambda p: [p["w"], p["w"] * p["cx"], p["w"] * p["cy"]])
    return let(sums, lambda t: F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y")))


def largest_part(shape: str | Column) -> Column:
    """The part of most area and the percent of area it keeps; ties keep the first part."""
    shape = col(shape)
    sized = F.transform(
        shape, lambda p, i: F.struct(polygon_area(p).alias("area"), (-i).alias("tie"), p.alias("p"))
    )
    total = F.aggregate(F.transform(sized, lambda s: s["area"]), F.lit(0.0), lambda acc, a: acc + a)
    return let(
        F.struct(F.array_max(sized).alias("best"), total.alias("total"), F.size(shape).alias("n")),
        lambda t: F.struct(
            t["best"]["p"].alias("poligono"),
            (F.lit(100.0) * t["best"]["area"] / t["total"]).alias("pct_area"),
            (t["n"] - 1).alias("partes_descartadas"),
        ),
    )


def bounds(shape: str | Column) -> Column:
    points = F.flatten(F.flatten(col(shape)))
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def shape_edges(shape: str | Column) -> Column:
    """All edges of all rings of a multipolygon."""
    rings = F.flatten(col(shape))
    return F.flatten(F.transform(rings, ring_edges))


def trapezoids(shape: str | Column) -> Column:
    """The shape cut at the heights of its corners, with running areas; slabs without area are left out.

    Between two heights the edges that cross stand side by side, and by the even-odd rule every
    second gap is inside.
    """
    def cut(edges: Column) -> Column:
        ys = F.sort_array(F.array_distinct(F.transform(edges, lambda e: e["y1"])))

        def at(e: Column, y: Column) -> Column:
            return e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])

        def slab(i: Column) -> Column:
            y0, y1 = F.get(ys, i), F.get(ys, i + 1)
            crossing = F.filter(edges, lambda e: (F.least(e["y1"], e["y2"]) <= y0) & (F.greatest(e["y1"], e["y2"]) >= y1))
            sides = F.sort_array(F.transform(crossing, lambda e: F.struct(
                at(e, (y0 + y1) / 2).alias("m"), at(e, y0).alias("a"), at(e, y1).alias("b"))))

            def pair(xs: Column) -> Column:
                places = F.filter(F.sequence(F.lit(0), F.size(xs)), lambda j: (j % 2 == 0) & (j + 1 < F.size(xs)))
                return F.transform(places, lambda j: F.struct(
                    y0.alias("y0"), y1.alias("y1"), F.get(xs, j)["a"].alias("l0"), F.get(xs, j)["b"].alias("l1"),
                    F.get(xs, j + 1)["a"].alias("r0"), F.get(xs, j + 1)["b"].alias("r1")))

            return let(sides, pair)

        slabs = F.filter(F.sequence(F.lit(0), F.size(ys)), lambda i: i + 1 < F.size(ys))
        return F.flatten(F.transform(slabs, slab))

    def area(t: Column) -> Column:
        return (t["y1"] - t["y0"]) * (t["r0"] - t["l0"] + t["r1"] - t["l1"]) / 2

    names = ["y0", "y1", "l0", "l1", "r0", "r1"]
    kind = "array<struct<" + ",".join(f"{n}:double" for n in [*names, "upto"]) + ">>"
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast(kind).alias("out"))

    def step(s: Column, t: Column) -> Column:
        upto = s["sum"] + area(t)
        one = F.struct(*[t[n].alias(n) for n in names], upto.alias("upto"))
        return F.struct(upto.alias("sum"), F.concat(s["out"], F.array(one)).alias("out"))

    whole = F.filter(let(shape_edges(shape), cut), lambda t: area(t) > 0)
    return F.aggregate(whole, start, step, lambda s: s["out"])


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test over edge structs; a point on an edge counts as inside."""

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.when(spans & (x < at), 1).otherwise(0)

    def touches(e):
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (turn == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    odd = F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
    return F.exists(edges, touches) | odd
