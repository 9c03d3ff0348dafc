"""Zone health index: four dimension scores, the weighted index, inheritance, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.functions.geo import MULTIPOLYGON, multipolygon_centroid, trapezoids
from predia.operators.aggregates import weighted_category_count, zone_point_counts
from predia.operators.nearest import nearest_on_earth
from predia.operators.scale import min_max_score, with_stats
from predia.operators.spatial import assign_zone
from predia.session import cut


def crime_rate(df: DataFrame, events: str = "incidentes", people: str = "poblacion") -> DataFrame:
    """Events per 100,000 people; null without people."""
    return df.withColumn(
        "tasa_por_100k", F.col(events) / F.nullif(F.col(people), F.lit(0)) * 100000
    )


def _require_all(zones: DataFrame, present: DataFrame, zone: str, what: str) -> DataFrame:
    """Scores of `present`, failing when the job runs if a listed zone is missing."""
    missing = zones.select(zone).join(present.select(zone), zone, "left_anti")
    count = missing.agg(F.count("*").alias("n")).scalar()
    guard = F.when(count > 0, F.raise_error(F.lit(f"zones without {what}"))).otherwise(F.lit(True))
    return present.filter(guard)


def safety_score(rates: DataFrame, zones: DataFrame, zone: str = "nombre", flat: str = "zero") -> DataFrame:
    """Inverted min-max of the rate over the listed zones; a listed zone without rate is an error."""
    kept = rates.filter(F.col("tasa_por_100k").isNotNull()).join(zones.select(zone), zone, "left_semi")
    kept = _require_all(zones, kept, zone, "rate")
    return min_max_score(kept, "tasa_por_100k", invert=True, flat=flat).select(zone, "tasa_por_100k", "score")


def transport_score(
    areas: DataFrame, sources: list[DataFrame], zone: str = "nombre", flat: str = "zero"
) -> DataFrame:
    """Points per square kilometre, min-max. `areas` lists the zones with superficie_km2."""
    counts = zone_point_counts(areas, sources, zone)
    density = counts.join(areas.select(zone, "superficie_km2"), zone).withColumn(
        "densidad", F.col("n") / F.col("superficie_km2")
    )
    # One row per zone: computed once, as the scaling reads it twice.
    return min_max_score(cut(density), "densidad", flat=flat).select(zone, "n", "densidad", "score")


def merged_category(column: str = "categoria") -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in K.MERGED_CATEGORY.items() for x in kv])
    return mapping[F.col(column)]


def tag_category(tags: Column, merged: bool = False) -> Column:
    """Category from a tag map, trying shop, then leisure, then amenity."""
    options = []
    for tag in K.TAG_ORDER:
        mapping = F.create_map(*[F.lit(x) for kv in K.TAG_CATEGORY[tag].items() for x in kv])
        options.append(mapping[tags[tag]])
    raw = F.coalesce(*options)
    if not merged:
        return raw
    both = F.create_map(*[F.lit(x) for kv in K.MERGED_CATEGORY.items() for x in kv])
    return both[raw]


def provenance(place_id: Column, feature_id: Column) -> Column:
    """Struct (fuente, place_id): an own place id, one inside the feature id, or a map feature."""
    prefix = "google_places/"
    return (
        F.when(
            F.coalesce(place_id, F.lit("")) != "",
            F.struct(F.lit("google_places").alias("fuente"), place_id.alias("place_id")),
        )
        .when(
            F.coalesce(feature_id, F.lit("")).startswith(prefix),
            F.struct(
                F.lit("google_places").alias("fuente"),
                F.substring(feature_id, len(prefix) + 1, 1 << 30).alias("place_id"),
            ),
        )
        .otherwise(
            F.struct(F.lit("osm_overpass").alias("fuente"), F.lit(None).cast("string").alias("place_id"))
        )
    )


def amenity_score(
    zones: DataFrame,
    points: DataFrame,
    weights: DataFrame,
    zone: str = "nombre",
    verify_sources: list[str] | None = None,
    flat: str = "zero",
) -> DataFrame:
    """Weighted count per labelled zone, min-max.

    `points` carry corregimiento_asignado; sources to verify count only where it equals the label.
    """
    verify_sources = ["osm_overpass"] if verify_sources is None else verify_sources
    checked = ~F.col("fuente").isin(verify_sources) | F.coalesce(
        F.col("corregimiento_asignado") == F.col("zona_etiquetada_origen"), F.lit(False)
    )
    counted = points.filter(checked).select(
        F.col("zona_etiquetada_origen").alias(zone), merged_category().alias("categoria")
    )
    weighted = weighted_category_count(zones, counted, weights, zone)
    return min_max_score(cut(weighted), "conteo_ponderado", flat=flat).select(zone, "conteo_ponderado", "score")


def centroids(shapes: DataFrame, name: str = "nombre", geom: str = "geom") -> DataFrame:
    c = multipolygon_centroid(geom)
    return shapes.select(name, c["y"].alias("lat"), c["x"].alias("lng"))


def walkability_distances(anchors: DataFrame, sets: dict[str, DataFrame], name: str = "nombre") -> DataFrame:
    """Distance in metres from each anchor to the nearest point of every set, and their mean.

    The sets are pooled over all zones and searched in one join, the set being an equality key.
    """
    tagged, wanted = None, None
    for label, points in sets.items():
        part = points.select(F.lit(label).alias("conjunto"), "id", "lat", "lng")
        ask = anchors.select(F.lit(label).alias("conjunto"), name, "lat", "lng")
        tagged = part if tagged is None else tagged.unionByName(part)
        wanted = ask if wanted is None else wanted.unionByName(ask)
    found = nearest_on_earth(wanted, tagged, name, "id", by=["conjunto"])
    columns = [
        F.max(F.when(F.col("conjunto") == label, F.col("distancia_m"))).alias(f"distancia_{label}_m")
        for label in sets
    ]
    nearest = cut(found.groupBy(name).agg(*columns))
    return nearest.withColumn(
        "distancia_promedio_m",
        sum((F.col(f"distancia_{label}_m") for label in sets), F.lit(0.0)) / len(sets),
    )


def walkability_score(distances: DataFrame, flat: str = "zero") -> DataFrame:
    return min_max_score(distances, "distancia_promedio_m", invert=True, flat=flat)


def composite(scores: DataFrame, weights: DataFrame, zone: str = "nombre") -> DataFrame:
    """Sum of weight times score over long rows (zone, dimension, score), not renormalised.

    Weights that do not sum to 1 within 1e-9 are an error.
    """
    total = weights.agg(F.sum("peso").alias("t")).scalar()
    guard = F.when(F.abs(total - 1) > 1e-9, F.raise_error(F.lit("weights must sum to 1"))).otherwise(F.lit(True))
    return (
        scores.join(weights.filter(guard), "dimension")
        .groupBy(zone)
        .agg(F.sum(F.col("peso") * F.col("score")).alias("composite"))
    )


def desglose(scores: DataFrame, dimensions: list[str] | None = None, zone: str = "nombre") -> DataFrame:
    """One column per dimension score."""
    return scores.groupBy(zone).agg(*[
        F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in dimensions or K.DIMENSIONS
    ])


def apply_policy(zones: DataFrame, index: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Index of every zone: own, copied from the parent, or none where the policy says so.

    `zones` has nombre, es_oficial, hereda_de, sin_score, oculta; `index` has nombre, composite
    and one column per dimension.
    """
    dimensions = dimensions or K.DIMENSIONS
    values = ["composite", *dimensions]
    held = index.select(F.col("nombre").alias("_fuente"), *values)
    source = F.coalesce("hereda_de", "nombre")
    joined = zones.withColumn("_fuente", F.when(~F.col("sin_score"), source)).join(held, "_fuente", "left")
    state = F.when(F.col("composite").isNull(), "sin_score_datos_insuficientes").otherwise("calculado")
    return joined.select(
        "nombre", "es_oficial", "hereda_de", F.col("composite").alias("zone_health_score"), *dimensions,
        state.alias("estado_zone_health"), F.col("oculta").alias("no_visualizado"),
    )


def status_label(df: DataFrame) -> Column:
    """Shown category: no score, hidden, inherited, computed, in that order."""
    return (
        F.when(F.col("zone_health_score").isNull(), "Sin score")
        .when(F.col("no_visualizado"), "Calculado, no visualizado")
        .when(F.col("hereda_de").isNotNull(), F.concat(F.lit("Heredado de "), F.col("hereda_de")))
        .otherwise("Calculado")
    )


def assign_points(points: DataFrame, shapes: DataFrame, note: str = "etiqueta y geometría difieren") -> DataFrame:
    """Points with the zone that holds them and a note where it differs from their label."""
    assigned = assign_zone(points, shapes)
    conflict = F.col("corregimiento_asignado") != F.col("zona_etiquetada_origen")
    return assigned.withColumn("nota_auditoria", F.when(conflict, F.lit(note)))


def _uniform(*keys: Column) -> Column:
    """A repeatable number strictly between 0 and 1."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _point_in(traps: Column, keys: list[Column]) -> Column:
    """A random point of a shape's trapezoids: one by area, then a height by width, then a place across."""
    total = F.element_at(traps, -1)["upto"]
    picked = F.get(F.filter(traps, lambda t: t["upto"] >= _uniform(*keys, F.lit(0)) * total), F.lit(0))

    def place(t: Column) -> Column:
        w0, w1, u = t["r0"] - t["l0"], t["r1"] - t["l1"], _uniform(*keys, F.lit(1))
        h = u * (w0 + w1) / (w0 + F.sqrt(w0 * w0 + u * (w1 * w1 - w0 * w0)))
        x = t["l0"] + (t["l1"] - t["l0"]) * h + _uniform(*keys, F.lit(2)) * (w0 + (w1 - w0) * h)
        return F.struct(x.alias("lng"), (t["y0"] + h * (t["y1"] - t["y0"])).alias("lat"))

    return F.transform(F.array(picked), place)[0]


def display_points(listings: DataFrame, zones: DataFrame, shapes: DataFrame, seed: int = K.SEED) -> DataFrame:
    """A repeatable random point inside the zone's shape, or its parent's, and whether it is the parent's.

    A shape is cut once into trapezoids between the heights of its corners; points are uniform over
    its area. Listings of zones without a shape, or whose shape has no area, get null.
    """
    prepared = shapes.select(F.col("nombre").alias("_shape"), trapezoids("geom").alias("_traps"))
    sourced = listings.join(
        zones.select(F.col("nombre").alias("corregimiento"), F.coalesce("hereda_de", "nombre").alias("_shape")),
        "corregimiento", "left",
    ).join(prepared, "_shape", "left")
    point = F.when(F.size("_traps") > 0, _point_in(F.col("_traps"), [F.col("listing_id"), F.lit(seed)]))
    return sourced.withColumn("_point", point).select(
        "listing_id", "corregimiento", F.col("_point.lng").alias("lng"), F.col("_point.lat").alias("lat"),
        F.when(F.col("_traps").isNotNull(), F.col("_shape") != F.col("corregimiento")).alias("ubicacion_aproximada"),
    )


def zone_panel(index: DataFrame, points: DataFrame) -> DataFrame:
    """Zone rows with the points labelled with the zone or its parent; zones without points stay."""
    labelled = points.select(
        F.col("zona_etiquetada_origen").alias("_origen"), "id", "categoria",
        F.col("nombre").alias("poi_nombre"), "lat", "lng", "rating",
    )
    sourced = index.withColumn("_origen", F.coalesce("hereda_de", "nombre"))
    # Points of a busy zone can be split over tasks in an inner join; empty zones are added apart.
    filled = sourced.join(labelled, "_origen")
    empty = sourced.join(labelled.select("_origen").distinct(), "_origen", "left_anti")
    return (
        filled.unionByName(empty, allowMissingColumns=True)
        .drop("_origen")
        .withColumn("heredado", F.col("hereda_de").isNotNull())
        .withColumn("cobertura_composite_insuficiente", F.col("zone_health_score").isNull())
    )


def drop_dimension(weights: DataFrame, dropped: str) -> DataFrame:
    """Weights without one dimension, its weight spread in proportion."""
    kept = weights.filter(F.col("dimension") != dropped)
    return with_stats(kept, [], _t=F.sum("peso")).select("dimension", (F.col("peso") / F.col("_t")).alias("peso"))


def usable_polygons(features: DataFrame, boundary_only: bool = False, spelling: dict[str, str] | None = None) -> DataFrame:
    """Features (tipo, geometry type, coordinates JSON, name) that carry an area, as multipolygons."""
    kept = features.filter(F.col("tipo_geometria").isin("Polygon", "MultiPolygon"))
    if boundary_only:
        kept = kept.filter(F.col("tipo") == "boundary")
    spelling = {"Bethania": "Betania"} if spelling is None else spelling
    return kept.select("orden", "nombre", parse_area("tipo_geometria", "coordenadas").alias("geom")).replace(
        spelling, subset=["nombre"]
    )


def parse_area(kind: str, coordinates: str) -> Column:
    """GeoJSON Polygon or MultiPolygon coordinates (JSON text) as a multipolygon."""
    def points(ring):
        return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    def rings(part):
        return F.transform(part, points)

    single = F.array(rings(F.from_json(coordinates, "array<array<array<double>>>")))
    many = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), rings)
    return F.when(F.col(kind) == "Polygon", single).when(F.col(kind) == "MultiPolygon", many).cast(MULTIPOLYGON)


def geometry_audit(points: DataFrame) -> DataFrame:
    """Per source: rows in their own zone, in another, outside all, and exact copies."""
    copies = points.groupBy("nombre", "lat", "lng").agg(F.count("*").alias("_c"))
    per_source = points.groupBy("fuente", "nombre", "lat", "lng").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("corregimiento_asignado") == F.col("zona_etiquetada_origen")).alias("_own"),
        F.count_if(F.col("corregimiento_asignado").isNull()).alias("_out"),
    )
    return (
        per_source.join(copies, ["nombre", "lat", "lng"]).groupBy("fuente")
        .agg(
            F.sum("_n").alias("filas"), F.sum("_own").alias("en_su_zona"),
            F.sum(F.col("_n") - F.col("_own") - F.col("_out")).alias("en_otra_zona"),
            F.sum("_out").alias("fuera"),
            F.sum(F.when(F.col("_c") > 1, F.col("_n")).otherwise(0)).alias("duplicadas"),
        )
    )
