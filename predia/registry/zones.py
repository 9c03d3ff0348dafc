"""Zone health."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia import constants as K
from predia.operators.spatial import assign_zone
from predia.plans import views as V, zone_health as Z
from predia.registry import entry
from predia.registry.aggregation import WEIGHT, weights
from predia.registry.joining import HAV_A, HAVERSINE
from predia.registry.scalars import RINGS
from predia.registry.sql import sql
from predia.session import cut

RATES = "rate AS (SELECT nombre, es_oficial, incidentes / nullif(poblacion, 0)::DOUBLE * 100000 AS tasa FROM customer_stats)"


def extended(heads: list[str], body: str) -> str:
    """A body with extra views that themselves use the derived views."""
    marker = "/*extra*/"
    text = sql(f"{marker}{', '.join(heads)}\n{body}")
    return text.replace(f"\n{marker}", ",\n")


def minmax(x: str, invert: bool = False) -> str:
    score = f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())"
    return f"1 - {score}" if invert else score


SAFETY = f"seguridad AS (SELECT nombre, {minmax('tasa', True)} AS score FROM rate WHERE es_oficial)"
STOP_COUNT = """density AS (SELECT z.nombre, z.superficie_km2, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / z.superficie_km2 AS x FROM zone z LEFT JOIN (
  SELECT corregimiento_asignado AS a, count(*) AS n FROM stop_zone GROUP BY 1) c ON c.a = z.nombre WHERE z.zona_id < 5)"""
TRANSPORT = f"transporte AS (SELECT nombre, n, {minmax('x')} AS score FROM density)"
AMENITY_COUNT = f"""amenity AS (SELECT z.nombre, coalesce(c.w, 0) AS w FROM zone z LEFT JOIN (
  SELECT zona_etiquetada_origen AS a, sum(({WEIGHT})::DOUBLE) AS w FROM poi_zone
  WHERE fuente <> 'osm_overpass' OR corregimiento_asignado = zona_etiquetada_origen GROUP BY 1) c ON c.a = z.nombre WHERE z.zona_id < 5)"""
AMENITY = f"amenidades AS (SELECT nombre, w, {minmax('w')} AS score FROM amenity)"
CENTROID = RINGS.lstrip(", ") + """,
centroid AS (SELECT n_nationkey, n_name AS nombre, sum(w * (ox + mx / a)) / sum(w) - n_nationkey AS lng, sum(w * (oy + my / a)) / sum(w) + n_nationkey AS lat FROM (
  SELECT *, CASE WHEN ring_no = 0 THEN abs(a) ELSE -abs(a) END AS w FROM g) JOIN nation USING (n_nationkey) WHERE n_nationkey < 5 GROUP BY 1, 2)"""
WALK = f"""caminata AS (SELECT nombre, ds, dp, dm, (ds + dp + dm) / 3 AS x FROM (
  SELECT a.nombre, min({HAVERSINE.format(HAV_A)}) FILTER (WHERE b.k = 'supermercado') AS ds, min({HAVERSINE.format(HAV_A)}) FILTER (WHERE b.k = 'parque') AS dp,
    min({HAVERSINE.format(HAV_A)}) FILTER (WHERE b.k = 'metro') AS dm
  FROM centroid a, (SELECT categoria AS k, lat, lng FROM poi UNION ALL SELECT tipo, lat, lng FROM stop) b GROUP BY 1))"""
WALKABILITY = f"walkability AS (SELECT nombre, x, {minmax('x', True)} AS score FROM caminata)"
INDEX_HEADS = [RATES, f"seguridad AS (SELECT nombre, {minmax('tasa', True)} AS score FROM rate WHERE nombre IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4'))",
               STOP_COUNT, TRANSPORT, AMENITY_COUNT, AMENITY, CENTROID, WALK, WALKABILITY,
               """puntaje AS (SELECT nombre, 'seguridad' AS dimension, score FROM seguridad UNION ALL SELECT nombre, 'transporte', score FROM transporte
  UNION ALL SELECT nombre, 'amenidades', score FROM amenidades UNION ALL SELECT nombre, 'walkability', score FROM walkability)""",
               """indice AS (SELECT nombre, sum(score * CASE dimension WHEN 'seguridad' THEN 0.352941176::DOUBLE WHEN 'walkability' THEN 0.176470588::DOUBLE ELSE 0.235294118::DOUBLE END) AS composite,
  max(score) FILTER (WHERE dimension = 'transporte') AS transporte FROM puntaje GROUP BY 1)""",
               """salud AS (SELECT z.nombre, z.hereda_de, z.oculta, i.composite, i.transporte FROM zone z
  LEFT JOIN indice i ON i.nombre = CASE WHEN NOT z.sin_score THEN coalesce(z.hereda_de, z.nombre) END)"""]


def shaped(spark, d):
    return V.zone(spark, d).filter("zona_id < 5")


@entry("z1_safety_score", extended([RATES, SAFETY], "SELECT nombre, round(score, 9) AS score FROM seguridad"))
def _(spark, d):
    rates = Z.crime_rate(V.customer_stats(spark, d))
    return Z.safety_score(rates, V.zone(spark, d).filter("es_oficial")).select("nombre", F.round("score", 9).alias("score"))


@entry("z2_transport_score", extended([STOP_COUNT, TRANSPORT], "SELECT nombre, n, round(score, 9) AS score FROM transporte"))
def _(spark, d):
    stops = assign_zone(V.stop(spark, d), V.polygon(spark, d)).select(F.col("corregimiento_asignado").alias("nombre"))
    return Z.transport_score(shaped(spark, d), [stops]).select("nombre", "n", F.round("score", 9).alias("score"))


@entry("z3_amenity_score", extended([AMENITY_COUNT, AMENITY], "SELECT nombre, round(w, 6) AS conteo_ponderado, round(score, 9) AS score FROM amenidades"))
def _(spark, d):
    points = assign_zone(V.poi(spark, d), V.polygon(spark, d))
    got = Z.amenity_score(shaped(spark, d), points, weights(spark, K.AMENITY_WEIGHTS, "categoria"))
    return got.select("nombre", F.round("conteo_ponderado", 6).alias("conteo_ponderado"), F.round("score", 9).alias("score"))


def walk_distances(spark, d):
    poi, stop = V.poi(spark, d), V.stop(spark, d)
    return Z.walkability_distances(Z.centroids(V.polygon(spark, d)), {
        "supermercado": poi.filter("categoria = 'supermercado'"), "parque": poi.filter("categoria = 'parque'"),
        "metro": stop.filter("tipo = 'metro'"),
    })


@entry("z4_walkability_score", extended([CENTROID, WALK, WALKABILITY], """
SELECT nombre, round(x, 3) AS distancia_promedio_m, round(score, 6) AS score FROM walkability"""))
def _(spark, d):
    got = Z.walkability_score(walk_distances(spark, d))
    return got.select("nombre", F.round("distancia_promedio_m", 3).alias("distancia_promedio_m"), F.round("score", 6).alias("score"))


def dimension_scores(spark, d):
    zones, shapes = shaped(spark, d), V.polygon(spark, d)
    stops = assign_zone(V.stop(spark, d), shapes).select(F.col("corregimiento_asignado").alias("nombre"))
    points = assign_zone(V.poi(spark, d), shapes)
    parts = {
        "seguridad": Z.safety_score(Z.crime_rate(V.customer_stats(spark, d)), zones),
        "transporte": Z.transport_score(zones, [stops]),
        "amenidades": Z.amenity_score(zones, points, weights(spark, K.AMENITY_WEIGHTS, "categoria")),
        "walkability": Z.walkability_score(walk_distances(spark, d)),
    }
    merged = None
    for name, part in parts.items():
        rows = part.select("nombre", F.lit(name).alias("dimension"), "score")
        merged = rows if merged is None else merged.unionByName(rows)
    return cut(merged)


def index_table(spark, d):
    scores = dimension_scores(spark, d)
    index = Z.composite(scores, weights(spark, K.INDEX_WEIGHTS, "dimension")).join(Z.desglose(scores), "nombre")
    return Z.apply_policy(V.zone(spark, d), index)


@entry("z5_composite", extended(INDEX_HEADS, "SELECT nombre, round(composite, 6) AS composite FROM indice"))
def _(spark, d):
    got = Z.composite(dimension_scores(spark, d), weights(spark, K.INDEX_WEIGHTS, "dimension"))
    return got.select("nombre", F.round("composite", 6).alias("composite"))


@entry("z6_inherited_scores", extended(INDEX_HEADS, """
SELECT nombre, round(coalesce(composite, -1), 6) AS zone_health_score, round(coalesce(transporte, -1), 6) AS transporte,
  CASE WHEN composite IS NULL THEN 'sin_score_datos_insuficientes' ELSE 'calculado' END AS estado_zone_health FROM salud"""))
def _(spark, d):
    return index_table(spark, d).select(
        "nombre", F.round(F.coalesce("zone_health_score", F.lit(-1.0)), 6).alias("zone_health_score"),
        F.round(F.coalesce("transporte", F.lit(-1.0)), 6).alias("transporte"), "estado_zone_health",
    )


@entry("z7_status_label", extended(INDEX_HEADS, """
SELECT nombre, CASE WHEN composite IS NULL THEN 'Sin score' WHEN oculta THEN 'Calculado, no visualizado'
  WHEN hereda_de IS NOT NULL THEN 'Heredado de ' || hereda_de ELSE 'Calculado' END AS categoria FROM salud"""))
def _(spark, d):
    df = index_table(spark, d)
    return df.select("nombre", Z.status_label(df).alias("categoria"))


@entry("z8_poi_zone_conflicts", sql("""
SELECT id, coalesce(corregimiento_asignado, '-') AS zona, zona_etiquetada_origen AS etiqueta,
  coalesce(corregimiento_asignado <> zona_etiquetada_origen, false) AS conflicto FROM poi_zone"""))
def _(spark, d):
    got = Z.assign_points(V.poi(spark, d), V.polygon(spark, d))
    return got.select("id", F.coalesce("corregimiento_asignado", F.lit("-")).alias("zona"),
                      F.col("zona_etiquetada_origen").alias("etiqueta"), F.col("nota_auditoria").isNotNull().alias("conflicto"))


@entry("z9_display_points", sql("""
SELECT listing_id, l.corregimiento, coalesce(e.nombre <> l.corregimiento, false) AS ubicacion_aproximada, e.nombre IS NOT NULL AS dentro
FROM listing l LEFT JOIN zone z ON z.nombre = l.corregimiento LEFT JOIN (SELECT DISTINCT nombre FROM edge) e ON e.nombre = coalesce(z.hereda_de, z.nombre)"""))
def _(spark, d):
    """Points are random, so the shape that should hold each is asked whether it does."""
    from predia.functions.geo import edges_contain, shape_edges

    zones, shapes = V.zone(spark, d), V.polygon(spark, d)
    got = Z.display_points(V.listing(spark, d), zones, shapes)
    held = zones.select(F.col("nombre").alias("corregimiento"), F.coalesce("hereda_de", "nombre").alias("forma")).join(
        shapes.select(F.col("nombre").alias("forma"), shape_edges("geom").alias("bordes")), "forma")
    inside = F.coalesce(edges_contain(F.col("bordes"), F.col("lng"), F.col("lat")), F.lit(False))
    return got.join(held, "corregimiento", "left").select(
        "listing_id", "corregimiento", F.coalesce("ubicacion_aproximada", F.lit(False)).alias("ubicacion_aproximada"), inside.alias("dentro"))


@entry("z10_zone_panel", extended(INDEX_HEADS, """
SELECT s.nombre, round(coalesce(s.composite, -1), 6) AS zone_health_score, s.hereda_de IS NOT NULL AS heredado, s.composite IS NULL AS cobertura_composite_insuficiente,
  coalesce(p.id, -1) AS id, coalesce(p.categoria, '-') AS categoria FROM salud s LEFT JOIN poi p ON p.zona_etiquetada_origen = coalesce(s.hereda_de, s.nombre)"""))
def _(spark, d):
    got = Z.zone_panel(index_table(spark, d), V.poi(spark, d))
    return got.select(
        "nombre", F.round(F.coalesce("zone_health_score", F.lit(-1.0)), 6).alias("zone_health_score"), "heredado",
        "cobertura_composite_insuficiente", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("categoria", F.lit("-")).alias("categoria"),
    )


@entry("z11_crime_rate", extended([RATES], "SELECT nombre, round(tasa, 6) AS tasa_por_100k FROM rate"))
def _(spark, d):
    return Z.crime_rate(V.customer_stats(spark, d)).select("nombre", F.round("tasa_por_100k", 6).alias("tasa_por_100k"))


@entry("z12_drop_dimension", """
SELECT c_mktsegment AS dimension, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 9) AS peso FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""")
def _(spark, d):
    balance = V.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("dimension")).agg(F.sum("c_acctbal").alias("peso"))
    return Z.drop_dimension(balance, "BUILDING").withColumn("peso", F.round("peso", 9))


def features(spark, d):
    """Customers as boundary, line or point features with GeoJSON coordinate texts."""
    k = F.col("c_custkey")
    x, y = k.cast("string"), (k + 1).cast("string")
    square = F.concat(F.lit("[["), F.concat_ws(
        ",", *[F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")) for a, b in ((x, x), (y, x), (y, y), (x, y), (x, x))]
    ), F.lit("]]"))
    return V.table(spark, d, "customer").select(
        k.alias("orden"), F.when(k % 11 == 0, "Bethania").otherwise(F.col("c_name")).alias("nombre"),
        F.when(k % 2 == 0, "boundary").otherwise("node").alias("tipo"),
        F.when(k % 3 == 0, "Polygon").when(k % 3 == 1, "MultiPolygon").otherwise("LineString").alias("tipo_geometria"),
        F.when(k % 3 == 1, F.concat(F.lit("["), square, F.lit("]"))).otherwise(square).alias("coordenadas"),
    )


@entry("z13_usable_polygons", """
SELECT c_custkey AS orden, CASE WHEN c_custkey % 11 = 0 THEN 'Betania' ELSE c_name END AS nombre, c_custkey + 0.5::DOUBLE AS x, 1.0::DOUBLE AS area
FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 2""")
def _(spark, d):
    from predia.functions.geo import multipolygon_centroid, polygon_area

    got = Z.usable_polygons(features(spark, d), boundary_only=True)
    return got.select("orden", "nombre", F.round(multipolygon_centroid("geom")["x"], 6).alias("x"), F.round(polygon_area(F.col("geom")[0]), 6).alias("area"))


@entry("z14_geometry_audit", sql("""
SELECT fuente, count(*) AS filas, count(*) FILTER (WHERE corregimiento_asignado = zona_etiquetada_origen) AS en_su_zona,
  count(*) FILTER (WHERE corregimiento_asignado <> zona_etiquetada_origen) AS en_otra_zona, count(*) FILTER (WHERE corregimiento_asignado IS NULL) AS fuera,
  count(*) FILTER (WHERE c > 1) AS duplicadas FROM (SELECT *, count(*) OVER (PARTITION BY nombre, lat, lng) AS c FROM poi_zone) GROUP BY 1"""))
def _(spark, d):
    return Z.geometry_audit(assign_zone(V.poi(spark, d), V.polygon(spark, d)))
