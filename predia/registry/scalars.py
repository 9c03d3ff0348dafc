"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions import geo as G, text as T, vectors as N
from predia.functions.pricing import cluster_label
from predia.plans import views as V, zone_health as Z
from predia.registry import entry
from predia.registry.joining import HAV_A, HAVERSINE
from predia.registry.sql import sql


@entry("f1_haversine", sql(f"SELECT b.id, round({HAVERSINE.format(HAV_A)}, 3) AS metros FROM poi b, (SELECT 9.0::DOUBLE AS lat, -79.5::DOUBLE AS lng) a"))
def _(spark, d):
    return V.poi(spark, d).select("id", F.round(G.haversine_m(F.lit(9.0), F.lit(-79.5), "lat", "lng"), 3).alias("metros"))


@entry("f2_cosine", """
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS coseno FROM embeddings""")
def _(spark, d):
    cos = N.cosine_similarity("embedding", F.reverse("embedding"))
    return V.table(spark, d, "embeddings").select("vec_id", F.round(cos, 9).alias("coseno"))


def shapes_per_nation(spark, d):
    """Every nation with one of the five shapes, moved by its key."""
    from predia.functions.geo import MULTIPOLYGON

    polygons = V.polygon(spark, d).select(F.col("orden").alias("base"), "geom")
    nation = V.table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).cast("bigint").alias("base"))
    k = F.col("n_nationkey")
    moved = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: F.struct((v["x"] + k).alias("x"), (v["y"] - k).alias("y")))))
    return nation.join(polygons, "base").select("n_nationkey", moved.cast(MULTIPOLYGON).alias("geom"))


RINGS = """, e AS (SELECT n_nationkey, part_no, ring_no, x1 + n_nationkey AS x1, x2 + n_nationkey AS x2, y1 - n_nationkey AS y1, y2 - n_nationkey AS y2
  FROM nation JOIN edge ON orden = n_nationkey % 5),
o AS (SELECT n_nationkey, part_no, ring_no, min(x1) AS ox, min(y1) AS oy FROM e GROUP BY 1, 2, 3),
g AS (SELECT n_nationkey, part_no, ring_no, any_value(ox) AS ox, any_value(oy) AS oy, sum(c) / 2 AS a, sum((x1 + x2 - 2 * ox) * c) / 6 AS mx, sum((y1 + y2 - 2 * oy) * c) / 6 AS my
  FROM (SELECT *, (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) AS c FROM e JOIN o USING (n_nationkey, part_no, ring_no)) GROUP BY 1, 2, 3)"""


def ring_sql(body: str) -> str:
    return sql(RINGS + "\n" + body).replace("\n, e AS", ",\ne AS")


@entry("f3_centroid", ring_sql("""
SELECT n_nationkey, round(sum(w * (ox + mx / a)) / sum(w), 7) AS x, round(sum(w * (oy + my / a)) / sum(w), 7) AS y FROM (
  SELECT *, CASE WHEN ring_no = 0 THEN abs(a) ELSE -abs(a) END AS w FROM g) GROUP BY 1"""))
def _(spark, d):
    c = G.multipolygon_centroid("geom")
    return shapes_per_nation(spark, d).select("n_nationkey", F.round(c["x"], 7).alias("x"), F.round(c["y"], 7).alias("y"))


@entry("f4_largest_part", ring_sql("""
SELECT n_nationkey, round(max(w) / sum(w) * 100, 4) AS pct_area, (count(*) - 1)::INT AS partes_descartadas FROM (
  SELECT n_nationkey, part_no, sum(CASE WHEN ring_no = 0 THEN abs(a) ELSE -abs(a) END) AS w FROM g GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, d):
    part = G.largest_part("geom")
    return shapes_per_nation(spark, d).select(
        "n_nationkey", F.round(part["pct_area"], 4).alias("pct_area"), part["partes_descartadas"].alias("partes_descartadas")
    )


@entry("f5_bounds", ring_sql("SELECT n_nationkey, round(min(x1), 6) AS min_x, round(min(y1), 6) AS min_y, round(max(x1), 6) AS max_x, round(max(y1), 6) AS max_y FROM e GROUP BY 1"))
def _(spark, d):
    b = G.bounds("geom")
    return shapes_per_nation(spark, d).select("n_nationkey", *[F.round(b[c], 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def tags(k):
    return F.create_map(
        F.lit("shop"), F.when(k % 3 == 0, "supermarket").when(k % 3 == 1, "bakery"),
        F.lit("leisure"), F.when(k % 4 == 0, "park"),
        F.lit("amenity"), F.when(k % 5 == 0, "pharmacy").when(k % 5 == 1, "clinic").when(k % 5 == 2, "school").when(k % 5 == 3, "hospital"),
    )


@entry("f6_tag_category", """
SELECT p_partkey, coalesce(c, '-') AS cruda, coalesce(CASE WHEN c IN ('clinica', 'hospital') THEN 'salud' ELSE c END, '-') AS fusionada FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'supermercado' WHEN p_partkey % 4 = 0 THEN 'parque'
    ELSE CASE p_partkey % 5 WHEN 0 THEN 'farmacia' WHEN 1 THEN 'clinica' WHEN 2 THEN 'colegio' WHEN 3 THEN 'hospital' END END AS c FROM part)""")
def _(spark, d):
    t = tags(F.col("p_partkey"))
    return V.table(spark, d, "part").select(
        "p_partkey", F.coalesce(Z.tag_category(t), F.lit("-")).alias("cruda"),
        F.coalesce(Z.tag_category(t, merged=True), F.lit("-")).alias("fusionada"),
    )


@entry("f7_provenance", """
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'google_places' ELSE 'osm_overpass' END AS fuente,
  CASE p_partkey % 3 WHEN 0 THEN 'pl_' || p_partkey WHEN 1 THEN 'x' || p_partkey ELSE '-' END AS place_id FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    key = k.cast("string")
    found = Z.provenance(
        F.when(k % 3 == 0, F.concat(F.lit("pl_"), key)).when(k % 2 == 0, ""),
        F.when(k % 3 == 1, F.concat(F.lit("google_places/x"), key)).otherwise(F.concat(F.lit("node/"), key)),
    )
    return V.table(spark, d, "part").select("p_partkey", found.alias("s")).select(
        "p_partkey", "s.fuente", F.coalesce("s.place_id", F.lit("-")).alias("place_id")
    )


@entry("f8_redact_contacts", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\+?\s?507[\s.-]?)?6\d{3}[\s.-]?\d{4}\b', '[contacto de terceros removido]', 'g'),
  '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[contacto de terceros removido]', 'g')) AS limpio FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.redact_contacts("text")).alias("limpio"))


@entry("f9_repair_c1", """
SELECT doc_id, md5(replace(replace(text, '. ', '— '), ', ', ''' ')) AS limpio FROM documents""")
def _(spark, d):
    # Documents hold no control characters, so two are put in first.
    broken = F.replace(F.replace("text", F.lit(". "), F.lit("\u0097 ")), F.lit(", "), F.lit("\u0092 "))
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.repair_c1(broken)).alias("limpio"))


@entry("f10_embedding_text", sql("""
SELECT listing_id, md5(CASE WHEN descripcion_fuente = 'ninguna' THEN title ELSE descripcion END) AS texto FROM listing_text"""))
def _(spark, d):
    chosen = T.embedding_text("descripcion_fuente", "descripcion", "title")
    return V.listing_text(spark, d).select("listing_id", F.md5(chosen).alias("texto"))


def reply(k, a, b):
    """A model reply as text: bare, fenced, cut off, or out of range, by key."""
    body = F.format_string(
        '{"completitud_informativa": %d, "calidad_presentacion": %d, "diferenciadores_amenidades": 3, "transparencia_precio": 4}', a, b
    )
    return (
        F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 4 == 1, F.concat(F.lit("Resultado: "), body, F.lit(" listo")))
        .when(k % 4 == 2, F.substring(body, 1, 40))
        .otherwise(body)
    )


@entry("f11_structured_output", """
SELECT event_id, CASE WHEN event_id % 4 <> 2 AND event_id % 7 BETWEEN 1 AND 5 AND user_id % 6 BETWEEN 1 AND 5 THEN (event_id % 7)::INT ELSE -1 END AS completitud,
  CASE WHEN event_id % 4 <> 2 AND event_id % 7 BETWEEN 1 AND 5 AND user_id % 6 BETWEEN 1 AND 5 THEN (user_id % 6)::INT ELSE -1 END AS presentacion FROM events""")
def _(spark, d):
    k = F.col("event_id")
    parsed = T.quality_json(reply(k, k % 7, F.col("user_id") % 6))
    return V.table(spark, d, "events").select("event_id", parsed.alias("q")).select(
        "event_id", F.coalesce("q.completitud_informativa", F.lit(-1)).alias("completitud"),
        F.coalesce("q.calidad_presentacion", F.lit(-1)).alias("presentacion"),
    )


@entry("f14_cluster_label", """
SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'Sin segmentación disponible' WHEN label = 0 THEN 'Compacto / económico'
  WHEN label = 1 THEN 'Grande / premium' ELSE 'Segmento desconocido (cluster_id=' || label || ')' END AS etiqueta FROM embeddings""")
def _(spark, d):
    cluster = F.when(F.col("vec_id") % 5 != 0, F.col("label"))
    return V.table(spark, d, "embeddings").select("vec_id", cluster_label(cluster).alias("etiqueta"))


@entry("f15_json_access", "SELECT event_id, (props->>'k')::DOUBLE AS k FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@entry("f17_zone_in_text", """
SELECT doc_id, contains(lower(text), 'onen') OR contains(lower(text), 'schen') OR contains(lower(text), 'eauen') AS menciona FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.mentions_any_zone("text", ["Onen", "SCHEN", "eauen"]).alias("menciona"))
