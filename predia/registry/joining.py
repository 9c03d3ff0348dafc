"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions.vectors import cosine_similarity
from predia.operators import sets as S, vector_index
from predia.operators.filters import evaluable
from predia.operators.nearest import nearest_on_earth
from predia.operators.overlap import overlap
from predia.operators.vector_search import vector_topk, vector_topk_hashed
from predia.plans import matching as M, views as V
from predia.registry import entry
from predia.registry.filtering import PROFILE_MATCH
from predia.registry.sql import sql
from predia.registry.valuation import comparable_table
from predia.session import cut


@entry("j1_listing_detail", sql("""
SELECT l.listing_id, l.corregimiento, coalesce(s.precio_predicho, -1) AS precio_predicho, coalesce(k.cluster_id, -1) AS cluster_id, coalesce(q.quality, -1) AS quality
FROM listing l LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS precio_predicho FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_orderkey = l.listing_id
LEFT JOIN (SELECT vec_id, label AS cluster_id FROM embeddings) k ON k.vec_id = l.listing_id
LEFT JOIN labels q ON q.doc_id = l.listing_id"""))
def _(spark, d):
    base = V.listing(spark, d).select("listing_id", "corregimiento")
    light = (
        V.table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("listing_id"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("precio_predicho"))
    )
    segment = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("listing_id"), F.col("label").alias("cluster_id"))
    quality = V.table(spark, d, "labels").select(F.col("doc_id").alias("listing_id"), "quality")
    joined = base
    for part in (light, segment, quality):
        joined = joined.join(part, "listing_id", "left")
    return joined.fillna({"precio_predicho": -1.0, "cluster_id": -1, "quality": -1})


@entry("j2_json_score_join", sql("""
SELECT l.listing_id, round(coalesce((z.j->>'transporte')::DOUBLE, -1), 6) AS transporte_score FROM listing l LEFT JOIN (
  SELECT n_name, '{"transporte": ' || (n_nationkey / 24::DOUBLE)::DECIMAL(10, 6) || '}' AS j FROM nation WHERE n_nationkey < 20) z ON z.n_name = l.corregimiento"""))
def _(spark, d):
    zones = V.table(spark, d, "nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("corregimiento"),
        F.to_json(F.struct((F.col("n_nationkey") / 24).cast("decimal(10,6)").alias("transporte"))).alias("desglose"),
    )
    score = F.get_json_object("desglose", "$.transporte").try_cast("double")
    return V.listing(spark, d).join(zones, "corregimiento", "left").select(
        "listing_id", F.round(F.coalesce(score, F.lit(-1.0)), 6).alias("transporte_score")
    )


def shaped_zones(spark, d):
    return V.table(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_name").alias("poligono"))


def _sourced(spark, d):
    zones = V.zone(spark, d).select(
        F.col("nombre").alias("corregimiento"), F.coalesce("hereda_de", "nombre").alias("poligono")
    )
    return V.listing(spark, d).select("listing_id", "corregimiento").join(zones, "corregimiento").join(shaped_zones(spark, d), "poligono")


@entry("j3_parent_polygon", sql("""
SELECT l.listing_id, l.corregimiento, p.n_name AS poligono, p.n_name <> l.corregimiento AS heredado FROM listing l
JOIN zone z ON z.nombre = l.corregimiento JOIN nation p ON p.n_name = coalesce(z.hereda_de, z.nombre) AND p.n_nationkey < 5"""))
def _(spark, d):
    return _sourced(spark, d).select("listing_id", "corregimiento", "poligono", (F.col("poligono") != F.col("corregimiento")).alias("heredado"))


@entry("j4_zones_without_polygon", sql("""
SELECT corregimiento, count(*) AS n FROM listing WHERE corregimiento NOT IN (
  SELECT z.nombre FROM zone z JOIN nation p ON p.n_name = coalesce(z.hereda_de, z.nombre) AND p.n_nationkey < 5) GROUP BY 1"""))
def _(spark, d):
    with_shape = V.zone(spark, d).withColumn("poligono", F.coalesce("hereda_de", "nombre")).join(
        shaped_zones(spark, d), "poligono", "left_semi"
    )
    rows = S.anti(V.listing(spark, d), with_shape.select(F.col("nombre").alias("corregimiento")), "corregimiento")
    return rows.groupBy("corregimiento").agg(F.count("*").alias("n"))


@entry("j5_missing_embeddings", sql("SELECT listing_id FROM listing WHERE listing_id NOT IN (SELECT vec_id FROM embeddings)"))
def _(spark, d):
    keys = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("listing_id"))
    return S.anti(V.listing(spark, d), keys, "listing_id").select("listing_id")


@entry("j6_rows_with_label", sql("SELECT listing_id, price_usd FROM listing WHERE listing_id IN (SELECT doc_id FROM labels)"))
def _(spark, d):
    keys = V.table(spark, d, "labels").select(F.col("doc_id").alias("listing_id"))
    return S.semi(V.listing(spark, d), keys, "listing_id").select("listing_id", "price_usd")


@entry("j7_point_in_polygon", sql("SELECT id, coalesce(corregimiento_asignado, '-') AS zona FROM stop_zone"))
def _(spark, d):
    from predia.operators.spatial import assign_zone

    return assign_zone(V.stop(spark, d), V.polygon(spark, d)).select(
        "id", F.coalesce("corregimiento_asignado", F.lit("-")).alias("zona")
    )


HAVERSINE = """2 * 6371000.0::DOUBLE * atan2(sqrt({0}), sqrt(1 - {0}))"""
HAV_A = """(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))"""


@entry("j8_nearest_point", sql(f"""
SELECT a.id, round(min({HAVERSINE.format(HAV_A)}), 3) AS distancia_m FROM stop a, poi b GROUP BY a.id"""))
def _(spark, d):
    found = nearest_on_earth(V.stop(spark, d).withColumnRenamed("id", "parada"), V.poi(spark, d), "parada", "id")
    return found.select(F.col("parada").alias("id"), F.round("distancia_m", 3).alias("distancia_m"))


@entry("j9_knn_join", sql("""
SELECT listing_id, rank, vecino_id, vecino_precio, round(distancia, 6) AS distancia FROM comparable"""))
def _(spark, d):
    return comparable_table(spark, d).select(
        "listing_id", F.col("rank").cast("bigint").alias("rank"), "vecino_id", "vecino_precio", F.round("distancia", 6).alias("distancia")
    )


def probes(spark, d):
    """One query vector per label: the mean of its embeddings."""
    flat = V.table(spark, d, "embeddings").select("label", F.posexplode("embedding"))
    means = flat.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("v"))
    # One vector is 64 entries long, so the list per label is bounded by the vector size.
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vector")
    ).select(F.col("label").cast("bigint").alias("query_id"), "vector")


PROBES = """probe AS (SELECT label::BIGINT AS query_id, list(v ORDER BY i) AS vector FROM (
  SELECT label, i, avg(x::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


def probe_sql(body: str) -> str:
    text = sql(body)
    return text.replace("WITH ", f"WITH {PROBES},\n", 1) if text.startswith("WITH") else f"WITH {PROBES}\n{text}"


@entry("j10_vector_topk", probe_sql("""
SELECT query_id, rank, listing_id, distancia FROM (SELECT query_id, listing_id, distancia, row_number() OVER (PARTITION BY query_id ORDER BY distancia, listing_id) AS rank
  FROM (SELECT query_id, listing_id, round(1 - list_cosine_similarity(vector, embedding::DOUBLE[]), 9) AS distancia FROM probe, listing_vector
    WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable AND price_usd <= 300000)) WHERE rank <= 10"""))
def _(spark, d):
    candidates = evaluable(V.listing_vector(spark, d)).filter("price_usd <= 300000")
    return vector_topk(probes(spark, d), candidates, 10)


BATCH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distancia, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 9) AS distancia FROM q, v))"""


def indexed(spark, d):
    """The index of all embeddings, and the batch of queries: every row whose id is divisible by 50."""
    vectors = V.table(spark, d, "embeddings")
    batch = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.build_index(vectors, "vec_id", lists=16), batch


@entry("j10_vector_index", BATCH + "SELECT query_id, rank, vec_id, distancia FROM h WHERE rank <= 10")
def _(spark, d):
    index, batch = indexed(spark, d)
    return vector_index.search(index, batch, 10, vector_id="vec_id")


@entry("j10_vector_index_recall", BATCH + """
SELECT count(*) AS n, count(DISTINCT query_id) AS consultas, true AS recall_suficiente FROM h WHERE rank <= 10""")
def _(spark, d):
    """The fast mode, set to 0.95 on a sample of the indexed vectors, against the exact one."""
    index, batch = indexed(spark, d)
    exact = cut(vector_index.search(index, batch, 10, vector_id="vec_id"))
    fast = vector_index.search(index, batch, 10, vector_index.lists_for(index, 10, 0.95), vector_id="vec_id")
    asked = batch.agg(F.count("*").alias("n")).scalar()
    return vector_index.recall(fast, exact, "query_id", "vec_id").select("n", asked.alias("consultas"), (F.col("recall") >= 0.9).alias("recall_suficiente"))


@entry("j10_vector_topk_hashed", """
SELECT min(vec_id) AS consulta, 0.0::DOUBLE AS propia, true AS distancias_exactas, true AS hallazgos FROM embeddings""")
def _(spark, d):
    """One probe by hashing: it finds itself first, at most ten in all, and every distance it reports is the true one."""
    vectors = V.table(spark, d, "embeddings")
    probe = vectors.agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("p")).first()["p"]
    found = cut(vector_topk_hashed(vectors, list(probe["embedding"]), 10, vector_id="vec_id"))
    true = F.round(1 - cosine_similarity(F.col("embedding"), F.array(*[F.lit(float(x)) for x in probe["embedding"]])), 6)
    checked = found.join(vectors, "vec_id").withColumn("ok", F.abs(true - F.col("distancia")) <= 2e-6)
    own = F.max(F.when(F.col("vec_id") == probe["vec_id"], F.abs(F.round("distancia", 6))))
    return checked.agg(F.lit(probe["vec_id"]).alias("consulta"), own.alias("propia"), F.bool_and("ok").alias("distancias_exactas"),
                       F.count("*").between(1, 10).alias("hallazgos"))


@entry("j11_profile_listing_join", sql("SELECT p.perfil, count(*) AS n, round(avg(l.price_usd), 4) AS precio_medio "
    + PROFILE_MATCH.replace("listing_text", "listing") + " GROUP BY 1"))
def _(spark, d):
    return M.rule_matches(V.listing(spark, d), M.profile_table(spark, V.PROFILES)).groupBy("perfil").agg(
        F.count("*").alias("n"), F.round(F.avg("price_usd"), 4).alias("precio_medio")
    )


@entry("j12_profile_overlap", sql("""
, m AS (SELECT p.perfil, l.listing_id """ + PROFILE_MATCH.replace("listing_text", "listing") + """), s AS (SELECT perfil, count(*) AS n FROM m GROUP BY 1)
SELECT a.perfil AS perfil_a, b.perfil AS perfil_b, count(c.listing_id) AS n_interseccion FROM s a JOIN s b ON a.perfil < b.perfil
LEFT JOIN (SELECT x.perfil AS pa, y.perfil AS pb, x.listing_id FROM m x JOIN m y ON x.listing_id = y.listing_id AND x.perfil < y.perfil) c ON c.pa = a.perfil AND c.pb = b.perfil
GROUP BY 1, 2""").replace("\n\n, m AS", ",\nm AS"))
def _(spark, d):
    members = M.rule_matches(V.listing(spark, d), M.profile_table(spark, V.PROFILES))
    return overlap(members, [p["perfil"] for p in V.PROFILES]).select("perfil_a", "perfil_b", "n_interseccion")


@entry("j13_zone_panel_join", sql("""
SELECT z.nombre, coalesce(z.hereda_de, z.nombre) AS origen, count(p.id) AS n_poi, coalesce(min(p.nombre), '-') AS primero FROM zone z
LEFT JOIN poi p ON p.zona_etiquetada_origen = coalesce(z.hereda_de, z.nombre) GROUP BY 1, 2"""))
def _(spark, d):
    zones = V.zone(spark, d).select("nombre", F.coalesce("hereda_de", "nombre").alias("origen"))
    points = V.poi(spark, d).select("id", F.col("nombre").alias("poi"), F.col("zona_etiquetada_origen").alias("origen"))
    per_label = points.groupBy("origen").agg(F.count("*").alias("n"), F.min("poi").alias("p"))
    return zones.join(per_label, "origen", "left").select(
        "nombre", "origen", F.coalesce("n", F.lit(0)).alias("n_poi"), F.coalesce("p", F.lit("-")).alias("primero")
    )


@entry("j14_scores_with_attributes", sql("""
SELECT q.doc_id AS listing_id, q.quality, coalesce(l.corregimiento, '-') AS corregimiento, coalesce(l.price_usd, -1) AS price_usd
FROM labels q LEFT JOIN listing l ON l.listing_id = q.doc_id"""))
def _(spark, d):
    scores = V.table(spark, d, "labels").select(F.col("doc_id").alias("listing_id"), "quality")
    attributes = V.listing(spark, d).select("listing_id", "corregimiento", "price_usd")
    return scores.join(attributes, "listing_id", "left").fillna({"corregimiento": "-", "price_usd": -1.0})
