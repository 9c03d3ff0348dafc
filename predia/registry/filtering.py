"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions import text as T
from predia.functions.pricing import model_coverage, price_per_m2, type_plural
from predia.operators import filters as P
from predia.plans import matching as M, views as V
from predia.registry import entry
from predia.registry.sql import sql

PAGE_COLUMNS = ["listing_id", "corregimiento", "tipo_inmueble", "price_usd"]
SPECIES = {"BUILDING": "Apartamentos", "MACHINERY": "Casas", "FURNITURE": "Edificios", "AUTOMOBILE": "Locales"}
POOL_ZONES = [f"NATION_{i}" for i in range(24) if i not in (7, 8)]


@entry("p1_evaluable_listings", sql(
    "SELECT listing_id, corregimiento, price_usd FROM listing WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable"))
def _(spark, d):
    return P.evaluable(V.listing(spark, d)).select("listing_id", "corregimiento", "price_usd")


@entry("p2_structured_filters", sql("""
SELECT listing_id, corregimiento, tipo_inmueble, price_usd FROM listing
WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable AND corregimiento = 'NATION_3'
  AND price_usd >= 0 AND price_usd <= 350000 AND bedrooms >= 2 AND bathrooms >= 2"""))
def _(spark, d):
    return P.structured_search(
        V.listing(spark, d), zona="NATION_3", precio_min=0, precio_max=350000, habitaciones_min=2, banos_min=2
    ).select(*PAGE_COLUMNS)


def _requests(spark, d):
    return V.table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, "OCEANO").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("zona"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("tipo_inmueble"),
    )


@entry("p3_rejected_requests", sql("""
SELECT c_custkey, zona, 'zona inválido' AS motivo FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'OCEANO' ELSE 'NATION_' || c_nationkey END AS zona FROM customer)
WHERE zona NOT IN (SELECT n_name FROM nation)
UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'OCEANO' ELSE 'NATION_' || c_nationkey END, 'tipo_inmueble inválido'
FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"""))
def _(spark, d):
    kinds = V.table(spark, d, "customer").select("c_mktsegment").distinct().filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")
    )
    rejected = P.reject_requests(
        _requests(spark, d), {"zona": V.table(spark, d, "nation").select("n_name"), "tipo_inmueble": kinds}
    )
    return rejected.select("c_custkey", "zona", "motivo")


@entry("p4_type_plural", sql("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Apartamentos' WHEN 1 THEN 'Casas' WHEN 2 THEN 'Edificios'
  WHEN 3 THEN 'Locales' WHEN 4 THEN 'Terrenos' ELSE c_mktsegment END AS plural FROM customer"""))
def _(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("Apartamento", "Casa", "Edificio", "Local", "Terreno")])
    kind = F.coalesce(F.get(kinds, (F.col("c_custkey") % 6).cast("int")), "c_mktsegment")
    return V.table(spark, d, "customer").select("c_custkey", type_plural(kind).alias("plural"))


@entry("p5_model_pool", sql("""
SELECT listing_id, corregimiento, price_usd, area_m2 FROM listing
WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable AND corregimiento NOT IN ('NATION_7', 'NATION_8')
  AND tipo_inmueble = 'BUILDING' AND area_m2 IS NOT NULL"""))
def _(spark, d):
    return P.model_pool(V.listing(spark, d), V.POOL_EXCLUDED, V.MODEL_TYPE).select(
        "listing_id", "corregimiento", "price_usd", "area_m2"
    )


@entry("p6_filter_funnel", sql("""
, f AS (SELECT count(*) AS k0,
  count(*) FILTER (WHERE a) AS k1, count(*) FILTER (WHERE a AND b) AS k2, count(*) FILTER (WHERE a AND b AND c) AS k3,
  count(*) FILTER (WHERE a AND b AND c AND e) AS k4, count(*) FILTER (WHERE a AND b AND c AND e AND g) AS k5
  FROM (SELECT corregimiento <> 'zona_no_determinada' AS a, NOT precio_no_evaluable AS b,
    corregimiento NOT IN ('NATION_7', 'NATION_8') AS c, tipo_inmueble = 'BUILDING' AS e, area_m2 IS NOT NULL AS g FROM listing))
SELECT 1::BIGINT AS orden, 'zona_conocida' AS paso, k1 AS quedan, k0 - k1 AS descartadas FROM f
UNION ALL SELECT 2, 'precio_evaluable', k2, k1 - k2 FROM f UNION ALL SELECT 3, 'zona_en_pool', k3, k2 - k3 FROM f
UNION ALL SELECT 4, 'tipo_en_pool', k4, k3 - k4 FROM f UNION ALL SELECT 5, 'area_conocida', k5, k4 - k5 FROM f""").replace("\n\n, f AS", ",\nf AS"))
def _(spark, d):
    return P.filter_funnel(V.listing(spark, d), P.pool_steps(V.POOL_EXCLUDED, V.MODEL_TYPE))


@entry("p7_scoring_eligible", sql("""
SELECT listing_id, corregimiento, area_m2 FROM listing
WHERE corregimiento IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3') AND tipo_inmueble = 'BUILDING' AND area_m2 > 0
  AND NOT precio_no_evaluable"""))
def _(spark, d):
    zones = [f"NATION_{i}" for i in range(4)]
    return P.scoring_eligible(V.listing(spark, d), zones, V.MODEL_TYPE).select("listing_id", "corregimiento", "area_m2")


PROFILE_MATCH = """FROM listing_text l JOIN profile p ON list_contains(p.corregimientos, l.corregimiento)
WHERE (p.price_usd_min IS NULL OR l.price_usd >= p.price_usd_min) AND (p.price_usd_max IS NULL OR l.price_usd <= p.price_usd_max)
  AND (p.bedrooms_min IS NULL OR l.bedrooms >= p.bedrooms_min) AND (p.bedrooms_max IS NULL OR l.bedrooms <= p.bedrooms_max)
  AND (p.area_m2_min IS NULL OR l.area_m2 >= p.area_m2_min) AND (p.area_m2_max IS NULL OR l.area_m2 <= p.area_m2_max)"""


@entry("p8_profile_rules", sql("SELECT p.perfil, l.listing_id " + PROFILE_MATCH.replace("listing_text", "listing")))
def _(spark, d):
    return M.rule_matches(V.listing(spark, d), M.profile_table(spark, V.PROFILES)).select("perfil", "listing_id")


@entry("p9_keyword_rule", sql("""
SELECT listing_id, descripcion_fuente FROM listing_text
WHERE (contains(lower(descripcion), 'onen') OR contains(lower(descripcion), 'sch')) AND NOT contains(lower(descripcion), 'ción')
  AND descripcion_fuente <> 'ninguna'"""))
def _(spark, d):
    rule = T.keyword_rule("descripcion", "descripcion_fuente", ["onen", "sch"], ["ción"])
    return V.listing_text(spark, d).filter(rule).select("listing_id", "descripcion_fuente")


@entry("p10_excluded_types", sql("""
SELECT listing_id, title FROM listing WHERE NOT (contains(lower(title), 'machinery') OR contains(lower(title), '1-urgent'))"""))
def _(spark, d):
    return V.listing(spark, d).filter(~T.is_excluded_type("title", V.EXCLUDED_WORDS)).select("listing_id", "title")


@entry("p11_model_coverage", sql("""
SELECT listing_id, coalesce(CASE WHEN bedrooms IS NULL THEN NULL ELSE (a IS NULL AND b IS NULL)::VARCHAR END, '?') AS cubierto,
  coalesce(CASE WHEN bedrooms IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) THEN concat_ws('; ', a, b) END, '-') AS motivo FROM (
  SELECT listing_id, bedrooms,
    CASE WHEN corregimiento IN ('NATION_7', 'NATION_8', 'zona_no_determinada') THEN '''' || corregimiento || ''' no entra en el modelo de precio' END AS a,
    CASE WHEN tipo_inmueble <> 'BUILDING' THEN 'tipo_inmueble ''' || tipo_inmueble || ''' no entra en el modelo de precio' END AS b FROM listing)"""))
def _(spark, d):
    # A listing without rooms stands for a request that names no type.
    df = V.listing(spark, d).withColumn("kind", F.when(F.col("bedrooms").isNotNull(), F.col("tipo_inmueble")))
    c = model_coverage("corregimiento", "kind", POOL_ZONES, V.MODEL_TYPE)
    return df.select(
        "listing_id", F.coalesce(c["cubierto"].cast("string"), F.lit("?")).alias("cubierto"),
        F.coalesce(c["motivo"], F.lit("-")).alias("motivo"),
    )


@entry("p12_refine_results", sql("""
SELECT listing_id, bedrooms FROM (SELECT *, CASE WHEN price_usd > 300000 THEN 'rojo' WHEN price_usd < 60000 THEN 'verde'
  WHEN operation = 'venta' THEN 'amarillo' END AS luz FROM listing)
WHERE tipo_inmueble = 'MACHINERY' AND coalesce(bedrooms, 0) >= 4 AND luz = 'rojo' AND corregimiento = 'NATION_5'"""))
def _(spark, d):
    light = (
        F.when(F.col("price_usd") > 300000, "rojo").when(F.col("price_usd") < 60000, "verde")
        .when(F.col("operation") == "venta", "amarillo")
    )
    df = V.listing(spark, d).withColumn("categoria_semaforo", light)
    return P.refine(df, "NATION_5", "MACHINERY", 4, "rojo").select("listing_id", "bedrooms")


@entry("p13_price_per_m2", sql("""
SELECT listing_id, round(coalesce(CASE WHEN area_m2 > 0 THEN price_usd / area_m2 END, -1), 6) AS precio_m2 FROM listing"""))
def _(spark, d):
    value = F.coalesce(price_per_m2("price_usd", "area_m2"), F.lit(-1.0))
    return V.listing(spark, d).select("listing_id", F.round(value, 6).alias("precio_m2"))


@entry("p14_evaluable_text", sql("""
SELECT descripcion_fuente <> 'ninguna' AS evaluable, count(*) AS n FROM listing_text GROUP BY 1"""))
def _(spark, d):
    return V.listing_text(spark, d).groupBy((F.col("descripcion_fuente") != "ninguna").alias("evaluable")).agg(
        F.count("*").alias("n")
    )
