"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia import constants as K
from predia.operators import aggregates as A, gates as G
from predia.operators.filters import structured_search
from predia.plans import views as V, zone_health as Z
from predia.registry import entry
from predia.registry.sql import sql
from predia.registry.valuation import ESTIMATE_TEST, MODEL_WORDS_SQL, pairs, pool, rubric


@entry("a1_group_count", sql("SELECT corregimiento, tipo_inmueble, count(*) AS n FROM listing GROUP BY 1, 2"))
def _(spark, d):
    return A.group_count(V.listing(spark, d), "corregimiento", "tipo_inmueble").orderBy(F.desc("n"), "corregimiento", "tipo_inmueble")


@entry("a2_relative_frequency", sql("SELECT corregimiento, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM listing GROUP BY 1"))
def _(spark, d):
    return A.group_share(V.listing(spark, d), "corregimiento").withColumn("share", F.round("share", 6))


@entry("a3_distinct_count", sql("""
SELECT corregimiento, count(DISTINCT tipo_inmueble) AS tipos, count(DISTINCT price_usd) AS precios FROM listing GROUP BY 1"""))
def _(spark, d):
    return V.listing(spark, d).groupBy("corregimiento").agg(
        F.count_distinct("tipo_inmueble").alias("tipos"), F.count_distinct("price_usd").alias("precios")
    )


@entry("a4_filtered_total", sql("""
SELECT count(*) AS total FROM listing WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable AND tipo_inmueble = 'BUILDING' AND price_usd >= 100000"""))
def _(spark, d):
    return structured_search(V.listing(spark, d), tipo_inmueble="BUILDING", precio_min=100000).agg(F.count("*").alias("total"))


@entry("a5_points_per_zone", sql("""
SELECT z.nombre, coalesce(c.n, 0) AS n FROM zone z LEFT JOIN (
  SELECT corregimiento_asignado AS z, count(*) AS n FROM (SELECT corregimiento_asignado FROM stop_zone UNION ALL SELECT corregimiento_asignado FROM poi_zone)
  GROUP BY 1) c ON c.z = z.nombre"""))
def _(spark, d):
    from predia.operators.spatial import assign_zone

    shapes = V.polygon(spark, d)
    sources = [
        assign_zone(p, shapes).select(F.col("corregimiento_asignado").alias("nombre"))
        for p in (V.stop(spark, d), V.poi(spark, d))
    ]
    return A.zone_point_counts(V.zone(spark, d), sources, "nombre")


MERGE = "CASE categoria WHEN 'clinica' THEN 'salud' WHEN 'hospital' THEN 'salud' ELSE categoria END"
WEIGHT = f"CASE {MERGE} WHEN 'supermercado' THEN 0.3137 WHEN 'parque' THEN 0.2549 WHEN 'salud' THEN 0.2353 ELSE 0.098 END"


def weights(spark, values, key):
    """A weights table of a handful of rows."""
    return F.broadcast(spark.createDataFrame(list(values.items()), f"{key} string, peso double"))


@entry("a6_weighted_category_count", sql(f"""
SELECT z.nombre, round(coalesce(c.w, 0), 6) AS conteo_ponderado FROM zone z LEFT JOIN (
  SELECT zona_etiquetada_origen AS z, sum(({WEIGHT})::DOUBLE) AS w FROM poi GROUP BY 1) c ON c.z = z.nombre"""))
def _(spark, d):
    points = V.poi(spark, d).select(F.col("zona_etiquetada_origen").alias("nombre"), Z.merged_category().alias("categoria"))
    got = A.weighted_category_count(V.zone(spark, d), points, weights(spark, K.AMENITY_WEIGHTS, "categoria"), "nombre")
    return got.withColumn("conteo_ponderado", F.round("conteo_ponderado", 6))


@entry("a7_category_pivot", sql("SELECT zona_etiquetada_origen AS zona, " + ", ".join(
    f"count(*) FILTER (WHERE categoria = '{c}') AS {c}" for c in K.RAW_CATEGORIES) + " FROM poi GROUP BY 1"))
def _(spark, d):
    return A.category_pivot(V.poi(spark, d).withColumnRenamed("zona_etiquetada_origen", "zona"), "zona", "categoria", K.RAW_CATEGORIES)


@entry("a8_crosstab_share", sql("""
SELECT corregimiento, tipo_inmueble, round(count(*) / sum(count(*)) OVER (PARTITION BY corregimiento), 2) AS share FROM listing GROUP BY 1, 2"""))
def _(spark, d):
    kinds = ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"]
    return A.crosstab_share(V.listing(spark, d), "corregimiento", "tipo_inmueble", kinds)


@entry("a9_group_medians", sql("""
SELECT tipo_inmueble, columna, round(quantile_cont(valor, 0.5), 6) AS mediana, any_value(n) AS n FROM (
  SELECT tipo_inmueble, 'price_usd' AS columna, price_usd AS valor, count(*) OVER (PARTITION BY tipo_inmueble) AS n FROM listing
  UNION ALL SELECT tipo_inmueble, 'area_m2', area_m2, count(*) OVER (PARTITION BY tipo_inmueble) FROM listing
  UNION ALL SELECT tipo_inmueble, 'bedrooms', bedrooms::DOUBLE, count(*) OVER (PARTITION BY tipo_inmueble) FROM listing) GROUP BY 1, 2"""))
def _(spark, d):
    return A.group_medians(V.listing(spark, d), "tipo_inmueble", ["price_usd", "area_m2", "bedrooms"]).select(
        "tipo_inmueble", "columna", F.round("mediana", 6).alias("mediana"), "n"
    )


@entry("a10_describe", sql("""
SELECT columna, count(valor) AS count, round(avg(valor), 4) AS mean, round(stddev_samp(valor), 4) AS std, min(valor) AS min, max(valor) AS max,
  round(quantile_cont(valor, 0.25), 6) AS p25, round(quantile_cont(valor, 0.5), 6) AS p50, round(quantile_cont(valor, 0.75), 6) AS p75 FROM (
  SELECT 'price_usd' AS columna, price_usd AS valor FROM listing UNION ALL SELECT 'area_m2', area_m2 FROM listing
  UNION ALL SELECT 'bathrooms', bathrooms::DOUBLE FROM listing) GROUP BY 1"""))
def _(spark, d):
    got = A.describe(V.listing(spark, d), ["price_usd", "area_m2", "bathrooms"])
    return got.select("columna", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
                      *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")])


@entry("a11_mean_std_by_model", f"""
SELECT lang, dimension, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS count FROM (
  SELECT lang, unnest(['completitud_informativa', 'calidad_presentacion', 'diferenciadores_amenidades', 'transparencia_precio']) AS dimension,
    unnest([completitud_informativa, calidad_presentacion, diferenciadores_amenidades, transparencia_precio])::DOUBLE AS v FROM ({MODEL_WORDS_SQL})) GROUP BY 1, 2""")
def _(spark, d):
    got = A.mean_std_count(rubric(spark, d), "lang", K.QUALITY_DIMENSIONS)
    return got.select("lang", "dimension", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


@entry("a12_mean_gap", f"""
SELECT dimension, round(max(m) - min(m), 6) AS diferencia, max(m) - min(m) >= 0.5 AS notable FROM (
  SELECT grupo, dimension, avg(v) AS m FROM (SELECT doc_id % 2 AS grupo,
    unnest(['completitud_informativa', 'calidad_presentacion', 'diferenciadores_amenidades', 'transparencia_precio']) AS dimension,
    unnest([completitud_informativa, calidad_presentacion, diferenciadores_amenidades, transparencia_precio])::DOUBLE AS v FROM ({MODEL_WORDS_SQL})) GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) = 2""")
def _(spark, d):
    df = rubric(spark, d).withColumn("grupo", F.col("doc_id") % 2)
    return A.mean_gap(df, "grupo", K.QUALITY_DIMENSIONS).withColumn("diferencia", F.round("diferencia", 6))


@entry("a13_correlations", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM listing"
    for a in ("price_usd", "area_m2", "bathrooms") for b in ("price_usd", "area_m2", "bathrooms"))))
def _(spark, d):
    return A.correlations(V.listing(spark, d), ["price_usd", "area_m2", "bathrooms"]).withColumn("corr", F.round("corr", 6))


@entry("a14_mae", sql(f"SELECT count(*) AS n, round(avg(abs(precio_real - precio_predicho)), 4) AS mae FROM {ESTIMATE_TEST}"))
def _(spark, d):
    return pairs(spark, d).agg(F.count("*").alias("n"), F.round(A.mae(), 4).alias("mae"))


@entry("a15_mae_percent", sql(f"""
SELECT count(*) AS n, round(avg(abs(precio_real - precio_predicho)), 4) AS mae,
  round(avg(abs(precio_real - precio_predicho)) / (SELECT avg(price_usd) FROM pool) * 100, 6) AS pct_poblacion,
  round(avg(abs(precio_real - precio_predicho)) / avg(precio_real) * 100, 6) AS pct_pares FROM {ESTIMATE_TEST}"""))
def _(spark, d):
    got = A.mae_report(pairs(spark, d), pool(spark, d))
    return got.select("n", F.round("mae", 4).alias("mae"), F.round("pct_poblacion", 6).alias("pct_poblacion"), F.round("pct_pares", 6).alias("pct_pares"))


@entry("a16_mae_by_zone", sql(f"""
SELECT corregimiento AS zona, round(avg(abs(precio_real - precio_predicho)), 4) AS mae, count(*) AS n,
  round((avg(abs(precio_real - precio_predicho)) / (SELECT avg(abs(precio_real - precio_predicho)) FROM {ESTIMATE_TEST}) - 1) * 100, 6) AS vs_global_pct
FROM {ESTIMATE_TEST} GROUP BY 1"""))
def _(spark, d):
    p = pairs(spark, d)
    got = A.mae_by_zone(p, p.agg(A.mae().alias("m")).scalar())
    return got.select("zona", F.round("mae", 4).alias("mae"), "n", F.round("vs_global_pct", 6).alias("vs_global_pct"))


@entry("a17_sampling_margin", sql("""
SELECT count(*) AS poblacion, 150::BIGINT AS muestra, round(1.96::DOUBLE * sqrt(0.25::DOUBLE / 150) * sqrt((count(*) - 150) / (count(*) - 1)::DOUBLE), 9) AS margen
FROM listing_text WHERE descripcion_fuente <> 'ninguna'"""))
def _(spark, d):
    texts = V.listing_text(spark, d).filter("descripcion_fuente <> 'ninguna'")
    return A.sampling_margin(texts, 150).withColumn("margen", F.round("margen", 9))


@entry("a18_share_not_evaluable", sql("""
SELECT count(*) AS n, round(avg((descripcion_fuente = 'ninguna')::INT), 6) AS sin_texto, round(avg(precio_no_evaluable::INT), 6) AS sin_precio FROM listing_text"""))
def _(spark, d):
    got = A.shares(V.listing_text(spark, d), {"sin_texto": F.col("descripcion_fuente") == "ninguna", "sin_precio": F.col("precio_no_evaluable")})
    return got.select("n", F.round("sin_texto", 6).alias("sin_texto"), F.round("sin_precio", 6).alias("sin_precio"))


@entry("a19_score_histogram", f"""
SELECT d AS dimension, s AS score, count(*) FILTER (WHERE v = s) AS n FROM (
  SELECT unnest(['completitud_informativa', 'calidad_presentacion', 'diferenciadores_amenidades', 'transparencia_precio']) AS d,
    unnest([completitud_informativa, calidad_presentacion, diferenciadores_amenidades, transparencia_precio]) AS v FROM ({MODEL_WORDS_SQL})),
  (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS s) GROUP BY 1, 2""")
def _(spark, d):
    return A.score_histogram(rubric(spark, d), K.QUALITY_DIMENSIONS)


LIGHT_SHARES = {"verde": 0.2, "amarillo": 0.5, "rojo": 0.3}
LIGHT_CASE = "CASE WHEN precio_real - precio_predicho > 150000 THEN 'rojo' WHEN precio_real - precio_predicho < -150000 THEN 'verde' ELSE 'amarillo' END"


def drift_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS luz, count(*) FILTER (WHERE luz = '{k}') AS n, count(*) FILTER (WHERE luz = '{k}') / count(*)::DOUBLE * 100 AS pct, {v * 100}::DOUBLE AS ref FROM x"
        for k, v in LIGHT_SHARES.items()
    )
    return f"""
, x AS (SELECT {LIGHT_CASE} AS luz FROM {ESTIMATE_TEST})
SELECT luz, n, round(pct, 6) AS pct, round(pct - ref, 6) AS delta, (abs(pct - ref) > 5)::BIGINT AS violaciones FROM ({rows})"""


def lights(spark, d):
    gap = F.col("precio_real") - F.col("precio_predicho")
    return pairs(spark, d).withColumn(
        "luz", F.when(gap > 150000, "rojo").when(gap < -150000, "verde").otherwise("amarillo")
    )


def drift_query(spark, d):
    got = G.drift(lights(spark, d), "luz", LIGHT_SHARES, K.DRIFT_POINTS)
    return got.select("luz", "n", F.round("pct", 6).alias("pct"), F.round("delta", 6).alias("delta"), "violaciones")


DRIFT_SQL = sql(drift_sql()).replace("\n\n, x AS", ",\nx AS")
entry("a20_distribution_drift", DRIFT_SQL)(drift_query)


@entry("a21_low_confidence_by_zone", sql("""
SELECT corregimiento, count(*) AS n FROM listing WHERE bathrooms < 3 GROUP BY 1"""))
def _(spark, d):
    flagged = V.listing(spark, d).withColumn("confianza_reducida", F.col("bathrooms") < 3)
    return A.group_count(flagged.filter("confianza_reducida"), "corregimiento")


@entry("a22_load_summary", sql("""
SELECT CASE WHEN g = 1 THEN 'etiqueta' WHEN g = 2 THEN 'fuente' ELSE 'total' END AS grupo, coalesce(e, f, '') AS valor, n, sin_asignar, auditadas FROM (
  SELECT zona_etiquetada_origen AS e, fuente AS f, grouping(zona_etiquetada_origen, fuente) AS g, count(*) AS n,
    count(*) FILTER (WHERE corregimiento_asignado IS NULL) AS sin_asignar,
    count(*) FILTER (WHERE corregimiento_asignado <> zona_etiquetada_origen) AS auditadas
  FROM poi_zone GROUP BY GROUPING SETS ((zona_etiquetada_origen), (fuente), ()))"""))
def _(spark, d):
    return A.load_summary(Z.assign_points(V.poi(spark, d), V.polygon(spark, d)))


@entry("a23_top_pois_per_category", sql("""
SELECT zona_etiquetada_origen AS zona, categoria, any_value(n) AS n, string_agg(nombre, '|' ORDER BY r) AS primeros, greatest(any_value(n) - 5, 0) AS mas FROM (
  SELECT *, row_number() OVER (PARTITION BY zona_etiquetada_origen, categoria ORDER BY nombre, id) AS r,
    count(*) OVER (PARTITION BY zona_etiquetada_origen, categoria) AS n FROM poi) WHERE r <= 5 GROUP BY 1, 2"""))
def _(spark, d):
    got = A.top_with_rest(
        V.poi(spark, d).withColumnRenamed("zona_etiquetada_origen", "zona"), ["zona", "categoria"],
        [F.col("nombre"), F.col("id")], F.col("nombre"),
    )
    return got.select("zona", "categoria", "n", F.array_join("primeros", "|").alias("primeros"), "mas")


@entry("a24_outcome_share", """
SELECT event_type AS categoria, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""")
def _(spark, d):
    got = A.group_share(V.table(spark, d, "events").withColumnRenamed("event_type", "categoria"), "categoria")
    return got.withColumn("share", F.round("share", 6))
