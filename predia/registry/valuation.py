"""Valuation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia import constants as K
from predia.functions import pricing as P, quality as Q
from predia.functions.text import quality_json
from predia.operators import aggregates as A, sets as S
from predia.operators.filters import evaluable, model_pool
from predia.operators.silhouette import silhouette
from predia.plans import models as L, valuation as W, views as V
from predia.registry import entry
from predia.registry.sql import sql
from predia.session import cut

MAE = 120000.0
ESTIMATE_TEST = "(SELECT * FROM estimate WHERE cubo >= 80)"


def pool(spark, d):
    """Model pool with split and folds, computed once per query that reads it several times."""
    rows = model_pool(V.listing(spark, d), V.POOL_EXCLUDED, V.MODEL_TYPE).filter(
        "bedrooms IS NOT NULL AND bathrooms IS NOT NULL"
    )
    return cut(W.with_split(
        rows.select("listing_id", "corregimiento", "tipo_inmueble", "price_usd", "bedrooms", "bathrooms", "area_m2")
    ))


def comparable_table(spark, d, test_only: bool = False):
    p = pool(spark, d)
    return W.comparables(p.filter("not es_train") if test_only else p, p.filter("es_train"))


def priced(spark, d, test_only: bool = False):
    p = pool(spark, d)
    asked = p.filter("not es_train") if test_only else p
    return W.priced(W.estimates(W.comparables(asked, p.filter("es_train"))), asked)


def pairs(spark, d):
    return priced(spark, d, test_only=True).select(
        F.col("listing_id").alias("propiedad_id"), "precio_real", "precio_predicho", F.col("corregimiento").alias("zona")
    )


ZONES = [f"NATION_{i}" for i in range(6)]


@entry("v1_one_hot", sql("SELECT listing_id, " + ", ".join(f"(corregimiento = '{z}')::INT AS \"zona_{z}\"" for z in ZONES) + " FROM pool"))
def _(spark, d):
    return W.one_hot(pool(spark, d), "corregimiento", ZONES).select("listing_id", *[f"zona_{z}" for z in ZONES])


@entry("v2_standardise", sql("SELECT listing_id, " + ", ".join(
    f"round(({c}::DOUBLE - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}::DOUBLE) FROM train), 7) AS {c}_z" for c in W.NUMERIC) + " FROM pool"))
def _(spark, d):
    p = pool(spark, d)
    return W.standardise(p, p.filter("es_train")).select("listing_id", *[F.round(f"{c}_z", 7).alias(f"{c}_z") for c in W.NUMERIC])


@entry("v3_split", sql("SELECT listing_id, cubo < 80 AS es_train, pliegue FROM pool"))
def _(spark, d):
    return pool(spark, d).select("listing_id", "es_train", "pliegue")


@entry("v4_knn_prediction", sql(f"SELECT listing_id, round(precio_predicho, 4) AS precio_predicho FROM {ESTIMATE_TEST}"))
def _(spark, d):
    return W.estimates(comparable_table(spark, d, True)).select("listing_id", F.round("precio_predicho", 4).alias("precio_predicho"))


@entry("v5_comparables", sql("SELECT listing_id, rank, vecino_precio, round(distancia, 6) AS distancia FROM comparable"))
def _(spark, d):
    return comparable_table(spark, d).select(
        "listing_id", F.col("rank").cast("bigint").alias("rank"), "vecino_precio", F.round("distancia", 6).alias("distancia")
    )


@entry("v6_price_estimate", sql("""
SELECT listing_id, round(precio_predicho, 4) AS precio_predicho, n_comparables, n_comparables < 5 AS cobertura_insuficiente,
  round(precio_real - precio_predicho, 4) AS diferencia_absoluta, round((precio_real - precio_predicho) / precio_predicho, 9) AS diferencia_porcentual FROM estimate"""))
def _(spark, d):
    return priced(spark, d).select(
        "listing_id", F.round("precio_predicho", 4).alias("precio_predicho"), "n_comparables", "cobertura_insuficiente",
        F.round("diferencia_absoluta", 4).alias("diferencia_absoluta"), F.round("diferencia_porcentual", 9).alias("diferencia_porcentual"),
    )


@entry("v7_light_by_mae", sql(f"""
SELECT listing_id, CASE WHEN precio_real - precio_predicho > 1.5 * {MAE} THEN 'rojo' WHEN precio_real - precio_predicho < -1.5 * {MAE} THEN 'verde' ELSE 'amarillo' END AS luz FROM estimate"""))
def _(spark, d):
    return priced(spark, d).select("listing_id", P.light_by_mae("diferencia_absoluta", 1.5, MAE).alias("luz"))


@entry("v8_light_by_share", sql("""
SELECT listing_id, CASE WHEN p <= -0.15 THEN 'verde' WHEN p >= 0.15 THEN 'rojo' ELSE 'amarillo' END AS luz
FROM (SELECT listing_id, (precio_real - precio_predicho) / precio_predicho AS p FROM estimate)"""))
def _(spark, d):
    return priced(spark, d).select("listing_id", P.light_by_share("diferencia_porcentual", 0.15).alias("luz"))


REASON_SQL = """CASE WHEN bedrooms IS NULL OR bathrooms IS NULL OR area_m2 IS NULL THEN 'sin dormitorios, baños o superficie'
  WHEN tipo_inmueble <> 'BUILDING' THEN 'tipo fuera del pool' WHEN corregimiento IN ('NATION_7', 'NATION_8') THEN 'zona fuera del pool' END"""


def reason():
    return W.failure_reason(excluded=V.POOL_EXCLUDED, model_type=V.MODEL_TYPE)


@entry("v9_valuation_record", sql(f"""
SELECT l.listing_id, coalesce(round(e.precio_predicho, 4), -1) AS precio_predicho, coalesce({REASON_SQL},
  CASE WHEN e.precio_real - e.precio_predicho > 1.5 * {MAE} THEN 'rojo' WHEN e.precio_real - e.precio_predicho < -1.5 * {MAE} THEN 'verde' ELSE 'amarillo' END) AS resultado
FROM listing l LEFT JOIN estimate e ON e.listing_id = l.listing_id
WHERE l.corregimiento <> 'zona_no_determinada' AND NOT l.precio_no_evaluable""".replace("tipo_inmueble", "l.tipo_inmueble").replace("WHEN corregimiento", "WHEN l.corregimiento")))
def _(spark, d):
    p = pool(spark, d)
    _, failed = W.split_failures(evaluable(V.listing(spark, d)), reason())
    valued = W.valuation(p, p.filter("es_train"), mae_reference=MAE)
    return valued.select("listing_id", F.round("precio_predicho", 4).alias("precio_predicho"), F.col("categoria_semaforo").alias("resultado")).unionByName(
        failed.select("listing_id", F.lit(-1.0).alias("precio_predicho"), F.col("motivo").alias("resultado"))
    )


@entry("v10_calibration", sql(f"""
SELECT count(*) AS n, round(avg(h), 4) AS semi_ancho_medio, round(any_value(m), 4) AS mae, round(avg((h < m)::INT) * 100, 6) AS pct_menor_que_mae,
  round(quantile_cont(h, 0.5), 4) AS semi_ancho_mediana FROM (
  SELECT precio_predicho * 0.1 AS h, avg(abs(precio_real - precio_predicho)) OVER () AS m FROM {ESTIMATE_TEST})"""))
def _(spark, d):
    got = W.calibration(cut(pairs(spark, d)))
    return got.select("n", *[F.round(c, 4).alias(c) for c in ("semi_ancho_medio", "mae")],
                      F.round("pct_menor_que_mae", 6).alias("pct_menor_que_mae"), F.round("semi_ancho_mediana", 4).alias("semi_ancho_mediana"))


OOF_SQL = """
, oof AS (SELECT listing_id, any_value(z) AS zona, any_value(f) AS pliegue, any_value(real) AS precio_real, avg(p) AS precio_predicho FROM (
  SELECT q.listing_id, q.corregimiento AS z, q.pliegue AS f, q.price_usd AS real, t.price_usd AS p, row_number() OVER (PARTITION BY q.listing_id ORDER BY
    wb * (q.bedrooms - t.bedrooms) * (q.bedrooms - t.bedrooms) + wt * (q.bathrooms - t.bathrooms) * (q.bathrooms - t.bathrooms)
    + wa * (q.area_m2 - t.area_m2) * (q.area_m2 - t.area_m2) + CASE WHEN q.corregimiento = t.corregimiento THEN 0.0 ELSE 2.0 END, t.listing_id) AS r
  FROM train q JOIN train t ON q.pliegue <> t.pliegue, scale) WHERE r <= 5 GROUP BY 1),
fold AS (SELECT pliegue, count(*) AS n, avg(abs(precio_real - precio_predicho)) AS mae FROM oof GROUP BY 1)
"""


def oof_sql(body: str) -> str:
    return sql(OOF_SQL + body).replace("\n\n, oof AS", ",\noof AS")


@entry("v11_cv_errors", oof_sql("SELECT pliegue, n, round(mae, 7) AS mae, round((SELECT avg(mae) FROM fold), 4) AS mae_promedio FROM fold"))
def _(spark, d):
    got = W.cv_errors(cut(W.out_of_fold(pool(spark, d).filter("es_train"))))
    return got.select("pliegue", "n", F.round("mae", 7).alias("mae"), F.round("mae_promedio", 4).alias("mae_promedio"))


@entry("v12_oof_mae_by_zone", oof_sql("""
SELECT zona, round(avg(abs(precio_real - precio_predicho)), 4) AS mae, count(*) AS n,
  round((avg(abs(precio_real - precio_predicho)) / (SELECT avg(mae) FROM fold) - 1) * 100, 6) AS vs_global_pct FROM oof GROUP BY 1"""))
def _(spark, d):
    got = W.oof_by_zone(cut(W.out_of_fold(pool(spark, d).filter("es_train"))))
    return got.select("zona", F.round("mae", 4).alias("mae"), "n", F.round("vs_global_pct", 6).alias("vs_global_pct"))


def forest_facts(spark, rows, report):
    """What must hold of a forest's report: it saw the split's rows, its ratio is that of its errors, and no
    error is beyond the range of prices, as a forest's prediction is a mean of them."""
    n = rows.agg(F.struct(F.count_if("es_train").alias("train"), F.count_if(~F.col("es_train")).alias("test")).alias("n")).scalar()
    spread = rows.agg((F.max("price_usd") - F.min("price_usd")).alias("s")).scalar()
    ratio = F.abs(F.col("ratio_sobreajuste") - F.col("mae_test") / F.col("mae_train")) < 1e-9
    return report.select(
        "modelo", n["train"].alias("n_train"), n["test"].alias("n_test"), ratio.alias("ratio_coherente"),
        F.least(*[F.col(c).between(0, spread) for c in ("mae_cv", "mae_train", "mae_test")]).alias("en_rango"),
    )


def forest_facts_sql(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS modelo, count(*) FILTER (cubo < 80) AS n_train, count(*) FILTER (cubo >= 80) AS n_test,
  true AS ratio_coherente, true AS en_rango FROM {rows}"""


@entry("v13_random_forest", sql(forest_facts_sql("random_forest", "pool")))
def _(spark, d):
    p = pool(spark, d)
    return forest_facts(spark, p, L.forest_report(p, folds=5, trees=20, depth=6))


@entry("v14_feature_importance", sql("""
SELECT count(DISTINCT corregimiento) FILTER (cubo < 80) + 4 AS n, 1.0::DOUBLE AS suma, true AS en_orden, true AS sin_desconocida FROM pool"""))
def _(spark, d):
    """Importances of every variable sum to one and fall from place to place; no row was of an unknown zone."""
    ranking = cut(L.importance_ranking(pool(spark, d), trees=20, depth=6))
    later = ranking.select((F.col("posicion") - 1).alias("posicion"), F.col("importancia").alias("siguiente"))
    return ranking.join(later, "posicion", "left").agg(
        F.count("*").alias("n"), F.round(F.sum("importancia"), 9).alias("suma"),
        F.bool_and(F.coalesce(F.col("importancia") >= F.col("siguiente"), F.lit(True))).alias("en_orden"),
        F.bool_and((F.col("variable") != "zona___desconocida") | (F.col("importancia") == 0)).alias("sin_desconocida"),
    )


@entry("v15_model_comparison", oof_sql(f"""
, f AS (SELECT pliegue, sum(price_usd) AS s, count(*) AS n FROM train GROUP BY 1),
media AS (SELECT t.pliegue, avg(abs(t.price_usd - (x.s - f.s) / (x.n - f.n))) AS mae FROM train t JOIN f USING (pliegue), (SELECT sum(s) AS s, sum(n) AS n FROM f) x GROUP BY 1),
m AS (SELECT 1 AS orden, 'knn' AS modelo, (SELECT avg(mae) FROM fold) AS mae_cv, avg(abs(precio_real - precio_predicho)) AS mae_test FROM {ESTIMATE_TEST}
  UNION ALL SELECT 2, 'random_forest', NULL, NULL
  UNION ALL SELECT 3, 'media', (SELECT avg(mae) FROM media), avg(abs(price_usd - (SELECT avg(price_usd) FROM train))) FROM pool WHERE cubo >= 80)
SELECT modelo, (SELECT count(*) FROM train) AS n_cv, (SELECT count(*) FROM pool WHERE cubo >= 80) AS n_test,
  coalesce(round(mae_cv, 4), -1) AS mae_cv, coalesce(round(mae_test, 4), -1) AS mae_test,
  coalesce(round(mae_test / (SELECT avg(price_usd) FROM pool) * 100, 6), -1) AS pct_precio_medio,
  coalesce(round(abs(mae_test - b) / b * 100, 6), -1) AS diferencia_pct, true AS coherente
FROM m, (SELECT mae_test AS b FROM m WHERE orden = 1)"""))
def _(spark, d):
    """Neighbours, forest and the plain mean over the same folds and test rows.

    A forest's errors have no SQL, so they are shown as -1 and checked in place: every training row was
    scored once, in its own fold, within the range of the prices; and the gap to the first model and its
    flag follow from the errors.
    """
    p = pool(spark, d)
    train, test = p.filter("es_train"), p.filter("not es_train")
    data, pipeline = L.prepared(p), L.forest(trees=20, depth=6)
    knn = cut(W.out_of_fold(train))
    forest = L.out_of_fold_model(pipeline, data)
    priced_test = W.priced(W.estimates(W.comparables(test, train)), test).select("listing_id", "precio_real", "precio_predicho")
    folds = cut(train.groupBy("pliegue").agg(F.sum("price_usd").alias("s"), F.count("*").alias("n")))
    whole = folds.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n")).alias("x")).scalar()
    others = folds.select("pliegue", ((whole["s"] - F.col("s")) / (whole["n"] - F.col("n"))).alias("precio_predicho"))
    real = F.col("price_usd").alias("precio_real")
    plain = train.join(others, "pliegue").select("listing_id", "pliegue", real, "precio_predicho")
    plain_test = test.select("listing_id", real, train.agg(F.avg("price_usd").alias("m")).scalar().alias("precio_predicho"))
    scored = {"knn": (knn, priced_test), "random_forest": (forest, L.held_out_model(pipeline, data)), "media": (plain, plain_test)}
    metrics = cut(W.model_metrics(scored))
    got = cut(W.model_comparison(metrics, p.agg(F.avg("price_usd").alias("m")).scalar()).join(metrics.select("modelo", "n_cv", "n_test"), "modelo"))
    base = got.filter(F.col("modelo") == "knn").agg(F.max("mae_test").alias("m")).scalar()
    twice = forest.groupBy("listing_id").count().filter("count > 1").agg(F.count("*").alias("n")).scalar()
    strays = forest.join(knn, ["listing_id", "pliegue"], "left_anti").agg(F.count("*").alias("n")).scalar()
    prices = train.agg(F.struct(F.min("price_usd").alias("lo"), F.max("price_usd").alias("hi")).alias("p")).scalar()
    beyond = forest.filter(~F.col("precio_predicho").between(prices["lo"], prices["hi"])).agg(F.count("*").alias("n")).scalar()
    gap = F.abs(F.col("mae_test") - base) / base * 100
    sound = (F.abs(gap - F.col("diferencia_pct")) < 1e-9) & (F.col("supera_umbral") == (gap > 15)) & (twice == 0) & (strays == 0) & (beyond == 0)
    shown = {c: F.when(F.col("modelo") == "random_forest", -1.0).otherwise(F.round(c, n)).alias(c)
             for c, n in (("mae_cv", 4), ("mae_test", 4), ("pct_precio_medio", 6), ("diferencia_pct", 6))}
    return got.select("modelo", "n_cv", "n_test", *shown.values(), sound.alias("coherente"))


@entry("v16_forest_with_embedding", sql(forest_facts_sql(
    "random_forest_embedding", "pool WHERE listing_id % (SELECT count(*) FROM embeddings) IN (SELECT vec_id FROM embeddings)")))
def _(spark, d):
    vectors = V.table(spark, d, "embeddings")
    joined = cut(pool(spark, d).withColumn(
        "vec_id", F.pmod("listing_id", vectors.agg(F.count("*").alias("n")).scalar())
    ).join(vectors.select("vec_id", "embedding"), "vec_id"))
    return forest_facts(spark, joined, L.forest_report(joined, folds=5, embedding=True, trees=10, depth=5))


def segment_rows(spark, d):
    return pool(spark, d).withColumn("precio_por_m2", P.price_per_m2("price_usd", "area_m2")).filter("precio_por_m2 IS NOT NULL")


@entry("v17_kmeans_sweep", """
SELECT k::INT AS k, true AS en_rango, true AS elegido_es_maximo FROM range(2, 11) t(k)""")
def _(spark, d):
    """Each k has its silhouettes and inertia, and only the k of the greatest silhouette is flagged."""
    sweep = cut(L.kmeans_sweep(segment_rows(spark, d)))
    most = sweep.agg(F.max("silueta").alias("m")).scalar()
    inside = (F.abs("silueta") <= 1) & (F.abs("silueta_cuadrada") <= 1) & (F.col("inercia") > 0)
    return sweep.select("k", inside.alias("en_rango"), (F.col("elegido") == (F.col("silueta") == most)).alias("elegido_es_maximo"))


CENTRES_SQL = """centre AS (SELECT dense_rank() OVER (ORDER BY tipo_inmueble) - 1 AS cluster_id, a, p FROM (
  SELECT tipo_inmueble, round(avg(area_m2), 3) AS a, round(avg(price_usd), 1) / 1000 AS p FROM listing GROUP BY 1))"""
ASSIGNED_SQL = """asignada AS (SELECT listing_id, corregimiento, price_usd, area_m2, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (
  SELECT l.*, c.cluster_id, (area_m2 - a) * (area_m2 - a) + (price_usd / 1000 - p) * (price_usd / 1000 - p) AS d FROM pool l, centre c) GROUP BY 1, 2, 3, 4)"""


def segment_sql(body: str) -> str:
    head = sql("SELECT 1 FROM listing, pool")
    return head[: head.rindex("\n")] + ",\n" + CENTRES_SQL + ",\n" + ASSIGNED_SQL + "\n" + body


def assigned(spark, d):
    """Pool rows by the nearest of five centres, the mean area and price of each type."""
    # A row per type, read three times below: the listings are derived for it once.
    centres = cut(V.listing(spark, d).groupBy("tipo_inmueble").agg(
        F.round(F.avg("area_m2"), 3).alias("area_m2"), (F.round(F.avg("price_usd"), 1) / 1000).alias("miles")
    ))
    # Types are few, so numbering them by their sorted list stays a small row.
    kinds = centres.agg(F.sort_array(F.collect_set("tipo_inmueble")).alias("k")).scalar()
    numbered = centres.withColumn("cluster_id", F.array_position(kinds, F.col("tipo_inmueble")) - 1)
    rows = pool(spark, d).withColumn("miles", F.col("price_usd") / 1000)
    return L.nearest_centre(rows, numbered, ["area_m2", "miles"])


@entry("v18_assign_segment", segment_sql("SELECT listing_id, cluster_id FROM asignada"))
def _(spark, d):
    return assigned(spark, d).select("listing_id", F.col("cluster_id").cast("bigint").alias("cluster_id"))


@entry("v17_silhouette", segment_sql("""
, d AS (SELECT x.listing_id, x.cluster_id AS own, y.cluster_id AS other, sum(sqrt((x.area_m2 - y.area_m2) * (x.area_m2 - y.area_m2)
    + (x.price_usd - y.price_usd) / 1000 * ((x.price_usd - y.price_usd) / 1000))) AS s, count(*) AS n FROM asignada x, asignada y GROUP BY 1, 2, 3),
s AS (SELECT listing_id, own, max(s / (n - 1)) FILTER (own = other AND n > 1) AS a, min(s / n) FILTER (own <> other) AS b FROM d GROUP BY 1, 2)
SELECT own::BIGINT AS cluster_id, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silueta FROM s GROUP BY 1""").replace("\n\n, d AS", ",\nd AS"))
def _(spark, d):
    """Exact Euclidean silhouette of the segments around fixed centres."""
    rows = assigned(spark, d)
    return silhouette(rows, ["area_m2", "miles"], ["cluster_id"]).select(
        F.col("cluster").cast("bigint").alias("cluster_id"), "n", F.round("silueta", 6).alias("silueta"))


@entry("v18_kmeans_segments", sql("""
SELECT listing_id, true AS es_el_mas_cercano FROM pool WHERE area_m2 > 0"""))
def _(spark, d):
    """Every row is in the trained segment whose centre is nearest to it; cheaper centres come first."""
    rows = cut(segment_rows(spark, d))
    scaling, centres = L.fit_segments(rows, 2)
    z = F.array(*[(F.col(c).cast("double") - m) / s for c, (m, s) in scaling.items()])

    def distance(centre):
        return F.aggregate(F.zip_with(z, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)

    nearest = F.array_position(F.array(*[distance(c) for c in centres]), F.array_min(F.array(*[distance(c) for c in centres]))) - 1
    ordered = centres[0][0] <= centres[1][0]
    return rows.select("listing_id", ((L.assign_segment(scaling, centres) == nearest) & F.lit(ordered)).alias("es_el_mas_cercano"))


@entry("v19_segment_medians", segment_sql("""
SELECT cluster_id, columna, round(quantile_cont(valor, 0.5), 6) AS mediana, count(*) AS n FROM (
  SELECT cluster_id, unnest(['price_usd', 'area_m2']) AS columna, unnest([price_usd, area_m2]) AS valor FROM asignada) GROUP BY 1, 2"""))
def _(spark, d):
    got = A.group_medians(cut(assigned(spark, d)), "cluster_id", ["price_usd", "area_m2"])
    return got.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "columna", F.round("mediana", 6).alias("mediana"), "n")


@entry("v19_segment_by_zone", segment_sql("""
SELECT corregimiento, cluster_id, round(count(*) / sum(count(*)) OVER (PARTITION BY corregimiento), 2) AS share FROM asignada GROUP BY 1, 2"""))
def _(spark, d):
    got = A.crosstab_share(assigned(spark, d), "corregimiento", "cluster_id", list(range(5)))
    return got.withColumn("cluster_id", F.col("cluster_id").cast("bigint"))


@entry("v20_test_pairs", sql(f"""
SELECT listing_id AS propiedad_id, precio_real, round(precio_predicho, 4) AS precio_predicho, corregimiento AS zona FROM {ESTIMATE_TEST}"""))
def _(spark, d):
    p = pool(spark, d)
    train, test = p.filter("es_train"), p.filter("not es_train")
    problems = S.split_report(p, train, test, "listing_id").select(
        (F.col("en_ambos") + F.col("en_ninguno") + F.col("ajenos")).alias("n")
    ).scalar()
    sound = F.when(problems > 0, F.raise_error(F.lit("split is not disjoint and complete"))).otherwise(F.lit(True))
    got = W.priced(W.estimates(W.comparables(test, train)), test).filter(sound)
    return got.select(
        F.col("listing_id").alias("propiedad_id"), "precio_real", F.round("precio_predicho", 4).alias("precio_predicho"),
        F.col("corregimiento").alias("zona"),
    )


@entry("v21_transparency", sql(f"""
SELECT listing_id AS propiedad_id, round(precio_real - precio_predicho, 4) AS diferencia_absoluta, count(*) OVER () AS n_muestras,
  round(avg(abs(precio_real - precio_predicho)) OVER (), 4) AS mae_absoluto,
  round(avg(abs(precio_real - precio_predicho)) OVER () / (SELECT avg(price_usd) FROM pool) * 100, 6) AS mae_porcentual FROM {ESTIMATE_TEST}"""))
def _(spark, d):
    mean = pool(spark, d).agg(F.avg("price_usd").alias("m")).scalar()
    got = W.transparency(cut(pairs(spark, d)), None, mean)
    return got.select("propiedad_id", F.round("diferencia_absoluta", 4).alias("diferencia_absoluta"), "n_muestras",
                      F.round("mae_absoluto", 4).alias("mae_absoluto"), F.round("mae_porcentual", 6).alias("mae_porcentual"))


@entry("v22_rubric_validation", """
SELECT event_id % 4 AS forma, count(*) AS n, count(*) FILTER (WHERE event_id % 4 <> 2 AND event_id % 7 BETWEEN 1 AND 5 AND user_id % 6 BETWEEN 1 AND 5) AS validas FROM events GROUP BY 1""")
def _(spark, d):
    from predia.registry.scalars import reply

    k = F.col("event_id")
    parsed = quality_json(reply(k, k % 7, F.col("user_id") % 6))
    return V.table(spark, d, "events").groupBy((k % 4).alias("forma")).agg(
        F.count("*").alias("n"), F.count(parsed).alias("validas")
    )


@entry("v23_merge_attempts", """
SELECT listing_id, coalesce(arg_max(score, (score IS NOT NULL, intento)) FILTER (WHERE score IS NOT NULL), -1) AS score, max(score IS NOT NULL) AS valido,
  coalesce(max(intento) FILTER (WHERE score IS NOT NULL), max(intento)) AS intento FROM (
  SELECT user_id AS listing_id, CASE WHEN event_id % 13 = 0 THEN event_id % 5 + 1 END AS score, event_id AS intento FROM events) GROUP BY 1""")
def _(spark, d):
    k = F.col("event_id")
    attempts = V.table(spark, d, "events").select(
        F.col("user_id").alias("listing_id"), F.when(k % 13 == 0, k % 5 + 1).alias("score"), k.alias("intento")
    )
    got = W.merge_attempts(attempts)
    return got.select("listing_id", F.coalesce("score", F.lit(-1)).alias("score"), "valido", "intento")


@entry("v23_pending_attempts", """
SELECT c_custkey AS listing_id, coalesce(n, 0)::BIGINT AS fallidos FROM customer LEFT JOIN (
  SELECT user_id, count(*) FILTER (WHERE event_id % 3 <> 0) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS ok FROM events GROUP BY 1) ON user_id = c_custkey
WHERE coalesce(ok, 0) = 0""")
def _(spark, d):
    k = F.col("event_id")
    attempts = V.table(spark, d, "events").select(
        F.col("user_id").alias("listing_id"), F.when(k % 3 == 0, k % 5 + 1).alias("score"), k.alias("intento")
    )
    return W.pending_attempts(attempts, V.table(spark, d, "customer").select(F.col("c_custkey").alias("listing_id")))


AMENITIES = ["the", "tion", "eau", "sch", "que", "onen"]
UNITS = [" of ", " de "]
PRICE = r"\$|\d{4}"


def rubric(spark, d):
    scores = Q.rubric_scores("text", AMENITIES, UNITS, PRICE)
    return V.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text", scores.alias("s")).select(
        "doc_id", "lang", "n_chars", "text", "s.*"
    )


MODEL_WORDS_SQL = r"""SELECT doc_id, lang, n_chars, text,
  1 + (length(text) >= 300)::INT + (length(text) >= 1000)::INT + (len(regexp_extract_all(text, '\d+')) >= 2)::INT
    + (contains(lower(text), ' of ') OR contains(lower(text), ' de '))::INT AS completitud_informativa,
  5 - (NOT regexp_matches(text, '[.!?…]\s*$'))::INT - regexp_matches(text, '[!?*#$%&]{2,}')::INT - (text = upper(text))::INT - (length(text) < 80)::INT AS calidad_presentacion,
  1 + least(""" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in AMENITIES) + r""", 4) AS diferenciadores_amenidades,
  CASE WHEN regexp_matches(text, '\$|\d{4}') THEN 5 WHEN regexp_matches(text, '\d') THEN 3 ELSE 1 END AS transparencia_precio FROM documents"""


@entry("v24_rubric_scores", f"SELECT doc_id, {', '.join(K.QUALITY_DIMENSIONS)} FROM ({MODEL_WORDS_SQL})")
def _(spark, d):
    return rubric(spark, d).select("doc_id", *K.QUALITY_DIMENSIONS)


@entry("v25_model_equivalence", f"""
SELECT dimension, count(*) AS pares, round(avg(x), 6) AS diferencia_media, max(x)::DOUBLE AS diferencia_max, round(avg((x >= 2)::INT), 6) AS share_umbral FROM (
  SELECT unnest(['completitud_informativa', 'calidad_presentacion']) AS dimension,
    unnest([abs(completitud_informativa - (1 + quality * 4)), abs(calidad_presentacion - (1 + quality * 4))]) AS x
  FROM ({MODEL_WORDS_SQL}) JOIN labels USING (doc_id)) GROUP BY 1""")
def _(spark, d):
    columns = ["completitud_informativa", "calidad_presentacion"]
    other = V.table(spark, d, "labels").select("doc_id", *[(1 + F.col("quality") * 4).alias(c) for c in columns])
    got = W.model_equivalence(rubric(spark, d), other, "doc_id", columns, 2)
    return got.select("dimension", "pares", F.round("diferencia_media", 6).alias("diferencia_media"), "diferencia_max", F.round("share_umbral", 6).alias("share_umbral"))


@entry("v26_band_contrast", f"""
SELECT CASE WHEN completitud_informativa <= 3 THEN 'bajo' ELSE 'alto' END AS banda, count(*) AS n, round(avg((n_chars < 300)::INT), 6) AS texto_corto,
  round(avg(regexp_matches(text, '\\$|\\d{{4}}')::INT), 6) AS menciona_precio, round(avg((lang = 'en')::INT), 6) AS en_ingles
FROM ({MODEL_WORDS_SQL}) WHERE completitud_informativa <= 3 OR completitud_informativa >= 4 GROUP BY 1""")
def _(spark, d):
    got = W.band_contrast(rubric(spark, d), "completitud_informativa", 3, 4, {
        "texto_corto": F.col("n_chars") < 300, "menciona_precio": F.col("text").rlike(PRICE), "en_ingles": F.col("lang") == "en",
    })
    return got.select("banda", "n", *[F.round(c, 6).alias(c) for c in ("texto_corto", "menciona_precio", "en_ingles")])
