"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions.hashing import seeded_key
from predia.operators import filters as P, scale as X, sets as S
from predia.operators.catalogue import copies_filter
from predia.operators.overlap import overlap, overlap_table
from predia.plans import matching as M, valuation as W, views as V
from predia.registry import entry
from predia.registry.catalogue import copies, copies_sql
from predia.registry.filtering import PROFILE_MATCH
from predia.registry.joining import probe_sql, probes
from predia.registry.sql import sql
from predia.session import cut, scratch_path
from predia.sources.readers import read_partitioned_csv


def zone_density(spark, d):
    return V.customer_stats(spark, d).withColumn("densidad", F.col("poblacion") / F.col("superficie_km2"))


@entry("w1_min_max", sql("""
SELECT nombre, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 9) AS score FROM (SELECT nombre, poblacion / superficie_km2 AS x FROM customer_stats)"""))
def _(spark, d):
    return X.min_max_score(zone_density(spark, d), "densidad").select("nombre", F.round("score", 9).alias("score"))


@entry("w2_min_max_inverted", sql("""
SELECT nombre, round(1 - (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 9) AS score FROM (SELECT nombre, poblacion / superficie_km2 AS x FROM customer_stats)"""))
def _(spark, d):
    return X.min_max_score(zone_density(spark, d), "densidad", invert=True).select("nombre", F.round("score", 9).alias("score"))


@entry("w3_min_max_per_group", sql("""
SELECT listing_id, round(CASE WHEN hi = lo THEN 0 ELSE (price_usd - lo) / (hi - lo) END, 9) AS score FROM (
  SELECT *, min(price_usd) OVER (PARTITION BY tipo_inmueble) AS lo, max(price_usd) OVER (PARTITION BY tipo_inmueble) AS hi FROM listing)"""))
def _(spark, d):
    return X.min_max_score(V.listing(spark, d), "price_usd", ["tipo_inmueble"]).select("listing_id", F.round("score", 9).alias("score"))


@entry("w4_page_with_total", sql("""
, f AS (SELECT * FROM listing WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable AND bedrooms >= 3)
SELECT listing_id, corregimiento, price_usd, (SELECT count(*) FROM f) AS total FROM f ORDER BY price_usd, listing_id LIMIT 20 OFFSET 40""").replace("\n\n, f AS", ",\nf AS"))
def _(spark, d):
    found = P.structured_search(V.listing(spark, d), habitaciones_min=3).select("listing_id", "corregimiento", "price_usd")
    return P.page(found, 20, 40)


@entry("w5_top_k_by_distance", sql("""
SELECT listing_id, round(distancia, 6) AS distancia FROM (SELECT listing_id, abs(price_usd - 250000) AS distancia FROM listing) ORDER BY distancia, listing_id LIMIT 25"""))
def _(spark, d):
    df = V.listing(spark, d).select("listing_id", F.abs(F.col("price_usd") - 250000).alias("distancia"))
    return df.orderBy("distancia", "listing_id").limit(25).withColumn("distancia", F.round("distancia", 6))


@entry("w6_ranking_per_group", sql("""
SELECT corregimiento, listing_id, row_number() OVER (PARTITION BY corregimiento ORDER BY bathrooms DESC, listing_id) AS rank FROM listing"""))
def _(spark, d):
    df = V.listing(spark, d).select("corregimiento", "listing_id", "bathrooms")
    return X.rank_all(df, ["corregimiento"], [F.desc("bathrooms"), F.col("listing_id")]).select("corregimiento", "listing_id", "rank")


@entry("w7_random_rows_per_group", sql("""
SELECT corregimiento, listing_id FROM (SELECT corregimiento, listing_id, row_number() OVER (PARTITION BY corregimiento ORDER BY md5(listing_id || '_42'), listing_id) AS r FROM listing) WHERE r <= 3"""))
def _(spark, d):
    df = V.listing(spark, d).select("corregimiento", "listing_id")
    return X.top_per_group(df, ["corregimiento"], [seeded_key("listing_id"), F.col("listing_id")], 3).drop("rank")


@entry("w8_seeded_sample", sql("SELECT listing_id FROM listing ORDER BY md5(listing_id || '_42'), listing_id LIMIT 150"))
def _(spark, d):
    return V.listing(spark, d).select("listing_id").orderBy(seeded_key("listing_id"), "listing_id").limit(150)


@entry("w9_nulls_last", sql("""
SELECT listing_id, coalesce(area_m2, -1) AS area_m2, row_number() OVER (ORDER BY area_m2 DESC NULLS LAST, listing_id) AS pos FROM listing"""))
def _(spark, d):
    df = V.listing(spark, d).select("listing_id", "area_m2")
    ranked = X.rank_all(df, [], [F.desc_nulls_last("area_m2"), F.col("listing_id")], "pos")
    return ranked.select("listing_id", F.coalesce("area_m2", F.lit(-1.0)).alias("area_m2"), "pos")


@entry("w10_rows_with_copies", copies_sql("SELECT listing_id, row_no FROM copia WHERE listing_id IN (SELECT listing_id FROM copia GROUP BY 1 HAVING count(*) > 1)"))
def _(spark, d):
    return copies_filter(copies(spark, d), "listing_id").select("listing_id", "row_no")


@entry("u1_union_zone_files", sql("SELECT corregimiento_archivo, count(*) AS n FROM listing GROUP BY 1"))
def _(spark, d):
    """The zone files as written by S1's layout, whatever zones there are, read as one table."""
    path = scratch_path(spark, "zonas")
    V.listing(spark, d).select("listing_id", "title", "corregimiento_archivo").write.partitionBy("corregimiento_archivo").option("header", True).csv(path)
    files = read_partitioned_csv(spark, path, "listing_id bigint, title string")
    return files.groupBy("corregimiento_archivo").agg(F.count("*").alias("n"))


@entry("u2_union_with_origin", """
SELECT 'previo' AS origen, doc_id AS id FROM labels UNION ALL SELECT 'nuevo', vec_id FROM embeddings""")
def _(spark, d):
    return S.union_labelled({
        "previo": V.table(spark, d, "labels").select(F.col("doc_id").alias("id")),
        "nuevo": V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")),
    }).select("origen", "id")


OVERLAP_SQL = """s AS (SELECT p.perfil, count(m.listing_id) AS n FROM profile p LEFT JOIN m ON m.perfil = p.perfil GROUP BY 1),
c AS (SELECT x.perfil AS pa, y.perfil AS pb, count(*) AS n FROM m x JOIN m y ON x.listing_id = y.listing_id AND x.perfil < y.perfil GROUP BY 1, 2)
SELECT a.perfil AS perfil_a, b.perfil AS perfil_b, coalesce(c.n, 0) AS n_interseccion,
  round(CASE WHEN a.n + b.n > 0 THEN coalesce(c.n, 0) / (a.n + b.n - coalesce(c.n, 0))::DOUBLE * 100 ELSE 0 END, 1) AS jaccard_pct,
  round(CASE WHEN least(a.n, b.n) > 0 THEN coalesce(c.n, 0) / least(a.n, b.n)::DOUBLE * 100 ELSE 0 END, 1) AS pct_del_menor
FROM s a JOIN s b ON a.perfil < b.perfil LEFT JOIN c ON c.pa = a.perfil AND c.pb = b.perfil"""


@entry("u3_overlap", sql(", m AS (SELECT p.perfil, l.listing_id " + PROFILE_MATCH.replace("listing_text", "listing") + "),\n" + OVERLAP_SQL).replace("\n, m AS", ",\nm AS"))
def _(spark, d):
    members = M.rule_matches(V.listing(spark, d), M.profile_table(spark, V.PROFILES))
    return overlap(members, [p["perfil"] for p in V.PROFILES])


@entry("u3_customer_overlap", sql("""
, m AS (SELECT c_custkey AS perfil, listing_id FROM customer JOIN listing ON corregimiento = 'NATION_' || c_nationkey
  AND price_usd <= c_acctbal * 40 AND (c_custkey % 5 = 0 OR bedrooms >= c_custkey % 5)),
p AS (SELECT a.perfil, count(*) AS n FROM m a JOIN m b ON a.listing_id = b.listing_id AND a.perfil <> b.perfil GROUP BY a.perfil, b.perfil)
SELECT perfil::VARCHAR AS perfil, count(*) AS perfiles_afines, max(n) AS mayor_interseccion, sum(n)::BIGINT AS suma FROM p GROUP BY 1""").replace("\n, m AS", ",\nm AS"))
def _(spark, d):
    """Every customer's matches against every other's."""
    k = F.col("c_custkey")
    nothing = F.lit(None).cast("double")
    profiles = V.table(spark, d, "customer").select(
        k.cast("string").alias("perfil"), F.array(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("corregimientos"),
        (F.col("c_acctbal") * 40).cast("double").alias("price_usd_max"), F.nullif(k % 5, F.lit(0)).cast("double").alias("bedrooms_min"),
        *[nothing.alias(c) for c in ("price_usd_min", "bedrooms_max", "area_m2_min", "area_m2_max")])
    # A few bytes per listing become many matches below, and are read twice, so they are spread evenly and kept.
    spread = cut(V.listing(spark, d).select("listing_id", "corregimiento", *M.RULE_COLUMNS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = overlap_table(M.rule_matches(spread, profiles).select("perfil", "listing_id", "corregimiento"), near="corregimiento")
    both = pairs.select(F.explode(F.array("perfil_a", "perfil_b")).alias("perfil"), "n_interseccion")  # one pass over the pairs
    return both.groupBy("perfil").agg(
        F.count("*").alias("perfiles_afines"), F.max("n_interseccion").alias("mayor_interseccion"), F.sum("n_interseccion").alias("suma"))


@entry("u4_missing_keys", "SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    required = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return S.missing_keys(required, V.table(spark, d, "documents").select(F.col("doc_id").alias("k")), "k")


@entry("u5_split_report", sql("""
SELECT count(*) FILTER (WHERE listing_id % 3 <> 0 AND listing_id % 5 = 0) AS en_ambos, count(*) FILTER (WHERE listing_id % 3 = 0 AND listing_id % 5 <> 0) AS en_ninguno,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT listing_id FROM listing)) AS ajenos FROM listing"""))
def _(spark, d):
    """A split with rows in both parts, in none, and rows that are no listing."""
    df = V.listing(spark, d).select("listing_id")
    strays = V.table(spark, d, "labels").select(F.col("doc_id").alias("listing_id")).join(df, "listing_id", "left_anti")
    train = df.filter("listing_id % 3 <> 0").unionByName(strays)
    return S.split_report(df, train, df.filter("listing_id % 5 = 0"), "listing_id")
