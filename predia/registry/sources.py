"""Sources and sinks: tables are written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.operators import gates as G
from predia.plans import views as V
from predia.registry import entry
from predia.registry.sql import sql
from predia.session import scratch_path
from predia.sources import readers as R, writers as O

LISTING_FILE = "listing_id bigint, title string, price_usd double, bedrooms bigint, scraped_at timestamp"


@entry("s1_listing_csv", sql("""
SELECT listing_id, title, price_usd, coalesce(bedrooms, -1) AS bedrooms, corregimiento_archivo FROM listing"""))
def _(spark, d):
    path = scratch_path(spark, "csv")
    V.listing(spark, d).select(
        "listing_id", "title", "price_usd", "bedrooms", "scraped_at", "corregimiento_archivo"
    ).write.partitionBy("corregimiento_archivo").option("header", True).csv(path)
    back = R.read_partitioned_csv(spark, path, LISTING_FILE)
    return back.select("listing_id", "title", "price_usd", F.coalesce("bedrooms", F.lit(-1)).alias("bedrooms"), "corregimiento_archivo")


@entry("s2_json_array", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    """Arrays of at most one bucket of records each, read in splits."""
    path = scratch_path(spark, "json")
    record = F.to_json(F.struct("event_id", "event_type", "value"))
    bucket = F.floor(F.col("event_id") / 20_000)
    arrays = V.table(spark, d, "events").groupBy(bucket.alias("b")).agg(F.collect_list(record).alias("r"))
    # A file holds one array, so each array is one line of its own file.
    arrays.select(F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_large_json_array(spark, path, "event_id bigint, event_type string, value double").select("event_id", "event_type", "value")


@entry("s3_json_lines", sql("SELECT id, nombre, categoria, round(lat, 6) AS lat FROM poi"))
def _(spark, d):
    path = scratch_path(spark, "jsonl")
    poi = V.poi(spark, d).select("id", "nombre", "categoria", "lat", "lng")
    # Every other line is blank, as hand-kept files have them.
    poi.select(F.concat(F.to_json(F.struct(*poi.columns)), F.lit("\n")).alias("value")).write.text(path)
    return R.read_json_lines(spark, path, "id bigint, nombre string, categoria string, lat double, lng double").select(
        "id", "nombre", "categoria", F.round("lat", 6).alias("lat")
    )


@entry("s4_geojson", sql("SELECT nombre, categoria, fuente, round(lng, 6) AS lng FROM poi"))
def _(spark, d):
    path = scratch_path(spark, "geojson")
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("nombre").alias("name"), "categoria", "fuente").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
    ))
    collections = V.poi(spark, d).groupBy(F.floor(F.col("id") / 20_000).alias("b")).agg(F.collect_list(feature).alias("f"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join("f", ","), F.lit("]}"))
    collections.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = R.read_large_geojson(spark, path)
    lng = F.from_json("coordenadas", "array<double>")[0]
    return rows.select(
        F.col("propiedades")["name"].alias("nombre"), F.col("propiedades")["categoria"].alias("categoria"),
        F.col("propiedades")["fuente"].alias("fuente"), F.round(lng, 6).alias("lng"),
    )


@entry("s5_pagination_log", """
SELECT l_linenumber::BIGINT AS pagina, CASE WHEN l_quantity > 5 THEN 'OK' ELSE 'FALLO' END AS resultado, l_quantity::BIGINT AS tarjetas FROM lineitem""")
def _(spark, d):
    path = scratch_path(spark, "log")
    V.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("pagina"), F.when(F.col("l_quantity") > 5, "OK").otherwise("FALLO").alias("resultado"),
        F.col("l_quantity").cast("bigint").alias("tarjetas"),
    ).write.option("header", True).csv(path)
    return R.read_pagination_log(spark, path).select("pagina", "resultado", "tarjetas")


@entry("s6_prediction_pairs", sql("""
SELECT listing_id AS propiedad_id, price_usd AS precio_real, round(price_usd * 1.1, 4) AS precio_predicho, corregimiento AS zona FROM listing"""))
def _(spark, d):
    path = scratch_path(spark, "pares")
    V.listing(spark, d).select(
        F.col("listing_id").alias("propiedad_id"), F.col("price_usd").alias("precio_real"),
        F.round(F.col("price_usd") * 1.1, 4).alias("precio_predicho"), F.col("corregimiento").alias("zona"),
    ).write.option("header", True).csv(path)
    return R.read_pairs(spark, path)


@entry("s7_table_sink", sql("SELECT corregimiento, count(*) AS n, round(sum(price_usd), 2) AS total FROM listing GROUP BY 1"))
def _(spark, d):
    path = scratch_path(spark, "tabla")
    O.write_table(V.listing(spark, d).select("listing_id", "price_usd", "corregimiento"), path, ["corregimiento"])
    return spark.read.parquet(path).groupBy("corregimiento").agg(F.count("*").alias("n"), F.round(F.sum("price_usd"), 2).alias("total"))


@entry("s8_atomic_load", sql("SELECT listing_id, price_usd FROM listing"))
def _(spark, d):
    rows = V.listing(spark, d).select("listing_id", "price_usd")
    return O.load_checked(rows, scratch_path(spark, "carga"), [
        lambda t: G.require(G.row_count(t), "no vacía"),
        lambda t: G.require(G.unique_key(t, ["listing_id"]), "clave única"),
    ])


@entry("s9_update_column", sql("""
SELECT l.listing_id, coalesce(q.quality, -1) AS quality, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT listing_id FROM listing)) AS claves_sin_fila
FROM listing l LEFT JOIN labels q ON q.doc_id = l.listing_id"""))
def _(spark, d):
    base = V.listing(spark, d).select("listing_id", F.lit(-1).alias("quality"))
    updates = V.table(spark, d, "labels").select(F.col("doc_id").alias("listing_id"), "quality")
    # The labels hold keys that are no listing, so the strict form would refuse them: they are counted.
    unknown = updates.join(base.select("listing_id"), "listing_id", "left_anti").agg(F.count("*").alias("n")).scalar()
    return O.update_column(base, updates, "listing_id", "quality", strict=False).withColumn("claves_sin_fila", unknown)
