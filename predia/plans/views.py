"""Listing, zone, point and query tables derived from a general sales star schema.

These let every operator run over whole tables of `orders`, `lineitem`, `documents` and so on;
a user with real listings passes their own frames instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from predia import constants as K
from predia.functions.pricing import price_problem
from predia.functions.text import operation_of

MODEL_TYPE = "BUILDING"
POOL_EXCLUDED = ["NATION_7", "NATION_8"]
RENT_WORDS = ["5-low"]
EXCLUDED_WORDS = ["machinery", "1-urgent"]
POI_CATEGORIES = K.RAW_CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order that has lines; nation 24 plays the unknown zone."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("l_suppkey").alias("ns"),
            F.sum("l_quantity").alias("q"),
        )
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
    )
    title = F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "n_name")
    typed = joined.select(
        F.col("o_orderkey").alias("listing_id"),
        F.concat(F.lit("https://example.test/propiedad_p-"), F.col("o_orderkey").cast("string"), F.lit(".htm"))
        .alias("listing_url"),
        title.alias("title"),
        F.when(F.col("n_nationkey") == 24, K.UNKNOWN_ZONE).otherwise(F.col("n_name")).alias("corregimiento"),
        F.col("n_nationkey").cast("bigint").alias("zona_id"),
        F.col("r_name").alias("corregimiento_archivo"),
        F.col("c_mktsegment").alias("tipo_inmueble"),
        F.col("o_totalprice").alias("price_usd"),
        F.nullif("n", F.lit(8)).alias("bedrooms"),
        F.col("ns").alias("bathrooms"),
        F.nullif("q", F.lit(100.0)).alias("area_m2"),
        operation_of(title, RENT_WORDS).alias("operation"),
        F.col("o_orderdate").alias("scraped_at"),
        F.col("o_orderstatus").alias("estado"),
    )
    problem = price_problem("price_usd", "area_m2", "operation")
    return typed.withColumn("precio_no_evaluable", problem != "").withColumn(
        "precio_no_evaluable_motivo", problem
    )


def _modulo_key(df: DataFrame, key: str, size: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(key), size.agg(F.count("*").alias("n")).scalar()))


def listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a document as description; short documents count as none or preview."""
    documents = table(spark, sf_dir, "documents")
    keyed = _modulo_key(listing(spark, sf_dir), "listing_id", documents, "doc_id")
    source = (
        F.when(F.col("n_chars") < 300, "ninguna").when(F.col("n_chars") < 1000, "preview")
        .otherwise("completa")
    )
    return keyed.join(
        documents.select(
            "doc_id", F.col("text").alias("descripcion"), source.alias("descripcion_fuente")
        ),
        "doc_id",
    )


def listing_vector(spark: SparkSession, sf_dir: str, listings: DataFrame | None = None) -> DataFrame:
    """Listings with an embedding: all, or the given ones."""
    vectors = table(spark, sf_dir, "embeddings")
    keyed = _modulo_key(listing(spark, sf_dir) if listings is None else listings, "listing_id", vectors, "vec_id")
    return keyed.join(vectors.select("vec_id", "embedding"), "vec_id")


def zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations 0-14 are official zones, 15-23 inherit from their region's first, 24 has no score."""
    nation = table(spark, sf_dir, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("primera"))
    key = F.col("n_nationkey")
    return nation.join(first, "n_regionkey").select(
        key.cast("bigint").alias("zona_id"),
        F.col("n_name").alias("nombre"),
        (key < 15).alias("es_oficial"),
        F.when((key >= 15) & (key < 24), F.col("primera")).alias("hereda_de"),
        (key == 24).alias("sin_score"),
        (key == 3).alias("oculta"),
        (F.lit(4.0) + key % 7 * 3.5).alias("superficie_km2"),
    )


def customer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per zone: population (customers) and incidents (events of kind error)."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zona_id")).agg(
        F.count("*").alias("poblacion")
    )
    errors = (
        table(spark, sf_dir, "events").filter("event_type = 'error'")
        .groupBy(F.pmod(F.col("user_id"), F.lit(25)).alias("zona_id"))
        .agg(F.count("*").alias("incidentes"))
    )
    zones = zone(spark, sf_dir)
    return (
        zones.join(people.withColumn("zona_id", F.col("zona_id").cast("bigint")), "zona_id", "left")
        .join(errors, "zona_id", "left")
        .select(
            "nombre", F.coalesce("poblacion", F.lit(0)).alias("poblacion"),
            F.coalesce("incidentes", F.lit(0)).alias("incidentes"), "superficie_km2", "es_oficial",
        )
    )


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as points of interest inside one small box."""
    def placed(df: DataFrame, key: str, name: str, label: str, source: str, prefix: int) -> DataFrame:
        k = F.col(key)
        return df.select(
            (k * 2 + prefix).alias("id"),
            k.alias("clave"),
            F.col(name).alias("nombre"),
            F.element_at(
                F.array(*[F.lit(c) for c in POI_CATEGORIES]), (k % 6 + 1).cast("int")
            ).alias("categoria"),
            (F.lit(8.9) + (k * 37 % 1000) / 5000).alias("lat"),
            (F.lit(-79.6) + (k * 91 % 1000) / 5000).alias("lng"),
            F.lit(source).alias("fuente"),
            F.concat(F.lit("NATION_"), (F.col(label) % 5).cast("string")).alias("zona_etiquetada_origen"),
            F.when(k % 4 != 0, F.round(1 + k % 40 / 10, 1)).alias("rating"),
        )

    return placed(
        table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_nationkey", "google_places", 0
    ).unionByName(
        placed(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_size", "osm_overpass", 1)
    )


def stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as transport stops spread over the same box; every 10th is a station."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (F.lit(8.88) + (k * 53 % 1201) / 5000).alias("lat"),
        (F.lit(-79.62) + (k * 71 % 1201) / 5000).alias("lng"),
        F.when(k % 10 == 0, "metro").otherwise("bus").alias("tipo"),
    )


# Shapes of the five zones that have one: three convex, one concave, one with a hole, and the
# last in two parts. Coordinates are (lng, lat) pairs.
SHAPES = {
    "NATION_0": [[[(-79.6, 8.9), (-79.53, 8.9), (-79.53, 8.98), (-79.6, 8.98)]]],
    "NATION_1": [[[(-79.53, 8.9), (-79.47, 8.9), (-79.45, 8.95), (-79.5, 8.99), (-79.53, 8.98)]]],
    "NATION_2": [[[(-79.46, 8.9), (-79.4, 8.9), (-79.4, 8.97), (-79.43, 8.93)]]],
    "NATION_3": [[[(-79.6, 8.98), (-79.5, 8.99), (-79.52, 9.03), (-79.5, 9.08), (-79.6, 9.08)]]],
    "NATION_4": [
        [
            [(-79.5, 9.0), (-79.41, 9.0), (-79.41, 9.09), (-79.5, 9.09)],
            [(-79.47, 9.03), (-79.44, 9.03), (-79.44, 9.06), (-79.47, 9.06)],
        ],
        [[(-79.42, 8.94), (-79.4, 8.98), (-79.42, 8.98)]],
    ],
}


def polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with a shape; the zone table decides which zones exist."""
    from predia.functions.geo import MULTIPOLYGON

    def value(shape):
        return F.array(*[
            F.array(*[
                F.array(*[
                    F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring
                ]) for ring in part
            ]) for part in shape
        ])

    geom = F.lit(None).cast(MULTIPOLYGON)
    for name, shape in SHAPES.items():
        geom = F.when(F.col("n_name") == name, value(shape)).otherwise(geom)
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_name").isin(list(SHAPES)))
        .select(F.col("n_name").alias("nombre"), F.col("n_nationkey").cast("bigint").alias("orden"), geom.alias("geom"))
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as free-text queries."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("consulta_id"), F.col("text").alias("consulta")
    )


# --- Fixed values: rules for the profiles of the derived tables ---
PROFILES = [
    {"perfil": "familia", "corregimientos": ["NATION_1", "NATION_4", "NATION_9"],
     "price_usd_min": 150000, "price_usd_max": 400000, "bedrooms_min": 3, "area_m2_min": 60,
     "incluye": ["the", "eau"]},
    {"perfil": "joven", "corregimientos": ["NATION_0", "NATION_5", "NATION_6", "NATION_10"],
     "price_usd_max": 300000, "bedrooms_min": 1, "bedrooms_max": 3,
     "incluye": ["onen", "sch"], "excluye": ["ción"]},
    {"perfil": "pareja", "corregimientos": ["NATION_2", "NATION_3", "NATION_11"],
     "price_usd_min": 100000, "price_usd_max": 350000, "bedrooms_min": 2, "bedrooms_max": 4,
     "incluye": ["qui", "erre"], "excluye": ["$"]},
    {"perfil": "inversion", "corregimientos": ["NATION_1", "NATION_2", "NATION_12", "NATION_13"],
     "price_usd_min": 50000, "area_m2_max": 120, "incluye": ["der", "que "]},
    {"perfil": "retiro", "corregimientos": ["NATION_4"], "bedrooms_min": 2, "bedrooms_max": 6,
     "incluye": ["tion"], "excluye": ["**"]},
    {"perfil": "ajustado", "corregimientos": ["NATION_0", "NATION_1", "NATION_2", "NATION_14"],
     "price_usd_max": 120000, "incluye": ["los", "on"]},
]
