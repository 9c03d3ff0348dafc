"""File readers. Schemas are given, so no file is read just to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from predia.sources import schemas as S
from predia.sources.json_split import elements


def read_listing_csv(spark: SparkSession, path: str, schema: str = S.LISTING_CSV, suffix: str = "_listings.csv") -> DataFrame:
    """Listing CSVs, each row tagged with the name of its file."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
        .withColumn("corregimiento_archivo", F.replace(name, F.lit(suffix), F.lit("")))
    )


def read_partitioned_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Listing CSVs kept one folder per zone (corregimiento_archivo=...)."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files each holding one JSON array of records; a file is read by one task and should fit it
    (some hundred MB), larger ones are for `read_large_json_array`."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_large_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of `read_json_array`, each file being read in splits by many tasks."""
    return elements(spark, path, 1).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are dropped, files are split."""
    return spark.read.schema(schema).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: position, properties map, geometry type, coordinates JSON, file.

    A collection is read by one task and should fit it; larger ones are for `read_large_geojson`.
    """
    return (
        spark.read.schema(S.GEOJSON).option("multiLine", True).json(path)
        .select(F.input_file_name().alias("archivo"), F.posexplode("features").alias("orden", "f"))
        .select(
            "archivo", F.col("orden").cast("bigint").alias("orden"), F.col("f.properties").alias("propiedades"),
            F.col("f.geometry.type").alias("tipo_geometria"), F.col("f.geometry.coordinates").alias("coordenadas"),
        )
    )


def read_large_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `read_geojson`, each file being read in splits by many tasks."""
    return elements(spark, path, 2).withColumn("f", F.from_json("value", S.FEATURE)).select(
        F.col("file").alias("archivo"), "orden", F.col("f.properties").alias("propiedades"),
        F.col("f.geometry.type").alias("tipo_geometria"), F.col("f.geometry.coordinates").alias("coordenadas"),
    )


def read_pagination_log(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(S.PAGINATION_LOG).option("header", True).csv(path).withColumn("archivo", name)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Prediction pairs; an empty file is an error when the job runs."""
    pairs = spark.read.schema(S.PREDICTION_PAIRS).option("header", True).csv(path)
    # A one-row check is unioned in: it adds no row, but fails the job when there are none.
    probe = pairs.agg(F.count("*").alias("_n")).select(
        F.when(F.col("_n") == 0, F.raise_error(F.lit("prediction pairs are empty"))).otherwise(F.col("_n")).alias("_n")
    ).filter("_n < 0")
    nothing = probe.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema])
    return pairs.unionByName(nothing)
