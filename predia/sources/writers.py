"""Table sinks: plain, checked before publishing, and column updates by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from predia.operators.gates import GateError
from predia.session import scratch_path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_checked(df: DataFrame, path: str, checks: list[Callable[[DataFrame], None]]) -> DataFrame:
    """Replace a table only if the new one passes every check; else the old one stays as it is.

    The rows are written to a staging folder first and the checks read what was written, so what was
    checked is what is published, and nothing is computed twice. Publishing is Spark's own overwrite; if
    it is cut short, the checked rows are still in the staging folder and the load is repeated.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    df.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    for check in checks:
        check(rows)
    write_table(rows, path)
    return spark.read.schema(df.schema).parquet(path)


def update_column(base: DataFrame, updates: DataFrame, key: str, column: str, strict: bool = True) -> DataFrame:
    """Base with one column replaced where `updates` has the key.

    Unknown or repeated keys among the updates are an error before anything is written; without
    `strict` unknown ones are left out and keys must be unique.
    """
    if strict:
        check_update(base, updates, key)
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)) if column in base.columns else F.col("_new")
    return base.join(new, key, "left").withColumn(column, value).drop("_new", "_hit")


def check_update(base: DataFrame, updates: DataFrame, key: str) -> None:
    """Error if an update names an unknown key or names a key twice."""
    unknown = updates.join(base.select(key), key, "left_anti")
    twice = updates.groupBy(key).count().filter("count > 1")
    bad = unknown.agg(F.count("*").alias("n")).first()["n"], twice.agg(F.count("*").alias("n")).first()["n"]
    if any(bad):
        raise GateError(f"{bad[0]} unmatched and {bad[1]} repeated keys")
