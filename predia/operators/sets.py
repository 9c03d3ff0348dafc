"""Unions, differences and overlaps of keyed sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_labelled(frames: dict[str, DataFrame], label: str = "origen") -> DataFrame:
    return union_all([df.withColumn(label, F.lit(name)) for name, df in frames.items()])


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def split_report(whole: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Rows in both parts and rows of the whole in neither, from one tagged union."""
    tagged = union_labelled(
        {"todo": whole.select(key), "train": train.select(key), "test": test.select(key)}, "parte"
    )
    per_key = tagged.groupBy(key).agg(
        *[F.max((F.col("parte") == p).cast("int")).alias(p) for p in ("todo", "train", "test")]
    )
    return per_key.agg(
        F.count_if((F.col("train") == 1) & (F.col("test") == 1)).alias("en_ambos"),
        F.count_if((F.col("todo") == 1) & (F.col("train") == 0) & (F.col("test") == 0)).alias("en_ninguno"),
        F.count_if((F.col("todo") == 0)).alias("ajenos"),
    )
