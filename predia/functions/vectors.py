"""Array arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from predia.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return 1 - cosine_similarity(a, b)
