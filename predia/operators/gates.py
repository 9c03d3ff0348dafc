"""Data-quality gates: each returns a report; require() turns violations into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class GateError(ValueError):
    """A gate found violations."""


def require(report: DataFrame, name: str, violations: str = "violaciones") -> None:
    bad = report.filter(F.col(violations) > 0).limit(20).collect()
    if bad:
        raise GateError(f"{name}: {[r.asDict() for r in bad]}")


def row_count(df: DataFrame, expected: int | Column | None = None) -> DataFrame:
    """Violation when the count differs from `expected`, a number or a scalar subquery, or is zero when none is given."""
    counted = df.agg(F.count("*").alias("filas"))
    wrong = (F.col("filas") != expected) if expected is not None else (F.col("filas") == 0)
    return counted.select("filas", wrong.cast("bigint").alias("violaciones"))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, from one pass; as in SQL, a null result breaks no rule."""
    sums = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    rows = [F.struct(F.lit(n).alias("regla"), F.col(n).alias("violaciones")) for n in rules]
    return sums.select(F.inline(F.array(*rows)))


def in_set(column: str, values: list) -> Column:
    return F.col(column).isin(values)


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def exactly_one(*columns: str) -> Column:
    given = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return given == 1


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once."""
    return (
        df.groupBy(*keys).count().filter("count > 1")
        .agg(F.count("*").alias("violaciones"))
        .select(F.lit("unico:" + ",".join(keys)).alias("regla"), "violaciones")
    )


def foreign_key(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-null values without a parent row."""
    missing = df.filter(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )
    return missing.agg(F.count("*").alias("violaciones")).select(
        F.lit(f"referencia:{column}").alias("regla"), "violaciones"
    )


def vector_size(df: DataFrame, column: str, size: int) -> DataFrame:
    wrong = F.coalesce(F.size(column), F.lit(-1)) != size
    return df.agg(F.count("*").alias("filas"), F.count_if(wrong).alias("violaciones"))


def unmatched_keys(updates: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Update rows whose key the base does not have."""
    return updates.join(base.select(key), key, "left_anti")


def declared_counts(
    declared: DataFrame, actual: DataFrame, by: str, expected: str = "n_ground_truth"
) -> DataFrame:
    """Declared against real counts per group, groups of either side included."""
    counted = actual.groupBy(by).agg(F.count("*").alias("reales"))
    return (
        declared.select(by, expected).join(counted, by, "full")
        .select(
            by, F.coalesce(expected, F.lit(0)).alias("declarados"),
            F.coalesce("reales", F.lit(0)).alias("reales"),
        )
        .withColumn("violaciones", (F.col("declarados") != F.col("reales")).cast("bigint"))
    )


def close_to(
    df: DataFrame, measures: dict[str, tuple[Column, float]], tolerance: float
) -> DataFrame:
    """Aggregates against reference values within a tolerance."""
    got = df.agg(*[e.alias(n) for n, (e, _) in measures.items()])
    rows = [
        F.struct(
            F.lit(n).alias("medida"), F.col(n).cast("double").alias("valor"),
            F.lit(float(reference)).alias("referencia"),
            F.coalesce((F.abs(F.col(n) - reference) > tolerance).cast("bigint"), F.lit(1).cast("bigint"))
            .alias("violaciones"),
        )
        for n, (_, reference) in measures.items()
    ]
    return got.select(F.inline(F.array(*rows)))


def weights_sum(weights: DataFrame, column: str = "peso", tolerance: float = 1e-9) -> DataFrame:
    return weights.agg(
        F.sum(column).alias("suma"),
        (F.abs(F.sum(column) - 1) > tolerance).cast("bigint").alias("violaciones"),
    )


def drift(
    df: DataFrame, column: str, reference: dict[str, float], points: float
) -> DataFrame:
    """Share per category against a reference share, in points, flagged beyond a limit.

    Categories that only one side has count as 0 on the other, so an unknown one (null included) is
    reported.
    """
    found = df.groupBy(column).agg(F.count("*").alias("n")).withColumn("r", F.lit(0.0))
    held = df.sparkSession.createDataFrame(
        [(name, 0, share * 100) for name, share in reference.items()], f"{column} string, n bigint, r double"
    )
    both = found.unionByName(held).groupBy(column).agg(F.sum("n").alias("n"), F.sum("r").alias("pct_referencia"))
    total = df.agg(F.nullif(F.count("*"), F.lit(0)).alias("t")).scalar()
    shares = both.select(column, "n", (F.col("n") / total * 100).alias("pct"), "pct_referencia")
    delta = F.coalesce(F.col("pct"), F.lit(0.0)) - F.col("pct_referencia")
    return shares.withColumn("delta", delta).withColumn(
        "violaciones", (F.abs(delta) > points).cast("bigint")
    )


def aligned(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose value differs between two tables, or that only one of them has."""
    a = left.select(key, F.col(column).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(key, F.col(column).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, key, "full")
    return joined.agg(
        F.count("*").alias("claves"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("sin_pareja"),
        F.count_if(
            F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
            & ~F.col("_a").eqNullSafe(F.col("_b"))
        ).alias("violaciones"),
    )
