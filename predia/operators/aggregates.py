"""Group reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from predia.operators.scale import exact_quantiles, top_per_group, with_stats


def group_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def group_share(df: DataFrame, *by: str) -> DataFrame:
    """Count and share of the whole per group."""
    counts = group_count(df, *by)
    totals = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / totals)


def zone_point_counts(zones: DataFrame, sources: list[DataFrame], zone: str) -> DataFrame:
    """Points per zone over several sources; zones without points count zero."""
    merged = reduce(DataFrame.unionByName, [s.select(zone) for s in sources])
    return (
        zones.select(zone).join(group_count(merged, zone), zone, "left")
        .select(zone, F.coalesce("n", F.lit(0)).alias("n"))
    )


def weighted_category_count(
    zones: DataFrame, points: DataFrame, weights: DataFrame, zone: str, category: str = "categoria"
) -> DataFrame:
    """Sum of weight times count per zone, zero where nothing counts."""
    counts = points.groupBy(zone, category).agg(F.count("*").alias("n"))
    weighted = counts.join(weights, category).groupBy(zone).agg(
        F.sum(F.col("peso") * F.col("n")).alias("conteo_ponderado")
    )
    return zones.select(zone).join(weighted, zone, "left").select(
        zone, F.coalesce("conteo_ponderado", F.lit(0.0)).alias("conteo_ponderado")
    )


def category_pivot(points: DataFrame, zone: str, category: str, values: list[str]) -> DataFrame:
    return points.groupBy(zone).agg(
        *[F.count_if(F.col(category) == v).alias(v) for v in values]
    )


def crosstab_share(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Share of each listed column value within all of a row, two decimals; long form."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    totals = with_stats(counts, [row], total=F.sum("n")).filter(F.col(column).isin(values))
    return totals.select(row, column, F.round(F.col("n") / F.col("total"), 2).alias("share"))


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keep, columns, name, value
    )


def group_medians(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Exact median per group and column plus the group size, in long form."""
    long = unpivot(df, [by], columns, "columna", "valor")
    medians = exact_quantiles(long, [by, "columna"], "valor", {"mediana": 0.5})
    return medians.join(group_count(df, by), by)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    long = unpivot(df, [], columns, "columna", "valor").filter(
        F.col("valor").isNotNull() & ~F.isnan("valor")
    )
    basic = long.groupBy("columna").agg(
        F.count("*").alias("count"), F.avg("valor").alias("mean"), F.stddev_samp("valor").alias("std"),
        F.min("valor").alias("min"), F.max("valor").alias("max"),
    )
    quartiles = exact_quantiles(
        long, ["columna"], "valor", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    )
    return basic.join(quartiles, "columna")


def mean_std_count(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return unpivot(df, [by], columns, "dimension", "valor").groupBy(by, "dimension").agg(
        F.avg("valor").alias("mean"), F.stddev_samp("valor").alias("std"),
        F.count("valor").alias("count"),
    )


def mean_gap(df: DataFrame, by: str, columns: list[str], notable: float = 0.5) -> DataFrame:
    """Gap of the group means per column, given only when there are exactly two groups."""
    means = unpivot(df, [by], columns, "dimension", "valor").groupBy(by, "dimension").agg(
        F.avg("valor").alias("_mean")
    )
    gap = F.max("_mean") - F.min("_mean")
    return (
        means.groupBy("dimension")
        .agg(F.count("*").alias("grupos"), gap.alias("diferencia"))
        .filter("grupos = 2")
        .select("dimension", "diferencia", (F.col("diferencia") >= notable).alias("notable"))
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, from one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    got = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr"))
        for a, b in pairs
    ]
    return got.select(F.inline(F.array(*rows)))


def mae(real: str = "precio_real", predicted: str = "precio_predicho") -> Column:
    return F.avg(F.abs(F.col(real) - F.col(predicted)))


def mae_report(pairs: DataFrame, population: DataFrame, price: str = "price_usd") -> DataFrame:
    """MAE, and the MAE as percent of the mean price of a stated population and of the pairs."""
    base = population.agg(F.avg(price).alias("m")).scalar()
    return pairs.agg(
        F.count("*").alias("n"), mae().alias("mae"), F.avg("precio_real").alias("media_pares")
    ).select(
        "n", "mae",
        (F.col("mae") / base * 100).alias("pct_poblacion"),
        (F.col("mae") / F.col("media_pares") * 100).alias("pct_pares"),
    )


def mae_by_zone(pairs: DataFrame, reference: Column, zone: str = "zona") -> DataFrame:
    return pairs.groupBy(zone).agg(mae().alias("mae"), F.count("*").alias("n")).withColumn(
        "vs_global_pct", (F.col("mae") / reference - 1) * 100
    )


def sampling_margin(population: DataFrame, n: int, z: float = 1.96) -> DataFrame:
    """Margin of a proportion (p = 0.5) with finite-population correction."""
    size = population.agg(F.count("*").alias("poblacion"))
    big = F.col("poblacion")
    margin = F.lit(z) * F.sqrt(F.lit(0.25 / n)) * F.sqrt((big - n) / (big - 1))
    return size.select("poblacion", F.lit(n).cast("bigint").alias("muestra"), margin.alias("margen"))


def shares(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of rows per condition."""
    return df.agg(
        F.count("*").alias("n"), *[F.avg(f.cast("double")).alias(k) for k, f in flags.items()]
    )


def score_histogram(df: DataFrame, columns: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """Rows per score and dimension, zeros included."""
    counts = df.agg(*[
        F.count_if(F.col(c) == s).alias(f"{c}|{s}") for c in columns for s in range(low, high + 1)
    ])
    rows = [
        F.struct(F.lit(c).alias("dimension"), F.lit(s).cast("bigint").alias("score"), F.col(f"{c}|{s}").alias("n"))
        for c in columns for s in range(low, high + 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def load_summary(points: DataFrame) -> DataFrame:
    """Counts by label and by source, unassigned and audited rows, from one grouping-sets pass."""
    label, source = F.col("zona_etiquetada_origen"), F.col("fuente")
    grouped = points.groupingSets([[label], [source], []], label, source).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("n"),
        F.count_if(F.col("corregimiento_asignado").isNull()).alias("sin_asignar"),
        F.count_if(F.col("nota_auditoria").isNotNull()).alias("auditadas"),
    )
    kind = F.when(F.col("_g") == 1, "etiqueta").when(F.col("_g") == 2, "fuente").otherwise("total")
    return grouped.select(
        kind.alias("grupo"),
        F.coalesce("zona_etiquetada_origen", "fuente", F.lit("")).alias("valor"),
        "n", "sin_asignar", "auditadas",
    )


def top_with_rest(
    df: DataFrame, by: list[str], order: list[Column], name: Column, k: int = 5
) -> DataFrame:
    """First k names per group in order and how many more there are."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    first = top_per_group(df.withColumn("_name", name), by, order, k, "_r")
    names = first.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "_name"))), lambda s: s["_name"]).alias("primeros")
    )
    return sizes.join(names, by).withColumn("mas", F.greatest(F.col("n") - k, F.lit(0)))
