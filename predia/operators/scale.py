"""Building blocks that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from predia.session import cut


def with_stats(df: DataFrame, by: list[str], few_groups: bool = False, **stats: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregating and joining back keeps a hot group in map-side partials; a window over the
    group would sort it in one task. Without keys the totals come in as a scalar subquery.
    `few_groups` is the caller's proof that the groups are a short list, such as profiles checked
    by size; the aggregates are then broadcast and the rows stay where they are.
    """
    named = [e.alias(n) for n, e in stats.items()]
    if by:
        totals = df.groupBy(*by).agg(*named)
        return df.join(F.broadcast(totals) if few_groups else totals, by)
    totals = df.agg(F.struct(*named).alias("t")).scalar()
    return df.select("*", *[totals[n].alias(n) for n in stats])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the least by `order`; partial aggregation absorbs hot keys."""
    kept = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*kept), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")


def top_per_group(
    df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows per group; the rank filter lets Spark cut each map task to k rows first."""
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)


def running_total(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    value: Column,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Exact running sum within each group, a group being spread over many range slices.

    Rows are range-partitioned by group and order, each slice is summed on its own and the
    totals of earlier slices are added. The slices are checkpointed because they are read twice
    and must be the same rows both times. `order` must be total and the keys not null.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    placed = cut(
        df.withColumn("_v", value)
        .repartitionByRange(n, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = placed.groupBy(*by, "_slice").agg(F.sum("_v").alias("_t"))
    earlier = (
        Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by, "_slice", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before")
    )
    so_far = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("_local", F.sum("_v").over(so_far))
        .join(offsets, [*by, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_v", "_slice", "_before", "_local")
    )


def rank_all(
    df: DataFrame, by: list[str], order: list[Column], rank: str = "rank"
) -> DataFrame:
    """Rank of every row in its group, however large the group."""
    return running_total(df, by, order, F.lit(1).cast("bigint"), rank)


def exact_quantiles(
    df: DataFrame, by: list[str], column: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per probability.

    Equal values are counted together before anything is shuffled; the order statistics are then
    found from a distributed running count, so no task holds a whole group.
    """
    counts = (
        df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
        .groupBy(*by, F.col(column).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    placed = running_total(counts, by, [F.col("_value")], F.col("_n"), "_last")
    placed = with_stats(placed, by, _total=F.sum("_n"))
    first = F.col("_last") - F.col("_n") + 1
    parts, columns = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position) + 1), ("hi", F.ceil(position) + 1)):
            holds = (first <= rank) & (F.col("_last") >= rank)
            parts.append(F.max(F.when(holds, F.col("_value"))).alias(f"_{name}_{side}"))
        parts.append(F.max(position - F.floor(position)).alias(f"_{name}_f"))
        low, high, share = (F.col(f"_{name}_{s}") for s in ("lo", "hi", "f"))
        columns.append((low + (high - low) * share).alias(name))
    return placed.groupBy(*by).agg(*parts).select(*by, *columns)


def min_max_score(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    out: str = "score",
    invert: bool = False,
    flat: str = "zero",
    few_groups: bool = False,
) -> DataFrame:
    """(x - min) / (max - min) per group, or one minus it.

    `flat` says what a group with a single value gets: zero, null, or an error.
    """
    df = with_stats(df, by or [], few_groups, _lo=F.min(value), _hi=F.max(value))
    span = F.col("_hi") - F.col("_lo")
    direct = (F.col(value) - F.col("_lo")) / F.nullif(span, F.lit(0))
    if invert:
        direct = 1 - direct
    if flat == "zero":
        direct = F.when(span == 0, 0.0).otherwise(direct)
    elif flat == "error":
        direct = F.when(span == 0, F.raise_error(F.lit(f"flat group in {value}"))).otherwise(direct)
    elif flat != "null":
        raise ValueError(f"unknown flat policy {flat!r}")
    return df.withColumn(out, direct).drop("_lo", "_hi")


def carry_forward(
    df: DataFrame, by: list[str], row_no: str, columns: list[str], block_rows: int = 100_000
) -> DataFrame:
    """Fill blanks with the last value above, sheet by sheet.

    A sheet is cut into blocks of rows; blanks are filled inside the block and, for the head of a
    block, from the last value of an earlier block. Only the block summaries see a whole sheet.
    """
    block = F.floor(F.col(row_no) / block_rows)
    df = df.withColumn("_block", block)
    inside = (
        Window.partitionBy(*by, "_block").orderBy(row_no)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summaries = df.groupBy(*by, "_block").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row_no))).alias(f"_last_{c}")
            for c in columns
        ]
    )
    above = (
        Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = summaries.select(
        *by, "_block",
        *[F.last(f"_last_{c}", ignorenulls=True).over(above).alias(f"_head_{c}") for c in columns],
    )
    filled = df.join(heads, [*by, "_block"])
    for c in columns:
        filled = filled.withColumn(
            c, F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_head_{c}"))
        )
    return filled.drop("_block", *[f"_head_{c}" for c in columns])
