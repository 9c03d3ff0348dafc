"""Listing filters, request checks and filter reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.functions.pricing import type_plural
from predia.functions.text import all_of


def evaluable(df: DataFrame) -> DataFrame:
    """Listings with a known zone and a usable price."""
    return df.filter((F.col("corregimiento") != K.UNKNOWN_ZONE) & ~F.col("precio_no_evaluable"))


def structured_conditions(
    zona: str | None = None,
    tipo_inmueble: str | None = None,
    precio_min: float | None = None,
    precio_max: float | None = None,
    habitaciones_min: int | None = None,
    banos_min: int | None = None,
) -> list[Column]:
    """One condition per argument given; only None means absent, 0 is a real bound."""
    conditions = []
    if zona is not None:
        conditions.append(F.col("corregimiento") == zona)
    if tipo_inmueble is not None:
        conditions.append(
            F.col("tipo_inmueble") == K.TYPE_PLURAL.get(tipo_inmueble, tipo_inmueble)
        )
    for bound, column, floor in (
        (precio_min, "price_usd", True),
        (precio_max, "price_usd", False),
        (habitaciones_min, "bedrooms", True),
        (banos_min, "bathrooms", True),
    ):
        if bound is not None:
            conditions.append(F.col(column) >= bound if floor else F.col(column) <= bound)
    return conditions


def structured_search(df: DataFrame, **criteria) -> DataFrame:
    return evaluable(df).filter(all_of(structured_conditions(**criteria)))


def matches_request(request: str = "") -> Column:
    """The same filters for a table of requests joined to listings; a null bound is no bound."""
    r = (lambda c: F.col(f"{request}.{c}")) if request else F.col

    def bound(c: Column, test: Column) -> Column:
        return c.isNull() | F.coalesce(test, F.lit(False))

    return all_of([
        bound(r("zona"), F.col("corregimiento") == r("zona")),
        bound(
            r("tipo_pedido"),
            F.col("tipo_inmueble") == type_plural(r("tipo_pedido")),
        ),
        bound(r("precio_min"), F.col("price_usd") >= r("precio_min")),
        bound(r("precio_max"), F.col("price_usd") <= r("precio_max")),
        bound(r("habitaciones_min"), F.col("bedrooms") >= r("habitaciones_min")),
        bound(r("banos_min"), F.col("bathrooms") >= r("banos_min")),
    ])


def reject_requests(
    requests: DataFrame, allowed: dict[str, DataFrame]
) -> DataFrame:
    """Request rows whose value is outside a closed set, with the column as reason.

    `allowed` maps a request column to a one-column table of its values; null asks for nothing.
    """
    rejected = None
    for column, values in allowed.items():
        named = values.toDF(column)
        bad = (
            requests.filter(F.col(column).isNotNull())
            .join(named, column, "left_anti")
            .select(*requests.columns)
            .withColumn("motivo", F.lit(f"{column} inválido"))
        )
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return rejected


def model_pool(
    df: DataFrame,
    excluded_zones: list[str] | None = None,
    model_type: str = K.MODEL_TYPE,
) -> DataFrame:
    """Rows the price models may train on."""
    return df.filter(all_of([c for _, c in pool_steps(excluded_zones, model_type)]))


def pool_steps(
    excluded_zones: list[str] | None = None, model_type: str = K.MODEL_TYPE
) -> list[tuple[str, Column]]:
    excluded = K.EXCLUDED_MODEL_ZONES if excluded_zones is None else excluded_zones
    return [
        ("zona_conocida", F.col("corregimiento") != K.UNKNOWN_ZONE),
        ("precio_evaluable", ~F.col("precio_no_evaluable")),
        ("zona_en_pool", ~F.col("corregimiento").isin(excluded)),
        ("tipo_en_pool", F.col("tipo_inmueble") == model_type),
        ("area_conocida", F.col("area_m2").isNotNull()),
    ]


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows kept and dropped after each step, from one pass over the table."""
    passed, sums = F.lit(True), [F.count("*").alias("k0")]
    for i, (_, condition) in enumerate(steps, start=1):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(passed).alias(f"k{i}"))
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("orden"),
            F.lit(name).alias("paso"),
            F.col(f"k{i}").alias("quedan"),
            (F.col(f"k{i - 1}") - F.col(f"k{i}")).alias("descartadas"),
        )
        for i, (name, _) in enumerate(steps, start=1)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def scoring_eligible(
    df: DataFrame, zones: list[str] | None = None, model_type: str = K.MODEL_TYPE
) -> DataFrame:
    """Rows a scoring batch takes: zone and type in the pool, usable price, area above zero."""
    return df.filter(
        F.col("corregimiento").isin(K.MODEL_ZONES if zones is None else zones)
        & (F.col("tipo_inmueble") == model_type)
        & F.col("area_m2").isNotNull() & (F.col("area_m2") > 0)
        & ~F.col("precio_no_evaluable")
        & F.col("price_usd").isNotNull()
    )


def refine(
    df: DataFrame,
    zona: str | None = None,
    tipo: str | None = None,
    rooms: int = 0,
    light: str | None = None,
) -> DataFrame:
    """Narrow a result set; unknown rooms count as none and a chosen light needs a light."""
    conditions = []
    if zona:
        conditions.append(F.col("corregimiento") == zona)
    if tipo:
        conditions.append(F.col("tipo_inmueble") == K.TYPE_PLURAL.get(tipo, tipo))
    if rooms > 0:
        conditions.append(F.coalesce(F.col("bedrooms"), F.lit(0)) >= rooms)
    if light is not None:
        conditions.append(F.coalesce(F.col("categoria_semaforo") == light, F.lit(False)))
    return df.filter(all_of(conditions))


def page(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page by price then id, every row carrying the total under the same filter."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset at least 0")
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy("price_usd", "listing_id").offset(offset).limit(limit)
    return rows.withColumn("total", total)
