"""Price rules and traffic lights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from predia import constants as K
from predia.functions.text import col


def price_per_m2(price: str | Column, area: str | Column) -> Column:
    return F.when(col(area) > 0, col(price) / col(area))


def price_problem(price: str | Column, area: str | Column, operation: str | Column) -> Column:
    """Empty string for a usable price, else the reason it is not."""
    sale = col(operation) == "venta"
    floor = F.when(sale, K.SALE_FLOOR).otherwise(K.RENT_FLOOR)
    low, high = K.PRICE_M2_RANGE
    per_m2 = price_per_m2(price, area)
    return (
        F.when(col(price).isNull() | (col(price) < floor), K.REASON_FLOOR)
        .when(sale & ~per_m2.between(low, high), K.REASON_M2)
        .otherwise("")
    )


def light_by_mae(
    residual: str | Column, multiple: float = K.MAE_MULTIPLE, mae: float | Column = K.MAE_REFERENCE
) -> Column:
    """Red or green only strictly beyond the threshold; null without a residual."""
    threshold = F.lit(multiple) * (mae if isinstance(mae, Column) else F.lit(mae))
    r = col(residual)
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r > threshold, "rojo")
        .when(r < -threshold, "verde")
        .otherwise("amarillo")
    )


def light_by_share(difference: str | Column, width: float = 0.10) -> Column:
    """Red or green from the bound on, inclusive."""
    d = col(difference)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(d <= -width, "verde")
        .when(d >= width, "rojo")
        .otherwise("amarillo")
    )


def type_plural(kind: str | Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in K.TYPE_PLURAL.items() for x in pair])
    return F.coalesce(mapping[col(kind)], col(kind))


def model_coverage(
    zone: str | Column,
    kind: str | Column,
    zones: list[str] | None = None,
    model_type: str = K.MODEL_TYPE,
) -> Column:
    """Struct (cubierto, motivo): null while zone or type is unknown."""
    zone, kind = col(zone), col(kind)
    zones = K.MODEL_ZONES if zones is None else zones
    outside_zone = F.when(
        ~zone.isin(zones), F.concat(F.lit("'"), zone, F.lit("' no entra en el modelo de precio"))
    )
    outside_type = F.when(
        type_plural(kind) != model_type,
        F.concat(F.lit("tipo_inmueble '"), kind, F.lit("' no entra en el modelo de precio")),
    )
    known = zone.isNotNull() & kind.isNotNull()
    reasons = F.concat_ws("; ", outside_zone, outside_type)
    return F.struct(
        F.when(known, reasons == "").alias("cubierto"),
        F.when(known & (reasons != ""), reasons).alias("motivo"),
    )


def cluster_label(cluster: str | Column, labels: dict[int, str] | None = None) -> Column:
    c = col(cluster)
    out = F.when(c.isNull(), K.NO_CLUSTER)
    for key, label in (K.CLUSTER_LABELS if labels is None else labels).items():
        out = out.when(c == key, label)
    return out.otherwise(
        F.concat(F.lit("Segmento desconocido (cluster_id="), c.cast("string"), F.lit(")"))
    )
