"""Price valuation by comparables: neighbours, estimate, traffic light, error reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.functions.hashing import seeded_bucket
from predia.functions.pricing import light_by_mae
from predia.operators.aggregates import mae, mae_by_zone
from predia.operators.nearest import nearest_join
from predia.operators.scale import exact_quantiles

NUMERIC = ["bedrooms", "bathrooms", "area_m2"]


def with_split(df: DataFrame, test_share: float = 0.2, folds: int = 5, seed: int = K.SEED) -> DataFrame:
    """Repeatable split by id hash: `es_train`, and a fold number for cross validation."""
    bucket = seeded_bucket("listing_id", 100, seed)
    return df.withColumn("es_train", bucket < round(100 * (1 - test_share))).withColumn(
        "pliegue", seeded_bucket("listing_id", folds, f"{seed}k")
    )


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str = "zona") -> DataFrame:
    """One 0/1 column per value, in the given order; unknown values give all zeros."""
    return df.select(
        "*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]
    )


def scaling(train: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per column, one row."""
    columns = columns or NUMERIC
    return train.agg(
        *[F.avg(c).alias(f"{c}_media") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_desv") for c in columns],
    )


def standardise(df: DataFrame, train: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Centred and scaled copies (`_z`) of the columns, scaled on the training rows."""
    columns = columns or NUMERIC
    stats = scaling(train, columns)
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.select(
        "*",
        *[
            ((F.col(c) - packed[f"{c}_media"]) / F.nullif(packed[f"{c}_desv"], F.lit(0.0))).alias(f"{c}_z")
            for c in columns
        ],
    )


def inverse_variances(train: DataFrame, columns: list[str] | None = None) -> list[float]:
    """Feature weights equal to standardising first; a constant column weighs nothing."""
    columns = columns or NUMERIC
    row = train.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [1 / row[c] if row[c] else 0.0 for c in columns]


def comparables(
    queries: DataFrame,
    train: DataFrame,
    k: int = K.NEIGHBOURS,
    weights: list[float] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """k nearest training listings per listing, never itself: rank, price and distance."""
    weights = weights or inverse_variances(train)
    found = nearest_join(
        queries, train, "listing_id", "listing_id", NUMERIC, k, weights=weights,
        category="corregimiento", payload=["price_usd"], exclude_self=not by, by=by,
    )
    return found.withColumnRenamed("price_usd", "vecino_precio")


def estimates(comparable: DataFrame, by: list[str] | None = None) -> DataFrame:
    return comparable.groupBy("listing_id", *(by or [])).agg(
        F.avg("vecino_precio").alias("precio_predicho"), F.count("*").alias("n_comparables")
    )


def priced(estimate: DataFrame, listings: DataFrame, k: int = K.NEIGHBOURS) -> DataFrame:
    """Estimate next to the real price; a null real price leaves the differences null."""
    real = listings.select(
        "listing_id", "corregimiento", F.col("price_usd").cast("double").alias("precio_real")
    )
    gap = F.col("precio_real") - F.col("precio_predicho")
    return estimate.join(real, "listing_id").select(
        "listing_id", "corregimiento", "precio_real", "precio_predicho", "n_comparables",
        (F.col("n_comparables") < k).alias("cobertura_insuficiente"),
        gap.alias("diferencia_absoluta"),
        (gap / F.nullif(F.col("precio_predicho"), F.lit(0.0))).alias("diferencia_porcentual"),
    )


def valuation(
    listings: DataFrame,
    train: DataFrame,
    k: int = K.NEIGHBOURS,
    multiple: float = K.MAE_MULTIPLE,
    mae_reference: float | Column = K.MAE_REFERENCE,
    weights: list[float] | None = None,
) -> DataFrame:
    """Full record per pool listing: estimate, light and diagnostics."""
    priced_rows = priced(estimates(comparables(listings, train, k, weights)), listings, k)
    reference = mae_reference if isinstance(mae_reference, Column) else F.lit(mae_reference)
    return priced_rows.select(
        "listing_id", "corregimiento", "precio_real", "precio_predicho",
        light_by_mae("diferencia_absoluta", multiple, reference).alias("categoria_semaforo"),
        reference.alias("mae_referencia"), F.lit(multiple).alias("multiplo_mae"),
        F.col("cobertura_insuficiente").alias("confianza_reducida"), "n_comparables",
        "diferencia_absoluta", "diferencia_porcentual",
    )


def failure_reason(
    zones: list[str] | None = None, excluded: list[str] | None = None, model_type: str = K.MODEL_TYPE
) -> Column:
    """Why a listing cannot be valued, null when it can. Missing attributes come first."""
    zone = F.col("corregimiento")
    outside = ~zone.isin(zones) if zones is not None else (
        zone.isin(K.EXCLUDED_MODEL_ZONES if excluded is None else excluded) | (zone == K.UNKNOWN_ZONE)
    )
    missing = F.col("bedrooms").isNull() | F.col("bathrooms").isNull() | F.col("area_m2").isNull()
    return (
        F.when(missing, "sin dormitorios, baños o superficie")
        .when(F.col("tipo_inmueble") != model_type, "tipo fuera del pool")
        .when(outside, "zona fuera del pool")
        .when(F.col("price_usd").isNull(), "sin precio real")
    )


def split_failures(listings: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that can be valued, failures with their reason)."""
    tagged = listings.withColumn("motivo", reason)
    return (
        tagged.filter(F.col("motivo").isNull()).drop("motivo"),
        tagged.filter(F.col("motivo").isNotNull()),
    )


def calibration(pairs: DataFrame, width: float = 0.10) -> DataFrame:
    """How often the percent rule's half width is below the model's own error."""
    half = F.col("precio_predicho") * width
    error = pairs.agg(mae().alias("m")).scalar()
    shares = pairs.withColumn("_half", half).withColumn("_mae", error)
    basic = shares.agg(
        F.count("*").alias("n"),
        F.avg("_half").alias("semi_ancho_medio"),
        F.max("_mae").alias("mae"),
        (F.avg((F.col("_half") < F.col("_mae")).cast("double")) * 100).alias("pct_menor_que_mae"),
    )
    median = exact_quantiles(shares, [], "_half", {"semi_ancho_mediana": 0.5})
    held = median.select("semi_ancho_mediana").scalar()
    return basic.withColumn("semi_ancho_mediana", held)


def out_of_fold(train: DataFrame, folds: int = 5, k: int = K.NEIGHBOURS) -> DataFrame:
    """Prediction of every training row from the other folds; scaled once on all training rows.

    The training set of a fold is every row of another fold, so each row goes to folds - 1
    training sets and the folds become an equality key of one neighbour join.
    """
    others = F.filter(
        F.array(*[F.lit(i).cast("bigint") for i in range(folds)]), lambda f: f != F.col("pliegue")
    )
    refs = train.withColumn("pliegue", F.explode(others))
    found = comparables(train, refs, k, inverse_variances(train), by=["pliegue"])
    predicted = estimates(found, by=["pliegue"])
    return predicted.join(
        train.select("listing_id", F.col("corregimiento").alias("zona"), F.col("price_usd").alias("precio_real")),
        "listing_id",
    )


def cv_errors(oof: DataFrame) -> DataFrame:
    """MAE per fold; the mean over folds is the usual CV figure."""
    per_fold = oof.groupBy("pliegue").agg(F.count("*").alias("n"), mae().alias("mae"))
    mean = per_fold.agg(F.avg("mae").alias("m")).scalar()
    return per_fold.withColumn("mae_promedio", mean)


def oof_by_zone(oof: DataFrame) -> DataFrame:
    """MAE per zone against the mean of the fold errors."""
    per_fold = oof.groupBy("pliegue").agg(mae().alias("mae"))
    return mae_by_zone(oof, per_fold.agg(F.avg("mae").alias("m")).scalar())


def transparency(
    pairs: DataFrame,
    reference: float | None = K.MAE_REFERENCE,
    mean_price: float | Column = K.MEAN_PRICE_REFERENCE,
    tolerance: float = 1e-3,
) -> DataFrame:
    """Pairs with their difference and the summary on every row.

    With a reference, a MAE off by more than the tolerance is an error, as is an empty table.
    """
    error = pairs.agg(mae().alias("m"), F.count("*").alias("n"))
    if reference is not None:
        wrong = F.abs(F.col("m") - reference) > tolerance
        checked = F.when(
            wrong | F.col("m").isNull(), F.raise_error(F.lit("MAE differs from the verified value"))
        ).otherwise(F.col("m"))
        error = error.select(checked.alias("m"), "n")
    held = error.select(F.struct("m", "n").alias("s")).scalar()
    mean = mean_price if isinstance(mean_price, Column) else F.lit(mean_price)
    return pairs.select(
        "propiedad_id", "precio_real", "precio_predicho",
        (F.col("precio_real") - F.col("precio_predicho")).alias("diferencia_absoluta"), "zona",
        held["n"].alias("n_muestras"), held["m"].alias("mae_absoluto"),
        (held["m"] / mean * 100).alias("mae_porcentual"),
    )


def merge_attempts(attempts: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row per id: a successful attempt if there is one, else the last failure."""
    ok = F.col("score").isNotNull()
    order = F.struct(ok.alias("ok"), F.col("intento"))
    return attempts.groupBy(key).agg(
        F.max_by("score", order).alias("score"),
        F.max_by("intento", order).alias("intento"),
        F.max(ok).alias("valido"),
    )


def pending_attempts(attempts: DataFrame, wanted: DataFrame, key: str = "listing_id") -> DataFrame:
    """Ids of `wanted` without a successful attempt, with the number of failed ones: the next retry."""
    tried = attempts.groupBy(key).agg(F.count_if(F.col("score").isNull()).alias("fallidos"), F.count("score").alias("_ok"))
    return wanted.select(key).distinct().join(tried, key, "left").filter(F.coalesce("_ok", F.lit(0)) == 0).select(
        key, F.coalesce("fallidos", F.lit(0)).cast("bigint").alias("fallidos"))


def model_equivalence(left: DataFrame, right: DataFrame, key: str, columns: list[str], threshold: float = 1.0) -> DataFrame:
    """Paired differences of two models per dimension: mean and maximum absolute, share at or over."""
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("d")) for c in columns
    ])
    return (
        a.join(b, key).select(F.inline(rows)).groupBy("dimension")
        .agg(
            F.count("*").alias("pares"), F.avg("d").alias("diferencia_media"),
            F.max("d").cast("double").alias("diferencia_max"),
            F.avg((F.col("d") >= threshold).cast("double")).alias("share_umbral"),
        )
    )


def band_contrast(df: DataFrame, score: str, low: float, high: float, flags: dict[str, Column]) -> DataFrame:
    """Shares of each flag among low-score and high-score rows."""
    band = F.when(F.col(score) <= low, "bajo").when(F.col(score) >= high, "alto")
    return (
        df.withColumn("banda", band).filter(F.col("banda").isNotNull()).groupBy("banda")
        .agg(F.count("*").alias("n"), *[F.avg(f.cast("double")).alias(k) for k, f in flags.items()])
    )


def model_metrics(scored: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(orden, modelo, n_cv, n_test, mae_cv, mae_test) from each model's out-of-fold and held-out
    predictions; the cross-validated figure is the mean over folds."""
    rows = []
    for order, (name, (folded, held_out)) in enumerate(scored.items(), 1):
        per_fold = folded.groupBy("pliegue").agg(F.count("*").alias("n"), mae().alias("mae"))
        test = held_out.agg(F.struct(F.count("*").alias("n"), mae().cast("double").alias("mae")).alias("t")).scalar()
        rows.append(per_fold.agg(F.sum("n").alias("n_cv"), F.avg("mae").alias("mae_cv")).select(
            F.lit(order).alias("orden"), F.lit(name).alias("modelo"), "n_cv", test["n"].alias("n_test"),
            F.col("mae_cv").cast("double").alias("mae_cv"), test["mae"].alias("mae_test")))
    return reduce(DataFrame.unionByName, rows)


def model_comparison(metrics: DataFrame, mean_price: Column, flag_pct: float = 15.0) -> DataFrame:
    """Rows (modelo, mae_cv, mae_test) with percent of the mean price and the gap to the first."""
    base = metrics.agg(F.min_by("mae_test", "orden").alias("m")).scalar()
    gap = F.abs(F.col("mae_test") - base) / base * 100
    return metrics.select(
        "modelo", "mae_cv", "mae_test",
        (F.col("mae_test") / mean_price * 100).alias("pct_precio_medio"),
        gap.alias("diferencia_pct"), (gap > flag_pct).alias("supera_umbral"),
    )
