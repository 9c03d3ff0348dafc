"""Preference matching: rules, keyword criteria, similarity, hybrid ranking, Precision@k."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from predia import constants as K
from predia.operators.scale import min_max_score, rank_all, top_per_group
from predia.operators.vector_search import MAX_QUERY_CELLS, ROUND
from predia.session import cut

MAX_BROADCAST_PROFILES = 10_000
RULE_COLUMNS = ["price_usd", "bedrooms", "area_m2"]
PROFILE_SCHEMA = (
    "perfil string, corregimientos array<string>, "
    + ", ".join(f"{c}_{s} double" for c in RULE_COLUMNS for s in ("min", "max"))
    + ", incluye array<string>, excluye array<string>"
)


def profile_table(spark: SparkSession, profiles: list[dict] | None = None) -> DataFrame:
    profiles = K.PROFILES if profiles is None else profiles
    rows = []
    for p in profiles:
        bounds = [
            None if p.get(f"{c}_{s}") is None else float(p[f"{c}_{s}"])
            for c in RULE_COLUMNS for s in ("min", "max")
        ]
        rows.append((p["perfil"], p["corregimientos"], *bounds, p.get("incluye", []), p.get("excluye", [])))
    table = spark.createDataFrame(rows, PROFILE_SCHEMA)
    # The rules come from a list held here, so their number is known before they are broadcast.
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_PROFILES else table


def rule_matches(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listing rows joined to the profiles whose zone list and ranges they meet.

    The zone list becomes an equality key; the ranges are tested on the joined rows. A null bound
    is no bound, a null value meets no bound.
    """
    def within(c: str) -> Column:
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        return (low.isNull() | F.coalesce(F.col(c) >= low, F.lit(False))) & (
            high.isNull() | F.coalesce(F.col(c) <= high, F.lit(False))
        )

    zones = profiles.withColumn("corregimiento", F.explode(F.array_distinct("corregimientos")))
    joined = listings.join(zones.drop("corregimientos"), "corregimiento")
    return joined.filter(within("price_usd") & within("bedrooms") & within("area_m2"))


def keyword_match(text: str = "descripcion", source: str = "descripcion_fuente") -> Column:
    """Keyword rule of the row's own profile: the word lists are columns (incluye, excluye)."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))

    def holds(words: str) -> Column:
        return F.exists(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: F.contains(lowered, w))

    free = F.coalesce(F.size("incluye") == 0, F.lit(True)) | F.col("incluye").isNull()
    return (free | holds("incluye")) & ~holds("excluye") & F.coalesce(F.col(source) != "ninguna", F.lit(True))


def ground_truth(listings: DataFrame, profiles: list[dict] | DataFrame | None = None) -> DataFrame:
    """(perfil, listing_id, cualitativo, descripcion_fuente) for every structural match.

    Profiles are a list, or a table in PROFILE_SCHEMA of any size.
    """
    table = profiles if isinstance(profiles, DataFrame) else profile_table(listings.sparkSession, profiles)
    return rule_matches(listings, table).select(
        "perfil", "listing_id", keyword_match().alias("cualitativo"), "descripcion_fuente"
    )


def ground_truth_counts(matches: DataFrame) -> DataFrame:
    kept = F.col("cualitativo")
    return matches.groupBy("perfil").agg(
        F.count("*").alias("n_solo_estructural"),
        F.count_if(kept).alias("n_ground_truth"),
        F.count_if(kept & (F.col("descripcion_fuente") == "completa")).alias("de_completa"),
        F.count_if(kept & (F.col("descripcion_fuente") == "preview")).alias("de_preview"),
    )


def structural_score(profile: dict) -> Column:
    """Mean of 0/1 over the criteria the profile states; a null value scores 0."""
    criteria = [F.col("corregimiento").isin(profile["corregimientos"])]
    for c in RULE_COLUMNS:
        if profile.get(f"{c}_min") is not None:
            criteria.append(F.col(c) >= profile[f"{c}_min"])
        if profile.get(f"{c}_max") is not None:
            criteria.append(F.col(c) <= profile[f"{c}_max"])
    points = [F.when(c, 1.0).otherwise(0.0) for c in criteria]
    return sum(points[1:], points[0]) / len(points)


def structural_scores(listings: DataFrame, profiles: list[dict] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per listing and profile, built inside the row instead of by a join."""
    profiles = K.PROFILES if profiles is None else profiles
    rows = F.array(*[
        F.struct(F.lit(p["perfil"]).alias("perfil"), structural_score(p).alias("score_estructurado"))
        for p in profiles
    ])
    return listings.select("listing_id", *(keep or []), F.inline(rows))


def profile_cosines(profile_vectors: DataFrame, names: list[str], width: int):
    """Arrow function from an embedding column to its cosines with the profiles, in their order.

    `names` is the caller's block of profiles, `width` the length of a vector; the vectors of one block travel with the task. A
    vector without a direction (null or all zero) has null cosines, on either side.
    """
    held = profile_vectors.filter(F.col("perfil").isin(names)).select("perfil", F.col("vector").cast("array<double>").alias("v"))
    by_name = {r["perfil"]: r["v"] for r in held.collect()}
    unit = np.array([by_name.get(n) or [0.0] * width for n in names], float)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)

    @F.pandas_udf("array<double>")
    def cosines(vectors: pd.Series) -> pd.Series:
        m = np.array([[0.0] * width if v is None else v for v in vectors], float)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            found = np.round(m @ unit.T, ROUND)
        return pd.Series([[None if x != x else x for x in row] for row in found.tolist()])

    return cosines


def profile_blocks(profiles: list[dict], width: int) -> list[list[dict]]:
    """Profiles in blocks whose vectors fit a task."""
    step = max(1, MAX_QUERY_CELLS // width)
    return [profiles[i:i + step] for i in range(0, len(profiles), step)]


def profile_scores(
    listings: DataFrame, profile_vectors: DataFrame, profiles: list[dict] | None = None, vector: str = "embedding"
) -> DataFrame:
    """Structural score, cosine and min-max scored cosine of every listing with every profile.

    Both scores of all profiles are built inside the listing's row, so no join or shuffle of
    listings is needed; only the extremes per profile are aggregated, one small row each. A
    profile whose cosines are all equal scores 0.
    """
    profiles = K.PROFILES if profiles is None else profiles
    width = max(profile_vectors.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 1, 1)
    parts = []
    for block in profile_blocks(profiles, width):
        cosines = profile_cosines(profile_vectors, [p["perfil"] for p in block], width)
        rows = F.array(*[
            F.struct(
                F.lit(p["perfil"]).alias("perfil"), structural_score(p).alias("score_estructurado"),
                F.get("_cos", F.lit(i)).alias("coseno"),
            )
            for i, p in enumerate(block)
        ])
        parts.append(listings.withColumn("_cos", cosines(vector)).select("listing_id", F.inline(rows)))
    # What is read twice below is ids and scores; the vectors themselves are never written.
    long = cut(reduce(DataFrame.unionByName, parts))
    few = len(profiles) <= MAX_BROADCAST_PROFILES
    return min_max_score(long, "coseno", ["perfil"], "score_semantico", flat="zero", few_groups=few)


def hybrid(
    scored: DataFrame, weights: tuple[float, float] = (K.WEIGHT_STRUCTURAL, K.WEIGHT_SEMANTIC)
) -> DataFrame:
    score = F.lit(weights[0]) * F.col("score_estructurado") + F.lit(weights[1]) * F.col("score_semantico")
    # Rounded so that scores equal but for summation noise are ties, broken by id.
    return scored.withColumn("score_hibrido", F.round(score, ROUND))


def ranking(scored: DataFrame, score: str = "score_hibrido", by: list[str] | None = None) -> DataFrame:
    """Rank of every listing within its profile, ties by id, over a distributed sort."""
    return rank_all(scored, by or ["perfil"], [F.col(score).desc(), F.col("listing_id")])


def precision_at(
    scored: DataFrame, truth: DataFrame, by: list[str], score: str, ks: list[int] | None = None
) -> DataFrame:
    """Share of the first k that are true matches; k divides even when fewer rows exist."""
    ks = ks or K.PRECISION_KS
    best = top_per_group(scored, by, [F.col(score).desc(), F.col("listing_id")], max(ks), "_r")
    hits = best.join(
        truth.select("perfil", "listing_id").withColumn("_hit", F.lit(1)), ["perfil", "listing_id"], "left"
    )
    return hits.groupBy(*by).agg(*[
        (F.sum(F.when(F.col("_r") <= k, F.coalesce("_hit", F.lit(0))).otherwise(0)) / k).alias(f"p{k}") for k in ks
    ])


def lift(hybrid_precision: DataFrame, structural_precision: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Gain of the hybrid over the structural ranking per profile, and the averages."""
    ks = ks or K.PRECISION_KS
    base = structural_precision.select("perfil", *[F.col(f"p{k}").alias(f"b{k}") for k in ks])
    rows = hybrid_precision.join(base, "perfil").select(
        "perfil", *[(F.col(f"p{k}") - F.col(f"b{k}")).alias(f"lift_p{k}") for k in ks]
    )
    means = rows.agg(*[F.avg(f"lift_p{k}").alias(f"lift_p{k}") for k in ks]).select(
        F.lit("promedio").alias("perfil"), *[f"lift_p{k}" for k in ks]
    )
    return rows.unionByName(means)


def weight_sweep(
    scored: DataFrame, truth: DataFrame, sweep: list[tuple[float, float]] | None = None
) -> DataFrame:
    """Precision@k per weight pair and profile in one job."""
    rows = F.array(*[
        F.struct(
            F.lit(f"{a}/{b}").alias("pesos"),
            F.round(F.lit(a) * F.col("score_estructurado") + F.lit(b) * F.col("score_semantico"), ROUND).alias("score"),
        )
        for a, b in sweep or K.WEIGHT_SWEEP
    ])
    exploded = scored.select("perfil", "listing_id", F.inline(rows))
    return precision_at(exploded, truth, ["pesos", "perfil"], "score")


def validate_profiles(profiles: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """Profiles with a validity flag and reason: zones in scope, positive price and rooms."""
    allowed = F.array(*[F.lit(z) for z in (K.SCOPE_ZONES if zones is None else zones)])
    wrong = F.array_except(F.coalesce("zonas_preferidas", F.array().cast("array<string>")), allowed)
    reason = F.concat_ws(
        "; ",
        F.when(F.size(wrong) > 0, F.concat(F.lit("zonas inválidas: "), F.array_join(wrong, ","))),
        F.when(F.col("precio_maximo") <= 0, "precio_maximo debe ser positivo"),
        F.when(F.col("habitaciones_min") <= 0, "habitaciones_min debe ser positivo"),
    )
    return profiles.withColumn("motivo", reason).withColumn("valido", reason == "")


def explain(df: DataFrame, transport_minimum: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """Four rows per candidate: dimension, met (true, false or null), criterion, value, detail.

    Needs precio_maximo, habitaciones_min, zonas_preferidas and the candidate's price_usd,
    bedrooms, corregimiento, transporte_score. Unknown rooms do not meet a minimum; a missing
    criterion or transport score is not evaluated.
    """
    def text(c) -> Column:
        return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("?"))

    price, rooms, zones = F.col("precio_maximo"), F.col("habitaciones_min"), F.col("zonas_preferidas")
    zone, transport = F.col("corregimiento"), F.col("transporte_score")
    minimum = F.lit(transport_minimum).cast("double")
    no_zones = zones.isNull() | (F.size(zones) == 0)

    def row(dimension: str, met: Column, criterion: Column, value: Column, good: Column, bad: Column, none: Column) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"),
            met.alias("cumplido"),
            criterion.alias("criterio_perfil"),
            value.cast("string").alias("valor_propiedad"),
            F.when(met.isNull(), none).when(met, good).otherwise(bad).alias("detalle"),
        )

    rows = F.array(
        row(
            "precio", F.when(price.isNotNull(), F.col("price_usd") <= price),
            F.when(price.isNotNull(), F.concat(F.lit("precio_maximo="), text("precio_maximo"))),
            F.col("price_usd"),
            F.concat(F.lit("Precio "), text("price_usd"), F.lit(" dentro del tope de "), text("precio_maximo")),
            F.concat(F.lit("Precio "), text("price_usd"), F.lit(" por encima del tope de "), text("precio_maximo")),
            F.lit("El perfil no fija un tope de precio"),
        ),
        row(
            "habitaciones",
            F.when(rooms.isNotNull(), F.coalesce(F.col("bedrooms") >= rooms, F.lit(False))),
            F.when(rooms.isNotNull(), F.concat(F.lit("habitaciones_min="), text("habitaciones_min"))),
            F.col("bedrooms"),
            F.concat(text("bedrooms"), F.lit(" habitaciones; se piden al menos "), text("habitaciones_min")),
            F.concat(text("bedrooms"), F.lit(" habitaciones son menos que las pedidas: "), text("habitaciones_min")),
            F.lit("El perfil no pide habitaciones"),
        ),
        row(
            "zona", F.when(~no_zones, F.array_contains(zones, zone)),
            F.when(~no_zones, F.concat(F.lit("zonas_preferidas="), F.array_join(zones, ","))), zone,
            F.concat(zone, F.lit(" es una zona del perfil")),
            F.concat(zone, F.lit(" no es una zona del perfil")),
            F.lit("El perfil acepta cualquier zona"),
        ),
        row(
            "transporte", F.when(minimum.isNotNull() & transport.isNotNull(), transport >= minimum),
            F.when(minimum.isNotNull(), F.concat(F.lit("transporte_minimo="), minimum.cast("string"))), F.round(transport, 6),
            F.concat(F.lit("Transporte de "), zone, F.lit(" llega a lo exigido")),
            F.concat(F.lit("Transporte de "), zone, F.lit(" queda por debajo de lo exigido")),
            F.when(minimum.isNull(), F.lit("El perfil no exige transporte")).otherwise(
                F.concat(F.lit("Sin dato de transporte en "), zone)
            ),
        ),
    )
    return df.select(*(keep or ["listing_id"]), F.inline(rows))


def embedding_coverage(listings: DataFrame, embedded: DataFrame) -> DataFrame:
    """Listings without embedding, and whether the evaluable filter explains it."""
    missing = listings.join(embedded.select("listing_id"), "listing_id", "left_anti")
    explained = (F.col("corregimiento") == K.UNKNOWN_ZONE) | F.col("precio_no_evaluable")
    return missing.select(
        "listing_id", "corregimiento", "precio_no_evaluable", explained.alias("esperado")
    )
