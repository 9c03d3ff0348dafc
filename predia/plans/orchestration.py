"""Batches of free-text queries: extract, classify, search, value and answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.functions.intent import IntentRules, extract_intent, fallback_message, outcome
from predia.functions.pricing import model_coverage, type_plural
from predia.operators.vector_search import Criteria, vector_topk
from predia.session import cut

REQUEST_CRITERIA: Criteria = [
    ("zona", "eq", "corregimiento"),
    ("tipo_pedido", "eq", "tipo_inmueble"),
    ("precio_min", "ge", "price_usd"),
    ("precio_max", "le", "price_usd"),
    ("habitaciones_min", "ge", "bedrooms"),
    ("banos_min", "ge", "bathrooms"),
]


def classify(queries: DataFrame, rules: IntentRules | None = None, text: str = "consulta") -> DataFrame:
    """Query rows with the extracted intent fields and the outcome."""
    rules = rules or IntentRules()
    tagged = queries.withColumn("_x", extract_intent(text, rules))
    tagged = tagged.withColumn("categoria", outcome("_x", rules.zones))
    return tagged.withColumn("mensaje", fallback_message("_x", "categoria")).select(
        *queries.columns, "_x.*", "categoria", "mensaje"
    )


def watch_band(classified: DataFrame, band: tuple[float, float] = K.WATCH_BAND) -> DataFrame:
    return classified.filter(F.col("confianza").between(*band))


def confidence_by_group(classified: DataFrame, by: str) -> DataFrame:
    return classified.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("confianza").alias("confianza_media")
    )


def outcome_mix(classified: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Count and share of every outcome, absent ones as zero, from one pass."""
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("categoria"), F.count_if(F.col("categoria") == c).alias("n"),
            (F.count_if(F.col("categoria") == c) / F.nullif(F.count("*"), F.lit(0))).alias("share"),
        )
        for c in categories or K.OUTCOMES
    ])
    return classified.agg(rows.alias("r")).select(F.inline("r"))


def search_requests(classified: DataFrame, zones: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """The bounds of the queries that can be searched, as extracted; fallbacks ask for nothing.

    `zones` and `types` name the catalogue's value where the words of queries differ from it.
    """
    def named(column: str, names: dict[str, str] | None) -> Column:
        if not names:
            return F.col(column)
        pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.coalesce(F.element_at(pairs, F.col(column)), F.col(column))

    bounds = [F.col(c).cast("double").alias(c) for c in ("precio_min", "precio_max", "habitaciones_min", "banos_min")]
    return classified.filter(F.col("categoria") == "exito").select(
        "consulta_id", named("zona", zones).alias("zona"), named("tipo_inmueble", types).alias("tipo_pedido"), *bounds)


def respond(classified: DataFrame, answered: DataFrame) -> DataFrame:
    """Every query with its answer, or its fallback message and no candidates."""
    none = F.lit(0).cast("bigint")
    return classified.select("consulta_id", "categoria", "mensaje").join(answered, "consulta_id", "left").select(
        "consulta_id", "categoria", F.coalesce("n_candidatos", none).alias("n_candidatos"),
        F.coalesce("n_con_semaforo", none).alias("n_con_semaforo"), F.coalesce("respuesta", "mensaje").alias("respuesta"))


def enriched_search(
    requests: DataFrame, listings: DataFrame, value: Callable[[DataFrame], DataFrame], reason: Column, k: int = 10
) -> DataFrame:
    """Top-k candidates per request with their traffic light, or why there is none.

    `requests` carry consulta_id, vector and nullable bounds, types in singular or plural; `value`
    gives the valuation of the listings (listing_id) that were found, and of no others; `reason` says why a candidate cannot be valued, missing attributes before pool limits.
    """
    asked = requests.withColumn("tipo_pedido", type_plural("tipo_pedido"))
    found = cut(vector_topk(
        asked, listings, k, query_id="consulta_id", vector_id="listing_id", criteria=REQUEST_CRITERIA
    ))
    lights = value(found.select("listing_id").distinct()).select("listing_id", "categoria_semaforo", "precio_predicho", "n_comparables")
    attributes = listings.select(
        "listing_id", "corregimiento", "tipo_inmueble", "price_usd", "bedrooms", "bathrooms", "area_m2"
    )
    joined = found.join(attributes, "listing_id").join(lights, "listing_id", "left")
    return joined.withColumn(
        "motivo_sin_semaforo",
        F.when(F.col("categoria_semaforo").isNull(), F.coalesce(reason, F.lit("sin valuación"))),
    )


def answers(requests: DataFrame, candidates: DataFrame, zones: list[str], model_type: str) -> DataFrame:
    """Answer text per request from candidate counts and model coverage: five cases."""
    counts = candidates.groupBy("consulta_id").agg(
        F.count("*").alias("n"), F.count("categoria_semaforo").alias("con"),
        F.min_by("motivo_sin_semaforo", "rank").alias("primero"),
    )
    coverage = model_coverage("zona", type_plural("tipo_pedido"), zones, model_type)
    n, lit_count = F.coalesce("n", F.lit(0)), F.coalesce("con", F.lit(0))
    uncovered = F.col("_c.cubierto").eqNullSafe(False)
    text = (
        F.when(
            (n == 0) & uncovered,
            F.format_string(
                "Sin propiedades para esos criterios en %s. El modelo de precio tampoco cubre la zona o el tipo (%s).",
                F.col("zona"), F.col("_c.motivo"),
            ),
        )
        .when(
            n == 0,
            F.format_string(
                "Sin propiedades para esos criterios en %s. Prueba otro precio, tipo o habitaciones.",
                F.coalesce("zona", F.lit("la zona indicada")),
            ),
        )
        .when(
            lit_count == 0,
            F.format_string(
                "%d propiedades coinciden, ninguna con semáforo de precio (%s).",
                n, F.coalesce("_c.motivo", "primero"),
            ),
        )
        .when(
            lit_count < n,
            F.format_string("%d propiedades coinciden, %d con semáforo de precio.", n, lit_count),
        )
        .otherwise(F.format_string("%d propiedades coinciden, todas con semáforo de precio.", n))
    )
    return (
        requests.join(counts, "consulta_id", "left").withColumn("_c", coverage)
        .select("consulta_id", n.alias("n_candidatos"), lit_count.alias("n_con_semaforo"), text.alias("respuesta"))
    )
