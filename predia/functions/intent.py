"""Rule-based intent extraction from query text, as columns over a query table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from predia import constants as K
from predia.functions.text import any_of, col, contains_any, mentions_any_zone


def _types() -> dict[str, list[str]]:
    return {
        "Apartamento": ["apartamento"],
        "Casa": ["casa"],
        "Edificio": ["edificio"],
        "Local": ["local"],
        "Terreno": ["terreno", "lote"],
    }


@dataclass(frozen=True)
class IntentRules:
    """Vocabulary of the extraction rules."""

    # --- Fixed values: default vocabulary ---
    zones: list[str] = field(default_factory=lambda: list(K.SCOPE_ZONES))
    types: dict[str, list[str]] = field(default_factory=_types)
    topic_words: list[str] = field(default_factory=lambda: [
        "apartamento", "casa", "edificio", "terreno", "lote", "propiedad", "inmueble", "vivienda",
        "habitaci", "busco", "quiero", "necesito", "algo ",
    ])
    vague_words: list[str] = field(default_factory=lambda: [
        "bonit", "comod", "cómod", "buena", "buen ", "buenos", "tranquil", "espacios", "económic",
        "economic", "accesible", "flexible", "modern", "convenien", "grande", "barat", "asequible",
        "razonable", "normal", "agradable", "rentab", "inversi", "invertir",
    ])
    # A capitalised place name after "en", "de" or "del".
    place: str = (
        r"(?:^|\s)(?:en|de|del)\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s(?:de\s|del\s)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*)"
    )
    max_price: str = r"(?:menos de|m[aá]ximo|hasta)\s+\$?\s?([0-9][0-9,.]*)"
    min_price: str = r"(?:desde|m[aá]s de)\s+\$\s?([0-9][0-9,.]*)"
    range_price: str = r"entre\s+\$?\s?([0-9][0-9,.]*)\s+y\s+\$?\s?([0-9][0-9,.]*)"
    rooms: str = r"([0-9]+)\s*(?:habitaci|rec[aá]mara|cuarto)"
    baths: str = r"([0-9]+)\s*ba[nñ]o"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text, pattern, group), "[,.]", "")
    return digits.try_cast("double")


def extract_intent(text: str | Column, rules: IntentRules | None = None) -> Column:
    """Struct of topic flag, zone, place text, type, prices, rooms, baths and confidence."""
    rules = rules or IntentRules()
    text = F.coalesce(col(text), F.lit(""))
    lowered = F.lower(text)

    found = F.filter(
        F.array(*[F.lit(z) for z in rules.zones]), lambda z: F.contains(lowered, F.lower(z))
    )
    n_zones = F.size(found)
    zone = F.when(n_zones == 1, found[0])
    place = F.nullif(F.regexp_extract(text, rules.place, 1), F.lit(""))
    mention = F.when(n_zones > 0, F.array_join(found, " / ")).otherwise(place)

    kind = F.lit(None).cast("string")
    for name, words in reversed(list(rules.types.items())):
        kind = F.when(contains_any(lowered, words), name).otherwise(kind)

    low = F.coalesce(_number(lowered, rules.range_price, 1), _number(lowered, rules.min_price))
    high = F.coalesce(_number(lowered, rules.range_price, 2), _number(lowered, rules.max_price))
    rooms = _number(lowered, rules.rooms).cast("int")
    baths = _number(lowered, rules.baths).cast("int")

    def one(c):
        return F.when(c, 1).otherwise(0)

    anchors = (
        one(zone.isNotNull()) + one(kind.isNotNull()) + one(low.isNotNull() | high.isNotNull())
        + one(rooms.isNotNull()) + one(baths.isNotNull())
    )
    vague = contains_any(lowered, rules.vague_words)
    confidence = (
        F.when(n_zones > 1, 0.30)
        .when(anchors == 0, 0.20)
        .when(~vague, 0.95)
        .when(anchors >= 3, 0.80)
        .when(anchors == 2, 0.60)
        .otherwise(0.35)
    )
    reason = (
        F.when(n_zones > 1, "varias zonas sin desempate")
        .when(anchors == 0, "sin entidades concretas")
        .when(~vague, "entidades con ancla clara")
        .otherwise("mezcla de anclas y calificativos")
    )
    return F.struct(
        contains_any(lowered, rules.topic_words).alias("es_consulta_inmobiliaria"),
        zone.alias("zona"),
        mention.alias("zona_mencion_texto"),
        kind.alias("tipo_inmueble"),
        low.alias("precio_min"),
        high.alias("precio_max"),
        rooms.alias("habitaciones_min"),
        baths.alias("banos_min"),
        confidence.alias("confianza"),
        reason.alias("razon_confianza"),
    )


def outcome(intent: str | Column, zones: list[str] | None = None, cut: float = K.CONFIDENCE_CUT) -> Column:
    """Off topic, out of coverage, ambiguous or success, tested in that order."""
    x = col(intent)
    uncovered = (
        x["zona_mencion_texto"].isNotNull()
        & x["zona"].isNull()
        & ~mentions_any_zone(x["zona_mencion_texto"], zones)
    )
    return (
        F.when(~x["es_consulta_inmobiliaria"], "fallback_fuera_tema")
        .when(uncovered, "fallback_cobertura")
        .when(x["confianza"] < cut, "fallback_ambiguedad")
        .otherwise("exito")
    )


def fallback_message(intent: str | Column, category: str | Column, cut: float = K.CONFIDENCE_CUT) -> Column:
    x, category = col(intent), col(category)
    return (
        F.when(
            category == "fallback_fuera_tema",
            F.lit("La consulta no trata de una propiedad. Indica zona, tipo o presupuesto."),
        )
        .when(
            category == "fallback_cobertura",
            F.concat(
                F.lit("'"), x["zona_mencion_texto"],
                F.lit("' está fuera de las zonas cubiertas."),
            ),
        )
        .when(
            category == "fallback_ambiguedad",
            F.concat(
                F.lit("Consulta ambigua (confianza "),
                F.format_string("%.2f", x["confianza"]),
                F.lit(f", umbral {cut:.2f}: "), x["razon_confianza"], F.lit(")."),
            ),
        )
    )
