"""Rule-based text quality scores, each 1..5, from features of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from predia.functions.text import col, contains_any, count_matches

# --- Fixed values: rule vocabulary ---
AMENITY_WORDS = [
    "piscina", "gimnasio", "balcón", "terraza", "vista", "seguridad", "ascensor", "parque",
    "amoblado", "acabados", "elevador", "estacionamiento",
]
UNIT_WORDS = ["m2", "m²", "metros", "habitacion", "recámara", "baño"]
PRICE_PATTERN = r"(?:\$|USD|US\$|B/\.)\s?\d"


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def rubric_scores(
    text: str | Column,
    amenity_words: list[str] | None = None,
    unit_words: list[str] | None = None,
    price_pattern: str = PRICE_PATTERN,
) -> Column:
    """Struct of the four scores; null text gives null."""
    t = col(text)
    amenity_words = AMENITY_WORDS if amenity_words is None else amenity_words
    unit_words = UNIT_WORDS if unit_words is None else unit_words
    size = F.char_length(t)
    numbers = count_matches(t, r"\d+")
    completeness = (
        1 + _one_if(size >= 300) + _one_if(size >= 1000) + _one_if(numbers >= 2)
        + _one_if(contains_any(t, unit_words))
    )
    presentation = (
        5
        - _one_if(~t.rlike(r"[.!?…]\s*$"))
        - _one_if(t.rlike(r"[!?*#$%&]{2,}"))
        - _one_if(t == F.upper(t))
        - _one_if(size < 80)
    )
    hits = sum((_one_if(contains_any(t, [w])) for w in amenity_words), F.lit(0))
    differentiators = 1 + F.least(hits, F.lit(4))
    price = F.when(t.rlike(price_pattern), 5).when(numbers > 0, 3).otherwise(1)
    return F.when(
        t.isNotNull(),
        F.struct(
            completeness.alias("completitud_informativa"),
            presentation.alias("calidad_presentacion"),
            differentiators.alias("diferenciadores_amenidades"),
            price.alias("transparencia_precio"),
        ),
    )
