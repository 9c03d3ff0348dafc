"""Text column expressions: parsing, keyword rules, redaction, repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from predia import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: list[Column], default: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(default)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def number_in_text(text: str | Column) -> Column:
    """First run of digits once dots and commas are dropped: '1.5' reads 15."""
    digits = F.regexp_extract(F.regexp_replace(col(text), "[.,]", ""), r"\d+", 0)
    return digits.try_cast("bigint")


def listing_id_from_url(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(col(url), K.LISTING_ID_PATTERN, 1), F.lit(""))


def contains_any(text: str | Column, words: list[str]) -> Column:
    """Substring test on the lower-cased text; null text holds nothing."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    return any_of([F.contains(lowered, F.lit(w)) for w in words])


def is_excluded_type(title: str | Column, words: list[str] | None = None) -> Column:
    return contains_any(title, K.EXCLUDED_TITLE_WORDS if words is None else words)


def operation_of(title: str | Column, rent_words: list[str] | None = None) -> Column:
    rented = contains_any(title, K.RENT_WORDS if rent_words is None else rent_words)
    return F.when(rented, "alquiler").otherwise("venta")


def keyword_rule(
    text: str | Column, source: str | Column, include: list[str], exclude: list[str]
) -> Column:
    """Any include word, no exclude word, and some text; words match inside longer words."""
    wanted = contains_any(text, include) if include else F.lit(True)
    refused = contains_any(text, exclude)
    return wanted & ~refused & F.coalesce(col(source) != "ninguna", F.lit(True))


def redact_contacts(text: str | Column) -> Column:
    """Phones and e-mails become a mark; null stays null."""
    phones = F.regexp_replace(col(text), K.PHONE_PATTERN, K.REDACTION_MARK)
    return F.regexp_replace(phones, K.EMAIL_PATTERN, K.REDACTION_MARK)


def count_matches(text: str | Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(pattern)), F.lit(0))


def repair_c1(text: str | Column) -> Column:
    """Six Windows-1252 control characters become the punctuation they stand for."""
    return F.translate(col(text), K.C1_FROM, K.C1_TO)


def has_c1(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike("[\u0080-\u009f]"), F.lit(False))


def mentions_any_zone(text: str | Column, zones: list[str] | None = None) -> Column:
    return contains_any(text, [z.lower() for z in (K.SCOPE_ZONES if zones is None else zones)])


def embedding_text(source: str | Column, description: str | Column, title: str | Column) -> Column:
    return F.when(col(source).isin("completa", "preview"), col(description)).otherwise(col(title))


def strip_tags(html: str | Column, joiner: str = " ") -> Column:
    """Text between tags, trimmed piece by piece and joined."""
    pieces = F.transform(
        F.split(col(html), "<[^>]*>"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    )
    return F.array_join(F.filter(pieces, lambda p: p != ""), joiner)


def quality_json(text: str | Column, fields: list[str] | None = None) -> Column:
    """Score struct out of a model reply: fences dropped, outermost braces parsed, else null.

    Malformed JSON, a missing field or a value outside 1..5 gives null.
    """
    fields = K.QUALITY_DIMENSIONS if fields is None else fields
    trimmed = F.trim(col(text))
    fenced = F.regexp_replace(F.get(F.split(trimmed, "```"), F.lit(1)), "^json", "")
    body = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    blob = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    parsed = F.from_json(blob, ", ".join(f"{f} INT" for f in fields))
    valid = all_of([F.coalesce(parsed[f].between(1, 5), F.lit(False)) for f in fields])
    return F.when(valid, parsed)
