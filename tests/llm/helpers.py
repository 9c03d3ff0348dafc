"""Plain versions of the operators, and rows that are hard on them."""

from __future__ import annotations

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that the operators use inside.
CLASH = ("size", "rank", "copies", "target", "k", "fp", "key", "left", "kind", "block", "slice", "words",
         "_text_a", "_text_b", "_row_a", "_row_b", "_spans", "_mix_a", "_mix_n", "a", "b", "n", "m", "row", "every", "class", "place", "open", "rest", "taken", "col")

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def hard_texts() -> list[str | None]:
    long = " ".join(f"{WORDS[i * 7 % 10]}{i % 91}" for i in range(4000))
    return [
        None, "", " ", "\n\n", "one", "one two", "one two three", "É à la über straße 日本語 🎉", "a" * 3000,
        "same text in two rows", "same text in two rows", long, long + " end", "x\ty\x0bz\r\nq",
        "line one\nline one\nline two\n\nline one", "\\### Assistant: </turn> ok", "0" * 500 + ".1.2.3",
        "mail me at a.b@c-d.example.org or +49 (30) 123456-78, 4111 1111 1111 1111 and 10.0.0.255 now",
    ]


def hard_docs(spark, clash: bool = True):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(hard_texts())]
    rows += [rows[11], (None, "a row without an id", "en", "s1", 19), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return docs


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(rows) -> Counter:
    return Counter(map(repr, rows))
