"""License scan by diagonal voting.

Every rolling word 3-gram of a document is hashed and meets the template positions with the same hash;
an offset between the two is a diagonal. Votes are summed per document, template and diagonal, and
neighbouring diagonals are merged into spans. A span is verified by the longest chain of its votes that
ascends in both the text and the template: the chain has to cover enough of the template's words, and
among them those that tell this license from its neighbours. Phrases that name a license outright are
found exactly, word by word.

Defined results: null or empty text has no words, no labels and score 0; repeated rows are scanned
alike; a null doc_id is scanned as any other; empty input gives empty output; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

K = 3
GAP = 4
COVER = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that name a license, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wordings of public licenses by which they are recognised, with their labels and the phrases
# (of up to three words, parted by ;) that have to be found, as other licenses have the rest in common.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", "gnu general"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation", "lesser"),
    ("cc-by", "Licensed under CC BY 4.0.", "by 4"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", ""),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission", "contributors;endorse"),
    ("rights-reserved", "All rights reserved. No part of this work may be reproduced without permission.", "reserved;reproduced"),
)


def lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def grams(words: Column, k: int = K) -> Column:
    """Hash of every k words in a row; none where there are fewer."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, at) of the given wordings: a list written in the code, so its size is known."""
    rows = [(i, label, wording) for i, (label, wording, _) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, text string")
    words = table.select("template", words_of(lowered()).alias("words"))
    return words.select("template", F.posexplode(grams(F.col("words"), k)).alias("at", "gram"))


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def chain(votes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (pos, at) votes that ascends in both."""
    votes = sorted(votes, key=lambda v: (v[0], -v[1]))
    ends: list[int] = []  # least `at` that a chain of each length can end with
    last: list[int] = []  # the vote it ends with
    before: list[int] = []
    for i, (_, at) in enumerate(votes):
        n = bisect_left(ends, at)
        before.append(last[n - 1] if n else -1)
        ends[n:n + 1], last[n:n + 1] = [at], [i]
    found, i = [], last[-1] if last else -1
    while i >= 0:
        found.append(votes[i])
        i = before[i]
    return found[::-1]


def verified(votes: list[tuple[int, int]], words: list[str], needed: list[str], k: int, cover: float) -> tuple[int, int, float] | None:
    """(first, last, score) of a span, or nothing where its chain does not carry the template."""
    found = chain(votes)
    covered = {at + i for _, at in found for i in range(k)}
    score = len(covered) / len(words)
    held = [f" {' '.join(words[at:at + k])} " for _, at in found]
    if score < cover or not all(any(f" {phrase} " in gram for gram in held) for phrase in needed):
        return None
    return found[0][0], found[-1][0] + k - 1, score


def _verified(keys: list[str], templates, k: int, cover: float):
    known = [(label, plain_words(wording), [p for p in needed.split(";") if p]) for label, wording, needed in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                label, words, needed = known[row["template"]]
                votes = [(at + d["diagonal"], at) for d in row["diagonals"] for at in d["ats"]]
                found = verified(votes, words, needed, k, cover)
                if found:
                    out.append({**{c: row[c] for c in keys}, "label": label, "first": found[0], "last": found[1], "score": found[2]})
            kinds = [*((c, batch.schema.field(c).type) for c in keys), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return run


def spans(words: DataFrame, key: list[str], templates=TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans (key, label, first, last, score) of (key, words).

    The rolling hashes meet the templates in a broadcast join: the templates are a fixed list. A span
    is a run of diagonals at most `gap` apart; only those whose votes cover enough words in any order
    are verified in theirs.
    """
    lengths = F.array(*[F.lit(len(plain_words(wording))) for _, wording, _ in templates])
    rolled = words.select(*key, F.posexplode(grams(F.col("words"), k)).alias("pos", "gram"))
    votes = rolled.join(F.broadcast(template_grams(words.sparkSession, templates, k)), "gram").select(
        *key, "template", "at", (F.col("pos") - F.col("at")).alias("diagonal")
    )
    diagonals = votes.groupBy(*key, "template", "diagonal").agg(F.collect_set("at").alias("ats"))
    near = Window.partitionBy(*key, "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(near) > gap) | F.lag("diagonal").over(near).isNull()
    merged = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(near))
    runs = merged.groupBy(*key, "template", "run").agg(F.collect_list(F.struct("diagonal", "ats")).alias("diagonals"))
    ats = F.array_distinct(F.flatten(F.transform("diagonals", lambda d: d["ats"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + (k - 1))))))
    worth = runs.filter(covered >= cover * F.get(lengths, F.col("template"))).select(*key, "template", "diagonals")
    kinds = dict(words.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "label string, first long, last long, score double"])
    return worth.mapInArrow(_verified(key, templates, k, cover), schema)


def phrase_starts(words: Column, phrase: str) -> Column:
    """Every start of a phrase among the words."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + j) == part)
        return test

    return F.filter(at, stands)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    texts = docs.select("doc_id", lowered().alias("low")).withColumn("words", words_of(F.col("low")))
    # Words of a phrase can only stand in a text that holds its last one.
    nowhere = F.array().cast("array<int>")
    starts = [F.when(F.contains("low", F.lit(p.split(" ")[-1])), phrase_starts(F.col("words"), p)).otherwise(nowhere) for p, _ in PHRASES]
    keyed = texts.select(
        "doc_id", F.xxhash64("low").alias("a"), F.xxhash64(F.lit(1), F.col("low")).alias("b"), "words",
        F.size("words").cast("bigint").alias("n_words"), *[s.alias(f"s{i}") for i, s in enumerate(starts)],
    )
    every = F.concat(*[F.col(f"s{i}") for i in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"s{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    base = keyed.select(
        "doc_id", "a", "b", "n_words", F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.sort_array(F.array_distinct(named)).alias("base"),
    )
    # Spans belong to a text: equal texts share them, and only texts with votes have any.
    key = ["a", "b"]
    found = spans(keyed.select(*key, "words"), key, templates).groupBy(*key).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("most")
    )
    more = F.coalesce("more", F.array().cast("array<string>"))
    labels = F.sort_array(F.array_union("base", more))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return base.join(found, key, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
