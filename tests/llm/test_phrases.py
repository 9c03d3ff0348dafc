"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from predia.llm import phrases
from tests.llm.helpers import hard_docs, no_docs

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=10, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        ranked = []
        for p, a in found.items():
            if any(100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in found.items() if len(q) > len(p)):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def texts(n=500, seed=4):
    draw = random.Random(seed)
    names = [f"W{i}" for i in range(40)] + ["É", "straße", "new", "york", "city"]
    rows = []
    for _ in range(n):
        words = draw.choices(names, [1 / (i + 1) for i in range(len(names))], k=draw.choice((0, 2, 15, 40)))
        if draw.random() < 0.3:
            words += ["New", "York", "City" if draw.random() < 0.7 else "times"]
        text = "".join(w + draw.choice((" ", " ", " ", "\t ", ", ", ".\n", "; ")) for w in words)
        rows.append((draw.choice(("en", "en", "en", "de", None)), text))
    return rows


def same(got, expected):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 4, "block_bytes": 500, "best": 7}, {"support": 3, "shards": 5, "block_bytes": 2000}])
def test_equals_plain_counting(spark, options):
    rows = texts()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    same(phrases.collocations(docs, **options), brute(rows, options.get("support", 10), options.get("best", 2000)))


def test_crowded_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 1 << 15)  # one piece, most of its bits set
    rows = texts(300)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    same(phrases.collocations(docs, support=2, shards=2), brute(rows, 2))


def test_hard_rows(spark):
    docs = hard_docs(spark).select("*", *[F.lit(1).alias(c) for c in ("shard", "phrase", "n", "a", "score")])
    docs = docs.unionByName(docs).unionByName(docs)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    same(phrases.collocations(docs, support=3), brute(rows, 3))
    same(phrases.collocations(docs, support=3, block_bytes=1000), brute(rows, 3))


def test_empty(spark):
    assert phrases.collocations(no_docs(spark)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).count() == 0


def test_mining_loses_no_frequent_phrase_and_drops_rare_ones(spark):
    rows = texts(400)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    shards = 3
    tables = phrases.mine(phrases._sharded(docs, shards), 10, shards, 1 << 20)
    pieces = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(A_Z)):
            words = piece.split()
            pieces.update((lang or "und", tuple(words[i:i + 2])) for i in range(len(words) - 1))
    is_word, ends = phrases.byte_class(phrases.WORD), phrases.byte_class(phrases.PIECE_END.encode())

    def passes(lang, pair):
        block = phrases.Block(lang.encode(), [" ".join(pair).encode()], is_word, ends)
        return bool(phrases._passes(tables[2].value, block.keys(2, np.zeros(1, np.int64)), range(shards))[0])

    assert all(passes(*p) for p, n in pieces.items() if n >= 10)
    assert not any(passes(*p) for p, n in pieces.items() if n < 4)
