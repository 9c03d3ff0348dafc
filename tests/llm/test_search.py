"""Block-Max MaxScore against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from predia.llm import search
from predia.llm.words import LOWER
from tests.llm.helpers import hard_docs, no_docs

WORD = re.compile(search.BREAK.replace("[", "[^", 1) + "+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(A_Z))


def brute(docs, items, best=10):
    """(item_id, rank, doc_id, score) by scoring all documents."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    held, words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            score = 0
            for term in set(split(text)) & set(bag):
                m = 10 + (90 * n * held) // words
                score += math.floor(1000 * math.log((2 * held + 2) / (2 * df[term] + 1))) * ((10**9 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:best], 1)]
    return out


def texts(n, seed=3):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["É", "日本", "Mix3d"]
    odds = [1 / (i + 1) for i in range(len(names))]
    rows = [(i, " ".join(draw.choices(names, odds, k=draw.choice((0, 1, 3, 12, 60))))) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(40)]  # ties


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def same(got, expected):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


SMALL = {"window": 16, "chunk_bytes": 300, "shard_bytes": 4000}


@pytest.mark.parametrize("options", [{}, SMALL, {**SMALL, "most_terms": 5, "items_a_block": 3}])
def test_equals_plain_ranking(spark, monkeypatch, options):
    monkeypatch.setattr(search, "BLOCK", 8)
    docs = texts(400)
    items = [(i, t) for i, t in texts(12, 9)[:12]] + [(77, "w1 w2 w1, É!"), (77, "w3"), (78, "nowhere"), (79, None), (None, "w5 日本")]
    same(search.rank(*frames(spark, docs, items), **options), brute(docs, items))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(1, "same text alpha0 a row id"), (2, "日本語 É 500"), (3, "")], "item_id long, text string")
    same(search.rank(docs, items.select("*", *[F.lit(1).alias(c) for c in ("terms", "query", "block", "rank")])), brute(rows, items.collect()))
    same(search.rank(docs, items, chunk_bytes=100, shard_bytes=500), brute(rows, items.collect()))


def test_empty(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert search.rank(no_docs(spark), items).count() == 0
    assert search.rank(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), items).count() == 0
    assert search.rank(hard_docs(spark), items.filter("false")).count() == 0


def test_blocks_are_left_packed_when_their_maxima_cannot_reach():
    """A common term's blocks stay packed once the rare term's documents hold the best places."""
    rng = np.random.default_rng(0)
    n = 4096
    sizes = np.full(n, 50)
    rare, common = np.arange(0, 600, 40), np.arange(n)

    class Row:
        def __init__(self, docs, tf):
            cuts = range(0, len(docs), 128)
            self.last = [docs[min(c + 127, len(docs) - 1)] for c in cuts]
            self.most_tf = [tf[c:c + 128].max() for c in cuts]
            self.least_n = [50 for _ in cuts]
            self.blocks = [search.pack(docs[c:c + 128], tf[c:c + 128], docs[c - 1] if c else -1) for c in cuts]

    m = search._m(sizes, n, int(sizes.sum()))
    quality = lambda tf, size: search._quality(tf, search._m(size, n, int(sizes.sum())))
    tf = rng.integers(1, 4, n)
    lists = [(5000, search._List(Row(rare, np.full(len(rare), 2)), quality)), (3, search._List(Row(common, tf), quality))]
    docs, scores = search.best_of_shard(lists, m, window=512)
    full = 3 * search._quality(tf, m)
    full[rare] += 5000 * search._quality(np.full(len(rare), 2), m[rare])
    order = np.lexsort((np.arange(n), -full))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    assert len(lists[1][1].open) < len(lists[1][1].blocks) // 2


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for spread in (1, 300, 100_000):
        docs = np.cumsum(rng.integers(1, spread + 1, 128)) + 5
        tf = rng.integers(1, spread + 1, 128)
        got = search.unpack(search.pack(docs, tf, 3), 3)
        assert (got[0] == docs).all() and (got[1] == tf).all()


def test_lower_is_ascii_only():
    assert bytes(LOWER[np.frombuffer("AZaz[É".encode(), np.uint8)]).decode() == "azaz[É"
