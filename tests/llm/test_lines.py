"""Shared lines against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from predia.llm import lines
from tests.llm.helpers import DOCS, bag, hard_docs, no_docs

LOW = str.maketrans(lines.UPPER, lines.LOWER)


def brute(rows, least_docs=3, least_chars=20):
    """Kept text, lines and dropped lines of (doc_id, text) rows."""
    held = defaultdict(list)
    for number, (doc_id, text) in enumerate(rows):
        for key in {x.strip(lines.BLANK).translate(LOW) for x in (text or "").split("\n")}:
            if len(key) >= least_chars:
                held[key].append((doc_id is not None, doc_id or 0, number))
    last = {k: max(v)[:2] for k, v in held.items() if len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        keys = [x.strip(lines.BLANK).translate(LOW) for x in every]
        kept = [x for x, k in zip(every, keys) if last.get(k, (doc_id is not None, doc_id or 0)) == (doc_id is not None, doc_id or 0)]
        out.append((doc_id, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def random_rows(n, seed=1):
    draw = random.Random(seed)
    shared = [f"  A shared Passage number {i} of the corpus É\t" for i in range(30)]
    rows = []
    for i in range(n):
        own = [f"line {i} {j} that only this text holds" for j in range(draw.randint(0, 4))]
        some = draw.choices(shared, k=draw.randint(0, 6)) + ["the hottest line of all, EVERYWHERE\r"] * (i % 3 > 0) + ["short", ""]
        both = own + [x.upper() if draw.random() < 0.2 else x for x in some]
        draw.shuffle(both)
        rows.append((i, "\n".join(both)))
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_equals_plain_version(spark, batches, fanout):
    rows = random_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.digests(docs, batches=batches, fanout=fanout).collect()
    assert bag(map(tuple, got)) == bag(brute(rows))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    shared = "the very same line in many texts"
    more = [(50, shared), (50, shared + "\n" + shared), (7, shared.upper()), (None, shared), (None, shared), (51, "\n".join([shared] * 3000))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], DOCS), allowMissingColumns=True)
    assert bag(map(tuple, lines.digests(docs).collect())) == bag(brute(rows + more))


def test_only_null_ids_hold_it(spark):
    rows = [(None, "a line that only rows without id hold")] * 4 + [(1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(map(tuple, lines.digests(docs).collect())) == bag(brute(rows))


def test_empty(spark):
    assert lines.digests(no_docs(spark)).count() == 0
    assert lines.without_shared_lines(no_docs(spark)).columns == no_docs(spark).columns


def test_texts_and_clashing_columns_stay(spark):
    line = "this line stands in three documents"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}", None) for i in range(3)] + [(9, None, None)], "doc_id long, text string, lang string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("lost", "_lost", "_id", "_body", "_key", "_own", "d", "a", "b", "at", "p.q")])
    got = lines.without_shared_lines(docs)
    assert got.columns == docs.columns
    assert sorted(got.select("doc_id", "text", "lost").collect()) == [(0, "own 0", "x"), (1, "own 1", "x"), (2, f"{line}\nown 2", "x"), (9, None, "x")]


def test_runs_are_levelled_and_leave_out_what_is_settled(spark):
    def batch(rows):
        return spark.createDataFrame([(d, 0, h, h, 0, True) for d, h in rows], "doc_id long, body long, a long, b long, at int, first boolean")

    with lines.LineRuns(spark, fanout=3, buckets=2) as runs:
        runs.add(batch([(9, 1), (8, 1), (7, 1), (9, 2)]))
        runs.add(batch([(6, 1), (6, 2)]))
        second = spark.table(f"{runs.base}.{runs.levels[0][1]}")
        assert [tuple(r) for r in second.collect()] == [(2, 2, 1, 6)]
        runs.add(batch([(99, 1), (5, 2)]))
        assert [len(level) for level in runs.levels] == [0, 1]
        assert sorted(map(tuple, runs.settled().collect())) == [(1, 1, 99), (2, 2, 9)]
        base = runs.base
    assert base not in [d.name for d in spark.catalog.listDatabases()]


def test_runs_are_merged_without_a_shuffle_of_their_own(spark):
    with lines.LineRuns(spark, buckets=4) as runs:
        rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("body"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("at"), F.lit(True).alias("first"))
        runs.add(rows)
        own = rows.groupBy("a", "b").agg(F.max("doc_id").alias("last"))
        met = own.join(spark.table(f"{runs.base}.{runs.levels[0][0]}").hint("merge"), ["a", "b"], "left_anti")
        plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
