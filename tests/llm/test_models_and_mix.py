"""Mixing, language-model scoring, BPE and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from predia.llm import bpe, mixing, queries, scoring
from tests.llm.helpers import DOCS, WORDS, bag, hard_docs, hard_texts, no_docs, split_words
from tests.llm.test_texts import plain_components, plain_fingerprint, plain_quality, plain_spans

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# Mixing


def plain_targets(sizes: dict):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in order if s not in stopped)
        level = left / open_ if open_ else 0
        more = {s for s in order if s not in stopped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= more


def check_mix(docs, near: float | None = None):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(split_words(r["text"]))
    targets = plain_targets(sizes)
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((r["doc_id"], len(split_words(r["text"]))) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(targets[s], 6)) for s in sizes}
    by: dict = {}
    for r in got:
        key = (r["source_size"], round(r["target"], 6))
        by.setdefault(key, [0, 0, r["target"]])
        by[key][0] += r["taken"]
        by[key][1] = max(by[key][1], r["size"])
    if near is not None:
        assert all(abs(taken - target) <= max(largest, near * target) for taken, largest, target in by.values())
    return got


def mix_docs(spark, n: int = 3000):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * int(draw.paretovariate(1.2))), None, f"s{0 if i % 3 else i % 7}", 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_comes_near_its_targets(spark):
    check_mix(mix_docs(spark), 0.01)


def test_mix_is_whole_over_several_levels(spark):
    sized = mix_docs(spark).select("doc_id", "source", mixing.n_words().alias("size"))
    rows = mixing.copies(sized, block=4).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert rows and all(abs(r["taken"] - r["target"]) <= r["most"] for r in rows)


@pytest.mark.parametrize("share", [0.73, 1.6])
def test_a_large_document_does_not_keep_its_source_from_the_target(spark, share):
    """49 small documents and one that holds most of the source's target: the small ones make up for it."""
    rows = [(i, "w " * (20 + i % 7), f"s{s}") for s in range(12) for i in range(s * 100, s * 100 + 49)]
    small = sum(20 + i % 7 for i in range(49))
    rows += [(s * 100 + 99, "big " * int(small * share / 0.9), f"s{s}") for s in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by: dict = {}
    for r in mixing.mix(docs).collect():
        target, taken = by.setdefault(r["doc_id"] // 100, [r["target"], 0])
        by[r["doc_id"] // 100][1] += r["taken"]
    assert all(abs(taken - target) <= 27 for target, taken in by.values())


def test_mix_runs_agree(spark):
    docs = mix_docs(spark)
    one, two = ({(r["doc_id"], r["taken"]) for r in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert one == two


def test_mix_hard_rows(spark):
    check_mix(hard_docs(spark))
    assert mixing.mix(no_docs(spark)).count() == 0
    docs = hard_docs(spark)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = sum(len(split_words(r["text"])) for r in mixed.select("text").collect())
    assert words == sum(r["taken"] for r in mixing.mix(docs).collect())
    assert mixing.mixed(no_docs(spark)).count() == 0


# Scoring


def scored(spark):
    draw = random.Random(6)
    pairs = [("red", "green", "blue"), ("one", "two", "three"), ("sun", "moon", "star")]
    texts = [" ".join(" ".join(draw.choice(pairs)) for _ in range(30)) for _ in range(200)]
    return spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)


def test_training_learns_both_sides(spark):
    docs = scored(spark)
    words = scoring.vocabulary(docs)
    net, losses = scoring.train(scoring.window_counts(docs, words), rounds=8)
    assert losses[-1] < 0.4 * losses[0] and losses[-1] < np.log(9) / 2
    fair, swapped = "sun moon star one two three", "sun one star moon two three"
    got = {r["doc_id"]: r["log_likelihood"] for r in scoring.score(
        spark.createDataFrame([(1, fair, None, None, 0), (2, swapped, None, None, 0)], DOCS), net, words).collect()}
    assert got[1] > got[2] + 3


def test_scores_are_sums_of_masked_predictions(spark):
    docs = scored(spark)
    words = scoring.vocabulary(docs)
    net, _ = scoring.train(scoring.window_counts(docs, words), rounds=1)
    lookup = scoring.Lookup({w.encode(): i for i, w in enumerate(words)})
    parts = scoring.unflat(net)
    for r in scoring.score(docs.limit(3), net, words).collect():
        text = docs.filter(F.col("doc_id") == r["doc_id"]).first()["text"]
        line = [scoring.EDGE, *[lookup[w] for w in text.encode().split()], scoring.EDGE]
        total = 0.0
        for i in range(1, len(line) - 1):
            hidden = np.tanh(parts["left"][line[i - 1]] + parts["right"][line[i + 1]] + parts["bias"])
            logits = (hidden @ parts["out"] + parts["base"]).astype(float)
            total += logits[line[i]] - np.log(np.exp(logits).sum())
        assert r["n_tokens"] == len(line) - 2 and r["log_likelihood"] == pytest.approx(total, rel=1e-4)


def test_gradient_is_right():
    net, (contexts, middle, n) = scoring.start(), (np.array([5, 5, 9]), np.array([1, 2, 1]), np.array([3, 1, 2]))
    after, before = scoring.trained(net, contexts, middle, n, passes=1, steps=1, rate=1e-3)
    assert scoring.trained(after, contexts, middle, n, passes=1, steps=1)[1] < before


def test_window_counts_cover_all_words(spark):
    docs = hard_docs(spark)
    counted = scoring.window_counts(docs, scoring.vocabulary(docs)).agg(F.sum("n")).first()[0]
    assert counted == sum(len(split_words(r["text"])) for r in docs.select("text").collect())


def test_scoring_hard_rows(spark):
    docs = hard_docs(spark)
    got = scoring.pseudo_likelihood(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_tokens"] > 0) == (r["perplexity"] is not None) for r in got)
    assert scoring.pseudo_likelihood(no_docs(spark)).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_texts():
    draw = random.Random(1)
    mixed = ["".join(draw.choice("ab é日1 \n'") for _ in range(200)) for _ in range(150)]
    return [t or "" for t in hard_texts()] + ["aaaaaaaaaaaaa", " " * 50 + "x", "don't I'll WE'VE", "é" * 300, "<|endoftext|>", *mixed]


@pytest.mark.parametrize("chars", [bpe.BLOCK_CHARS, 300])
def test_bpe_equals_the_library(spark, tokenizer, chars):
    texts = bpe_texts()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, most_chars=chars).collect()}
    assert [got[i] for i in range(len(texts))] == [tokenizer.encode_ordinary(t) for t in texts]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def digests_of(tokenizer, key, text):
    ids = tokenizer.encode_ordinary(text)
    return key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe_hard_rows(spark, tokenizer):
    docs = hard_docs(spark)
    expected = [digests_of(tokenizer, r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert bag(tuple(r) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()) == bag(expected)
    assert bpe.digests(no_docs(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_merge_that_makes_an_earlier_one_possible():
    ranks = {bytes([b]): b + 10 for b in range(256)}
    ranks |= {b"ab": 400, b"abc": 5, b"cab": 401, b"bc": 402}
    voc = bpe.Vocabulary(ranks)
    words = [b"ab", b"abcab", b"cabc", b"abab", b"aabcc"]
    ids, counts = bpe.replay(voc, words)
    ends = np.cumsum(counts)
    got = [ids[e - c:e].tolist() for e, c in zip(ends, counts)]
    assert got == [[ranks[w]] if w in ranks else bpe.merge_one(voc, w) for w in words]


# Pipeline and registration

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are absent")


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    expected = con.execute(queries.ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert bag(tuple(r) for r in got.select(names).collect()) == bag(expected.fetchall())


def test_pipeline_against_plain_stages(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "byte_bpe"]

    kept = stages["quality_rules"](spark, docs, DATA).persist()
    passed = {k for k, t in given.items() if not plain_quality(t)[-1]}
    left = {r["doc_id"] for r in kept.collect()}
    assert left <= passed and len(left) > 0.97 * len(passed)

    single = stages["near_duplicates"](spark, kept, DATA).persist()
    ids = sorted(left)
    firsts = set(plain_components(ids, [plain_fingerprint(given[i]) for i in ids]))
    assert {r["doc_id"] for r in single.collect()} == firsts

    masked = stages["personal_data"](spark, single, DATA).persist()
    for r in masked.collect():
        spans = plain_spans(given[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and (spans or r["text"] == given[r["doc_id"]])
        assert not any(given[r["doc_id"]][a:b] in r["text"] for a, _, b, k in spans if k == "email")

    mixed = stages["source_mix"](spark, masked, DATA).persist()
    assert mixed.columns == docs.columns
    taken: dict = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(split_words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == {r["doc_id"]: r["taken"] for r in mixing.mix(masked).collect() if r["taken"]}

    coded = stages["byte_bpe"](spark, mixed, DATA)
    expected = [digests_of(tokenizer, r["doc_id"], r["text"]) for r in mixed.collect()]
    assert bag(tuple(r) for r in coded.collect()) == bag(expected)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_hard_rows_through_all_stages(spark):
    docs = hard_docs(spark, clash=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() >= 0
    empty = no_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_words_in_samples():
    assert len(set(WORDS)) == 10
