"""Fingerprints, license scan, quality rules, SimHash and personal data against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from predia.llm import fingerprints, licenses, pii, quality, simhash
from tests.llm.helpers import DOCS, WORDS, bag, hard_docs, no_docs, split_words


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# Fingerprints


def test_fingerprint_digests(spark):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(["abc def", "", None, "x" * 9, "one two three four five six"])], DOCS)
    rows = sorted(rows_of(docs), reverse=True)
    expected = []
    for i, (key, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        expected.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.fingerprints(docs).collect()
    assert bag(tuple(r)[:3] for r in got) == bag(expected)


def test_fingerprint_hard_rows(spark):
    got = fingerprints.fingerprints(hard_docs(spark)).collect()
    assert len(got) == hard_docs(spark).count()
    same = {r["fingerprint"] for r in got if r["n_chars"] == len("same text in two rows")}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["fingerprint"] == "" for r in got if r["n_chars"] == 0)
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0


def test_one_document_follows_itself(spark):
    got = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f g h", None, None, 0)], DOCS)).first()
    assert got["near_next"] == 1.0


def test_next_over_many_blocks(spark):
    docs = spark.range(500).selectExpr("id * 3 AS doc_id", "concat('t ', id) AS text")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs).collect()}
    assert got == {3 * i: f"t {i - 1 if i else 499}" for i in range(500)}


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(random.Random(1).choice(WORDS) + str(i % 13) for i in range(200))
    row = spark.createDataFrame([(text,)], "text string").select(
        fingerprints.text_anchors(fingerprints.F.col("text")).alias("a"), fingerprints.word_hashes(fingerprints.F.col("text")).alias("h")
    ).first()
    h, k = row["h"], fingerprints.K
    assert h == [xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (xxhash.xxh64_intdigest(w, 42) >> 63) for w in text.split()]
    expected = [i for i in range(len(h) - k + 1) if min(h[i:i + k]) in (h[i], h[i + k - 1])]
    assert [a["at"] for a in row["a"]] == expected


def test_anchors_find_a_moved_passage(spark):
    passage = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 5))
    docs = spark.createDataFrame([(1, passage), (2, "some words before " + passage)], "doc_id long, text string")
    best = fingerprints.aligned(docs.filter("doc_id = 1"), docs).orderBy("n", ascending=False).first()
    assert (best["other_id"], best["shift"]) == (2, 3) and best["n"] >= 10


# License scan


def plain_scan(text: str):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(licenses.WORD, lowered)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        here = [i for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


NOTICES = ["Released under the MIT License.", "the MIT  license; mit LICENSE", "Apache-License apache license", "GNU general public license v3",
           "general public licenses", "Mıt license", *[t for _, t, _ in licenses.TEMPLATES]]


def test_license_base(spark):
    docs = spark.createDataFrame([(i, f"{WORDS[i % 10]} {t} end", None, None, 0) for i, t in enumerate(NOTICES)], DOCS)
    texts = dict(rows_of(docs))
    for r in licenses.scan(docs).collect():
        assert tuple(r)[1:6] == plain_scan(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_templates_are_found_when_changed_a_little(spark):
    long = [(label, w) for label, w, _ in licenses.TEMPLATES if len(w.split()) > 18]
    rows = []
    for i, (_, wording) in enumerate(long):
        words = wording.split()
        words[9] = "changed"
        rows.append((i, "before it " + " ".join(words[:13] + ["added"] + words[13:]) + " and after it"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs).collect()}
    assert len(long) > 4 and all(label in got[i] for i, (label, _) in enumerate(long))


NEAR = {
    "Licensed under CC.": "", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Released under the stars they slept": "", "Released under the MIT License": "mit", "all rights reserved": "",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "License the under released. MIT the under license released.": "", "license mit the under released": "",
    "4.0 CC under licensed BY. Licensed by under CC 4.0": "",
    "This work is licensed under terms. No part of this work may be sold.": "",
}


def brute_labels(text, k=licenses.K):
    """Labels and score by plain voting: all diagonals, merged, and the longest ascending chain by quadratic search."""
    words = licenses.plain_words(text or "")
    best = {}
    for label, wording, needed in licenses.TEMPLATES:
        wanted = licenses.plain_words(wording)
        votes = [(p, a) for p in range(len(words) - k + 1) for a in range(len(wanted) - k + 1) if words[p:p + k] == wanted[a:a + k]]
        diagonals = sorted({p - a for p, a in votes})
        runs = [[d] for d in diagonals[:1]]
        for d in diagonals[1:]:
            runs[-1].append(d) if d - runs[-1][-1] <= licenses.GAP else runs.append([d])
        for run in runs:
            own = sorted((v for v in votes if v[0] - v[1] in run), key=lambda v: (v[0], -v[1]))
            longest = []
            for p, a in own:
                longest.append(max((c for c in longest if c[-1][0] < p and c[-1][1] < a), key=len, default=[]) + [(p, a)])
            full = {len(c) for c in longest}
            for c in (c for c in longest if len(c) == max(full)):
                covered = {a + i for _, a in c for i in range(k)}
                if len(covered) / len(wanted) >= licenses.COVER and all(
                    any(f" {n} " in f" {' '.join(wanted[a:a + k])} " for _, a in c) for n in needed.split(";") if n):
                    best[label] = max(best.get(label, 0), len(covered) / len(wanted))
    return best


def test_license_near_misses(spark):
    docs = spark.createDataFrame(list(enumerate(NEAR)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()}
    for i, (text, labels) in enumerate(NEAR.items()):
        found = brute_labels(text)
        assert got[i][0] == labels == ",".join(sorted(found)), text
        assert 0 <= got[i][1] <= 1


def test_license_labels_equal_plain_voting(spark):
    import random

    draw, rows = random.Random(5), []
    for i in range(60):
        words = []
        for _ in range(3):
            own = draw.choice(licenses.TEMPLATES)[1].split()
            a = draw.randrange(len(own))
            words += draw.choice([own, own[a:], own[:a], [w for w in own if draw.random() > 0.1]]) + ["filler"] * draw.randint(0, 3)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        found, base = brute_labels(rows[r.doc_id][1]), [x for x in r.base_labels.split(",") if x]
        assert r.labels == ",".join(sorted({*found, *base}))
        assert r.score == pytest.approx(1.0 if base else max(found.values(), default=0.0))


def test_license_hard_rows(spark):
    docs = hard_docs(spark)
    got = licenses.scan(docs).collect()
    assert bag((r["doc_id"], *tuple(r)[1:6]) for r in got) == bag((k, *plain_scan(t)) for k, t in rows_of(docs))
    assert all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert licenses.scan(no_docs(spark)).count() == 0


# Quality rules


def plain_quality(text: str):
    words = split_words(text)
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if split_words(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    draw = random.Random(5)
    extra = [(100 + i, "".join(draw.choice(["a ", "b ", "c\n", "# ", "é ", "x y z ", "\n"]) for _ in range(draw.randrange(120))), "en", "s", 0)
             for i in range(200)]
    docs = hard_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS))
    got = quality.judge(docs).collect()
    assert bag((r["doc_id"], *tuple(r)[1:7]) for r in got) == bag((k, *plain_quality(t)) for k, t in rows_of(docs))
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_hard_rows_and_none(spark):
    docs = hard_docs(spark)
    assert quality.judge(docs).count() == docs.count()
    kept = quality.kept(docs)
    assert kept.columns == docs.columns
    assert quality.judge(no_docs(spark)).count() == 0 and quality.kept(no_docs(spark)).count() == 0


def test_kneser_ney_sums_to_one():
    draw = np.random.default_rng(3)
    symbols = draw.choice(quality.CLASSES, 4000, p=draw.dirichlet(np.ones(quality.CLASSES) * 0.2))
    codes = np.zeros(len(symbols) - 3, np.int64)
    for back in range(4):
        codes = codes * quality.CLASSES + symbols[back:len(symbols) - 3 + back]
    keys, n = np.unique(codes, return_counts=True)
    model = quality.kneser_ney(keys, n)
    for context in (int(codes[5]) // 64, int(codes[77]) // 64, 12345):
        each = (context * 64 + np.arange(64)).astype(np.uint32)
        assert abs(np.exp(quality.log_probability(model, each).astype(float)).sum() - 1) < 1e-3


def test_odd_text_is_rejected_and_plain_text_is_kept(spark):
    draw = random.Random(2)
    plain = [" ".join(draw.choice(WORDS) for _ in range(80)) for _ in range(300)]
    odd = "".join(chr(draw.randrange(33, 127)) + " " * (i % 5 == 0) for i in range(600))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*plain, odd])], DOCS)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert not kept[300] and sum(kept.values()) == 300


# SimHash


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, values):
    values = np.array(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    labels = np.arange(len(ids))
    while True:
        new = np.array([labels[row].min() for row in near])
        if (new == labels).all():
            break
        labels = new
    least = {g: min((i for i, own in zip(ids, labels) if own == g and i is not None), default=None) for g in labels}
    return [least[g] for g in labels]


def near_texts(n: int = 120):
    draw = random.Random(4)
    texts = []
    for i in range(n):
        base = [draw.choice(WORDS) + str(draw.randrange(99)) for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(i % 4):
            base[draw.randrange(len(base))] = "new"
            texts.append(" ".join(base))
    return texts


def test_simhash_hard_rows(spark):
    docs = hard_docs(spark)
    rows = rows_of(docs)
    values = [plain_fingerprint(t) for _, t in rows]
    expected = zip([k for k, _ in rows], [f"{v:016x}" for v in values], plain_components([k for k, _ in rows], values))
    assert bag(tuple(r) for r in simhash.near_duplicates(docs).collect()) == bag(expected)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.first_of_each(docs).columns == docs.columns


@pytest.mark.parametrize(("tile", "words"), [(2048, 4), (2, 4), (3, 8)])
def test_simhash_components(spark, tile, words):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    expected = plain_components(range(len(texts)), [plain_fingerprint(t) for t in texts])
    assert len(set(expected)) < len(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs, tile=tile, words=words).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_long_chains_are_one_component(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in simhash.connected(edges).collect()} == {0}


def test_first_of_each(spark):
    docs = spark.createDataFrame([(5, "a b c d", "x", "s", 1), (2, "a b c d", "x", "s", 1), (9, "other words here", "x", "s", 1)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.first_of_each(docs).collect()) == [2, 9]


# Personal data


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15),
}


def plain_spans(text: str):
    found = []
    for i, (kind, (pattern, holds)) in enumerate(RULES.items()):
        found += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text) if holds(m.group())]
    return sorted(found)


def shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check_base(docs):
    expected = []
    for key, text in rows_of(docs):
        spans = plain_spans(text)
        expected.append((key, *[sum(s[3] == k for s in spans) for k in RULES], hashlib.sha256(shown(spans).encode()).hexdigest()))
    assert bag(tuple(r)[:6] for r in pii.find(docs).collect()) == bag(expected)


def test_personal_data_hard_rows(spark):
    check_base(hard_docs(spark))
    assert pii.find(no_docs(spark)).count() == 0


def test_personal_data_fuzz(spark):
    draw = random.Random(3)
    parts = ["a@b.c", "1", "2", " ", "-", "+", ".", "@", "é", "_", "\n", "255", "192.168.1.1", "+49 30 123456-7", "4111 1111 1111 1111", "x"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(60))), None, None, 0) for i in range(1500)]
    check_base(spark.createDataFrame(rows, DOCS))


def contexts(spark):
    rows = [(i, f"so please call phone number +1 555 010 {1000 + i} by day", None, None, 0) for i in range(20)]
    rows += [(50, "or else phone number (555-867-5309), thanks", None, None, 0), (51, "the other part 555-867-5309 is fine", None, None, 0)]
    return spark.createDataFrame(rows, DOCS)


def test_contexts_discover_what_no_rule_knows(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.find(contexts(spark)).collect()}
    assert got[50] == "phone:22:34" and got[51] == ""


def test_redaction(spark):
    got = {r["doc_id"]: r["text"] for r in pii.redacted(contexts(spark)).collect()}
    assert got[50] == "or else phone number ([PHONE]), thanks" and got[51] == "the other part 555-867-5309 is fine"
    assert got[3] == "so please call phone number [PHONE] by day"
    docs = hard_docs(spark)
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == docs.count()


def test_digit_runs_stay_fast(spark):
    text = "1" * 60_000 + " " + "a" * 60_000 + " " + "1 " * 5000
    assert pii.find(spark.createDataFrame([(1, text, None, None, 0)], DOCS)).first()["n_card"] == len(
        [s for s in plain_spans("1 " * 5000) if s[3] == "card"])
