"""Ranked lexical search by Block-Max MaxScore over shards of documents.

A task indexes the documents it reads in shards of bounded size. A posting list is cut into blocks; a
block is stored compressed, and beside it stand its last document, its largest tf and its least
document length, which bound every score in it whatever the corpus statistics turn out to be. So one
pass over the texts builds the index, and the statistics are sums over its small columns.

A query meets each shard's lists in windows of documents. Lists whose bounds together cannot exceed the
tenth score so far are non-essential: the others are read, and their documents are the candidates. A
candidate is dropped when its score so far and the block maxima of the rest cannot exceed the tenth,
before any of those blocks is decompressed. Shards give their ten best, which are merged.

The index holds the terms that the items ask for; where those are more than `most_terms`, all terms.
Items are searched in blocks, each a job over the same written index.

Defined results: null texts have no terms; a document without terms is not counted; a row is a
document, so repeated rows are ranked each; a null doc_id comes after all others among equal scores;
each row of the items is a query, so a repeated item_id has a ranking for each; an item without terms,
or whose terms weigh nothing, has no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from predia.llm.words import Words, byte_class, slices
from predia.session import scratch_path

#: Fixed values of the contract.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BEST = 10
UNIT = 1_000_000_000
B_PERCENT = 90

BLOCK = 128
WINDOW = 2048
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 32 << 20
MOST_TERMS = 200_000
ITEMS = 1000
NO_ID = np.iinfo(np.int64).max
INDEX = (
    "shard string, term binary, n long, last array<int>, most_tf array<int>, least_n array<int>, blocks array<binary>, "
    "ids array<long>, sizes array<long>, held long, words long"
)


# Blocks ---------------------------------------------------------------------------------------

def _width(values: np.ndarray) -> int:
    top = int(values.max())
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def pack(docs: np.ndarray, tf: np.ndarray, before: int) -> bytes:
    """Ascending document numbers as gaps, then their counts, each in the least width that fits; the two
    widths stand in front."""
    gaps = np.diff(docs, prepend=before)
    wide, tf_wide = _width(gaps), _width(tf)
    return bytes((wide, tf_wide)) + gaps.astype(f"<u{wide}").tobytes() + tf.astype(f"<u{tf_wide}").tobytes()


def unpack(block: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    wide, tf_wide = block[0], block[1]
    n = (len(block) - 2) // (wide + tf_wide)
    gaps = np.frombuffer(block, f"<u{wide}", n, 2)
    return np.cumsum(gaps, dtype=np.int64) + before, np.frombuffer(block, f"<u{tf_wide}", n, 2 + n * wide).astype(np.int64)


# Index ----------------------------------------------------------------------------------------

class _Shard:
    """Postings of the documents of a shard, gathered chunk by chunk."""

    def __init__(self, wanted: dict[bytes, int] | None):
        self.wanted, self.terms = wanted, {} if wanted is None else wanted
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, rows: list[int], parts: list[bytes], is_word: np.ndarray) -> None:
        words = Words(parts, is_word)
        rows_at = np.array(rows)
        self.sizes.append(np.stack([rows_at, words.counts]))
        distinct = words.distinct.to_pylist()
        if self.wanted is None:
            known = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in distinct), np.int64, len(distinct))
        else:
            known = np.fromiter((self.wanted.get(w, -1) for w in distinct), np.int64, len(distinct))
        term = known[words.ids]
        kept = term >= 0
        key, tf = np.unique(term[kept] << 32 | rows_at[words.part[kept]], return_counts=True)
        self.found.append((key >> 32, key & 0xFFFFFFFF, tf))
        self.bytes += sum(map(len, parts))

    def record(self, shard: str) -> pa.RecordBatch:
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        sizes = np.zeros(len(ids), np.int64)
        for rows, counts in self.sizes:
            np.add.at(sizes, number[rows], counts)
        term, row, tf = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        key = term << 32 | number[row]
        order2 = np.argsort(key, kind="stable")
        key, tf = key[order2], tf[order2]
        if len(key):  # a long text lies in several chunks
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, tf = key[first], np.add.reduceat(tf, first)
        term, doc = key >> 32, key & 0xFFFFFFFF
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, np.int64)
        names, size_at = list(self.terms), sizes[doc]
        out: dict[str, list] = {c: [] for c in ("term", "n", "last", "most_tf", "least_n", "blocks")}
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            cuts = np.arange(a, b, BLOCK)
            ends = [*cuts[1:].tolist(), b]
            out["term"].append(names[term[a]])
            out["n"].append(b - a)
            out["last"].append(doc[np.array(ends) - 1])
            out["most_tf"].append(np.maximum.reduceat(tf[:b], cuts))
            out["least_n"].append(np.minimum.reduceat(size_at[:b], cuts))
            out["blocks"].append([pack(doc[s:e], tf[s:e], doc[s - 1] if s > a else -1) for s, e in zip(cuts.tolist(), ends)])
        n = len(out["term"])
        ids = ids[order]
        return pa.RecordBatch.from_pydict({
            "shard": [shard] * (n + 1), "term": pa.array([*out["term"], None], pa.binary()), "n": pa.array([*out["n"], None], pa.int64()),
            **{c: pa.array([*out[c], None], pa.list_(pa.int32())) for c in ("last", "most_tf", "least_n")},
            "blocks": pa.array([*out["blocks"], None], pa.list_(pa.binary())),
            "ids": pa.array([None] * n + [ids], pa.list_(pa.int64())), "sizes": pa.array([None] * n + [sizes], pa.list_(pa.int64())),
            "held": pa.array([None] * n + [int((sizes > 0).sum())], pa.int64()), "words": pa.array([None] * n + [int(sizes.sum())], pa.int64()),
        })


def _index(wanted: dict[bytes, int] | None, chunk_bytes: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, stop = ~byte_class(BREAK.encode()), re.compile(BREAK.encode())
        task, made, shard = TaskContext.get().partitionId(), 0, _Shard(wanted)
        rows, parts, size = [], [], 0
        for doc_id, text in chain.from_iterable(zip(b.column(0), b.column(1)) for b in batches):
            shard.ids.append(doc_id.as_py())
            for part in slices(text.as_py() or b"", stop, chunk_bytes):
                rows.append(len(shard.ids) - 1)
                parts.append(part)
                size += len(part) + 1
                if size >= chunk_bytes:
                    shard.add(rows, parts, is_word)
                    rows, parts, size = [], [], 0
            if shard.bytes + size >= shard_bytes:
                if parts:
                    shard.add(rows, parts, is_word)
                yield shard.record(f"{task}-{made}")
                made, shard = made + 1, _Shard(wanted)
                rows, parts, size = [], [], 0
        if parts:
            shard.add(rows, parts, is_word)
        if shard.ids:
            yield shard.record(f"{task}-{made}")

    return run


def build(docs: DataFrame, wanted: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of (doc_id, text), written in the shared folder: a row per shard and term, and one per
    shard with its documents. `wanted` limits it to these terms."""
    numbers = None if wanted is None else {t.encode(): i for i, t in enumerate(wanted)}
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    path = scratch_path(docs.sparkSession, "search_index")
    rows.mapInArrow(_index(numbers, chunk_bytes, shard_bytes), INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


# Search ---------------------------------------------------------------------------------------

class _List:
    """A posting list: what bounds its blocks, and the blocks themselves, unpacked when first needed."""

    def __init__(self, row, quality):
        self.last = np.asarray(row.last, np.int64)
        self.before = np.concatenate([[-1], self.last[:-1]])
        self.bound = quality(np.asarray(row.most_tf, np.int64), np.asarray(row.least_n, np.int64))
        self.top = int(self.bound.max())
        self.blocks, self.open = row.blocks, {}

    def block(self, i: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            docs, tf = unpack(self.blocks[i], int(self.before[i]))
            self.open[i] = docs, _quality(tf, m[docs])
        return self.open[i]


def _quality(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 8 * m)


def _m(n: np.ndarray, held: int, words: int) -> np.ndarray:
    return 100 - B_PERCENT + B_PERCENT * n * held // words


def best_of_shard(lists: list[tuple[int, _List]], m: np.ndarray, best: int = BEST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The best documents of a shard for one query of (weight, list): numbers and scores, best first.

    Numbers ascend with doc_id and windows are taken in their order, so a document that only equals
    the last of the best so far can never displace it.
    """
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda e: e[0] * e[1].top)
    reach = np.cumsum([w * x.top for w, x in lists])
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(m), window):
        high = min(low + window, len(m))
        essential = int(np.searchsorted(reach, least, side="right"))
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for w, x in lists[essential:]:
            for i in range(int(np.searchsorted(x.last, low)), min(int(np.searchsorted(x.last, high - 1)) + 1, len(x.last))):
                at, quality = x.block(i, m)
                a, b = np.searchsorted(at, (low, high))
                sums[at[a:b] - low] += w * quality[a:b]
        near = np.flatnonzero(sums)
        held = sums[near]
        near += low
        if essential and len(near):
            at = np.stack([np.searchsorted(x.last, near) for _, x in lists[:essential]])
            bound = np.stack([w * np.append(x.bound, 0)[i] for (w, x), i in zip(lists, at)])
            most = held + bound.sum(0)
            for k in reversed(range(essential)):
                still = most > least
                near, held, most, at, bound = near[still], held[still], most[still], at[:, still], bound[:, still]
                if not len(near):
                    break
                w, x = lists[k]
                exact = np.zeros(len(near), np.int64)
                for i in np.unique(at[k][bound[k] > 0]):
                    inside = np.flatnonzero(at[k] == i)
                    there, quality = x.block(int(i), m)
                    place = np.searchsorted(there, near[inside])
                    hit = there[place] == near[inside]
                    exact[inside[hit]] = w * quality[place[hit]]
                held = held + exact
                most = most - bound[k] + exact
        fits = held > least
        if fits.any():
            docs, scores = np.concatenate([docs, near[fits]]), np.concatenate([scores, held[fits]])
            order = np.lexsort((docs, -scores))[:best]
            docs, scores = docs[order], scores[order]
            if len(docs) == best:
                least = int(scores[-1])
    return docs, scores


def _search(queries: list[tuple[int, int | None, list[bytes]]], weights: dict[bytes, int], held: int, words: int, best: int, window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        rows = shard[shard["ids"].notna()].iloc[0]
        m = _m(np.asarray(rows["sizes"], np.int64), held, words)
        ids = np.asarray(rows["ids"], np.int64)
        quality = lambda tf, n: _quality(tf, _m(n, held, words))
        lists = {r.term: _List(r, quality) for r in shard[shard["ids"].isna()].itertuples(index=False)}
        out: list[tuple] = []
        for query, item_id, terms in queries:
            docs, scores = best_of_shard([(weights[t], lists[t]) for t in terms if t in lists], m, best, window)
            out += [(query, item_id, None if ids[d] == NO_ID else int(ids[d]), int(s)) for d, s in zip(docs, scores)]
        frame = pd.DataFrame(out, columns=["query", "item_id", "doc_id", "score"])
        return frame.astype({"query": "int64", "item_id": "Int64", "doc_id": "Int64", "score": "int64"})

    return run


def weight(df: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * held + 2) / (2 * df + 1)))


def terms(text):
    """The distinct terms of a text column."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lowered, BREAK + "+"), lambda t: t != ""))


def rank(
    docs: DataFrame, items: DataFrame, best: int = BEST, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES, most_terms: int = MOST_TERMS, items_a_block: int = ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of (doc_id, text) for each row of (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint"), terms(F.col("text")).alias("terms"))
    found = asked.select(F.explode("terms").alias("term")).distinct().limit(most_terms + 1).collect()
    wanted = sorted(r.term for r in found) if len(found) <= most_terms else None
    index = build(docs, wanted, chunk_bytes, shard_bytes)
    held, words = index.agg(F.sum("held"), F.sum("words")).first()
    result = spark.createDataFrame([], "query long, item_id long, doc_id long, score long")
    blocks = math.ceil(asked.count() / items_a_block) if words else 0
    path = scratch_path(spark, "search_items")
    asked.withColumn("query", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(blocks, 1)))).write.parquet(path)
    given = spark.read.parquet(path)
    for block in range(blocks):
        own = given.filter(F.col("block") == block)
        queries = [(r.query, r.item_id, [t.encode() for t in r.terms]) for r in own.collect()]
        names = own.select(F.explode("terms").alias("term")).select(F.col("term").cast("binary")).distinct()
        lists = index.join(names, "term", "left_semi")
        weights = {bytes(r.term): weight(r.df, held) for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        rows = lists.select(index.columns).unionByName(index.filter("ids IS NOT NULL"))
        kind = "query long, item_id long, doc_id long, score long"
        result = result.unionByName(rows.groupBy("shard").applyInPandas(_search(queries, weights, held, words, best, window), kind))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")
