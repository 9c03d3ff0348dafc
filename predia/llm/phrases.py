"""Phrase collocations by SON partitioning.

A phrase of support s over S shards has ceil(s / S) occurrences in at least one of them, whatever the
shards hold. So each of a few shards, itself spread over the cluster, is mined completely at that lower
support, order by order: words, then pairs of locally frequent words, then triples of locally frequent
pairs. The locally frequent phrases of all shards are the candidates, and one more pass counts them
over the whole corpus, by their words and exactly.

Mining counts 64-bit hashes, and what is frequent goes to the tasks as a table of bits of fixed size. A
collision there can only let more phrases through; the last pass counts those too, and by their words,
so the support decides in the end and results are exact at any size. Counts leave a task summed over
blocks of texts, so a hot phrase or language is a few rows.

Defined results: null text is empty, a null lang is `und`; a piece without words has no phrases; repeated
rows count each; equal scores go by frequency, then by the phrase's bytes; empty input gives empty
output; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from predia.llm.words import Words, byte_class, slices
from predia.session import cut

#: Fixed values of the contract.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
WORD = rb"[^\x20\x09.,;:!?\x0A-\x0D]"
LONGEST = 3
SUPPORT = 10
COVERED_PERCENT = 50
SCALE = 1_000_000
BEST = 2000

#: Few shards keep the local support high: ceil(10 / 2) = 5, but 1 from ten shards on, which prunes nothing.
SHARDS = 2
BLOCK_BYTES = 3 << 20
#: Bits of a table of frequent phrases; a power of two. 16 MB, whatever the corpus.
BITS = 1 << 27
_EVEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    h = (a ^ (b * _EVEN + (b >> np.uint64(29)))) * _ODD
    h ^= h >> np.uint64(32)
    h *= _EVEN
    return h ^ (h >> np.uint64(29))


class Block:
    """Phrases of one language's texts: per order the distinct ones as rows of word numbers, counted."""

    def __init__(self, lang: bytes, parts: list[bytes], is_word: np.ndarray, ends: np.ndarray):
        words = Words(parts, is_word)
        self.words, self.n = words.distinct, len(words.ids)
        names = words.distinct.to_pylist()
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, 11) for w in names), np.uint64, len(names))
        self.lang = np.uint64(xxhash.xxh3_64_intdigest(lang, 12))
        self.ids = words.ids.astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(ends[words.flat]), words.starts)
        same = piece[1:] == piece[:-1]
        #: For each order the places where a phrase of so many words starts inside its piece.
        self.at = [np.arange(len(self.ids))]
        for order in range(1, LONGEST):
            before = self.at[-1]
            before = before[before + order < len(self.ids)]
            self.at.append(before[same[before + order - 1]])

    def keep(self, order: int, kept: Callable[[np.ndarray], np.ndarray]) -> None:
        """Keep the places of an order whose keys pass, and longer ones only where all parts passed."""
        at = self.at[order - 1]
        self.at[order - 1] = at = at[kept(self.keys(order, at))]
        if order < LONGEST:
            whole = np.zeros(len(self.ids) + 1, bool)
            whole[at] = True
            longer = self.at[order]
            self.at[order] = longer[whole[longer] & whole[longer + 1]]

    def keys(self, order: int, at: np.ndarray) -> np.ndarray:
        key = np.full(len(at), self.lang, np.uint64) + np.uint64(order)
        for i in range(order):
            key = _mix(key, self.hashes[self.ids[at + i]])
        return key

    def counted(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of an order, and how often each occurs."""
        return np.unique(self.keys(order, self.at[order - 1]), return_counts=True)

    def spelled(self, order: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of an order as text, counted by their words."""
        at = self.at[order - 1]
        code = self.ids[at]
        for i in range(1, order):
            code = np.unique(code, return_inverse=True)[1] * len(self.words) + self.ids[at + i]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        parts = [self.words.take(pa.array(self.ids[at[first] + i])) for i in range(order)]
        return (parts[0] if order == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))), n


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, int, Block]]:
    """(lang, shard, block) of (lang, shard, text) rows. A language's texts of a shard make a block when
    they reach `most` bytes, or as the largest when all that wait are four times as long. A text that
    is longer is cut between two pieces."""
    is_word, ends, stop = byte_class(WORD), byte_class(PIECE_END.encode()), re.compile(PIECE_END.encode())
    held: dict[tuple[str, int], list[bytes]] = {}
    sizes: dict[tuple[str, int], int] = {}

    def flushed(key: tuple[str, int]) -> tuple[str, int, Block]:
        sizes.pop(key)
        return *key, Block(key[0].encode(), held.pop(key), is_word, ends)

    for batch in batches:
        for lang, shard, text in zip(*(batch.column(i) for i in range(3))):
            key = lang.as_py(), shard.as_py()
            for part in slices(text.as_py() or b"", stop, most):
                held.setdefault(key, []).append(part)
                sizes[key] = sizes.get(key, 0) + len(part) + 1
                if sizes[key] >= most:
                    yield flushed(key)
            if sum(sizes.values()) >= 4 * most:
                yield flushed(max(sizes, key=sizes.get))
    for key in list(held):
        yield flushed(key)


# Mining a shard -------------------------------------------------------------------------------

def _in_shard(key: np.ndarray, shard: int) -> np.ndarray:
    return _mix(key, np.full(1, shard, np.uint64))


def _passes(table: np.ndarray, key: np.ndarray, shards: list[int]) -> np.ndarray:
    """Whether a phrase is frequent in any of the shards."""
    out = np.zeros(len(key), bool)
    for shard in shards:
        at = (_in_shard(key, shard) & np.uint64(BITS - 1)).astype(np.int64)
        out |= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
    return out


def _bit_table(keys: DataFrame) -> np.ndarray:
    """A table of BITS bits with those of `key` set: tasks fill pieces of 4 kB, and the driver gets at
    most all pieces, BITS / 8 bytes, however many keys there are."""
    place = keys.select((F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1).alias("place"))  # Spark counts places from 1
    pieces = place.groupBy(F.expr("bitmap_bucket_number(place) - 1").alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    table = np.zeros(BITS // 8, np.uint8)
    for row in pieces.toLocalIterator():
        table[row.piece * len(row.bits):(row.piece + 1) * len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return table


def _local_counts(order: int, tables: dict[int, Broadcast], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, block in _blocks(batches, most):
            for lower in range(1, order):
                block.keep(lower, lambda key, lower=lower: _passes(tables[lower].value, key, [shard]))
            key, n = block.counted(order)
            yield pa.RecordBatch.from_pydict({"key": pa.array(_in_shard(key, shard).view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def mine(rows: DataFrame, support: int, shards: int, block_bytes: int) -> dict[int, Broadcast]:
    """Per order a broadcast table of the phrases that are frequent in a shard, keyed by shard."""
    least = -(-support // shards)
    tables: dict[int, Broadcast] = {}
    for order in range(1, LONGEST + 1):
        counts = rows.mapInArrow(_local_counts(order, tables, block_bytes), "key long, n long")
        frequent = counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        tables[order] = rows.sparkSession.sparkContext.broadcast(_bit_table(frequent))
    return tables


# Counting the union ---------------------------------------------------------------------------

def _global_counts(tables: dict[int, Broadcast], shards: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, block in _blocks(batches, most):
            kind = pa.binary()
            yield _counts(lang, 0, pa.array([b""], kind), np.array([block.n]))
            for order in range(1, LONGEST + 1):
                # A phrase that is frequent in one shard has all its parts frequent there.
                block.keep(order, lambda key, order=order: _passes(tables[order].value, key, list(range(shards))))
                yield _counts(lang, order, *block.spelled(order))

    return run


def _counts(lang: str, order: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(n), pa.string()), "size": pa.array(np.full(len(n), order, np.int32)),
        "phrase": phrases.cast(pa.string()), "n": pa.array(n.astype(np.int64)),
    })


def _sharded(docs: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), F.col("text").cast("binary"))


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to 3 words with the support, and (lang, n) of all words."""
    rows = _sharded(docs, shards)
    tables = mine(rows, support, shards, block_bytes)
    whole = rows.withColumn("shard", F.lit(0))
    counts = whole.mapInArrow(_global_counts(tables, shards, block_bytes), "lang string, size int, phrase string, n long")
    kept = cut(counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= support)))
    for table in tables.values():
        table.unpersist()
    return kept.filter("size > 0"), kept.filter("size = 0").select("lang", "n")


# Scores ---------------------------------------------------------------------------------------

def _part(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score): every phrase at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = [
        F.when(F.col("size") == size, F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))
            for k in range(1, size) for side, part in ((0, _part(words, 1, k)), (1, _part(words, k + 1, size - k)))
        ]))
        for size in range(2, LONGEST + 1)
    ]
    parts = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.inline(F.coalesce(*cuts)))
    known = counts.filter(F.col("size") < LONGEST).select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    sides = parts.join(known, ["lang", "part"]).groupBy("lang", "size", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("m"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("r"))
    wide = {c: f"CAST({c} AS DECIMAL(15,0))" for c in "alr"}  # products of up to 38 digits stay exact
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return sides.groupBy("lang", "size", "phrase", "a").agg(lowest).select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Without the phrases that stand, often enough, inside a longer one."""
    words = F.split("phrase", " ")
    inner = [_part(words, start, size) for size in range(2, LONGEST) for start in range(1, LONGEST - size + 2)]
    longer = phrases.filter(F.col("size") == LONGEST).select("lang", F.col("a").alias("f"), F.explode(F.array(*inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    joined = phrases.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a"))).drop("f")


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counts, totals = phrase_counts(docs, support, shards, block_bytes)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = uncovered(scored(counts)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
