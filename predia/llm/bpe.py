"""Byte-level BPE by merge replay over a corpus block.

A task gathers the distinct words of its documents in blocks bounded by text and vocabulary size.
All words of a block are laid out as one array of byte tokens with links to their neighbours, and an
inverted index from the rank of a token pair to the positions that hold it lets every merge be
applied once for the whole block, in rank order, touching only the neighbours of merged positions.
Documents then take their ids from the words. Nothing is shuffled and no task sees more than its own
documents: a word table over the whole corpus would have to move every occurrence to it and back.

Defined results: null text is an empty text with no tokens; unpaired surrogates cannot occur in a
Spark string; repeated rows are encoded alike; empty input gives empty output.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 12_000_000
BLOCK_WORDS = 200_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a tiktoken file: the id of a token is the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 2
        self.stop = size - 1  # no token: stands between words
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.size = size
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)
        tokens = sorted(ranks, key=ranks.get)
        self.lengths = np.zeros(size, np.int64)
        self.lengths[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.offsets[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def merge_one(voc: Vocabulary, word: bytes) -> list[int]:
    """The plain rule for one word: the lowest rank first, the leftmost of equals."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, i = min((voc.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NONE:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [voc.ranks[p] for p in parts]


def replay(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and the number of tokens of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.cumsum(lengths) - 1
    tokens = voc.byte_ids[flat]
    tokens[ends] = voc.stop
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    n = len(tokens)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    # A word that is itself a token is taken whole and never merged.
    whole = np.fromiter((voc.ranks.get(w, -1) for w in words), np.int32, len(words))
    known = whole >= 0
    alive = ~known[word_of]
    starts = ends - lengths + 1
    rank_at = np.full(n, NONE, np.int32)
    open_at = np.flatnonzero(alive & (tokens != voc.stop))
    rank_at[open_at] = voc.pair_rank(tokens[open_at], tokens[after[open_at]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        stop = int(np.searchsorted(ranks, NONE))
        ranks, positions = ranks[:stop], positions[:stop]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), stop]
        for a, b in zip(edges, edges[1:]) if stop else ():
            rank = int(ranks[a])
            if rank in index:
                index[rank].append(positions[a:b])
            else:
                index[rank] = [positions[a:b]]
                heapq.heappush(heap, rank)

    file(open_at, rank_at[open_at])
    odd: set[int] = set()
    while heap:
        rank = heapq.heappop(heap)
        at = index.pop(rank)
        at = np.sort(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
        at = at[rank_at[at] == rank]
        if len(at) > 1:
            # Pairs that overlap in a run of equal tokens: the leftmost wins, then every second.
            chained = np.append(False, after[at[:-1]] == at[1:])
            if chained.any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            at = at[np.append(True, at[1:] != at[:-1])]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        tokens[at] = rank
        after[at] = beyond
        alive[gone] = False
        rank_at[gone] = NONE
        before[beyond[beyond < n]] = at[beyond < n]
        left = before[at]
        touched = np.unique(np.concatenate([at, left[left >= 0]]))
        touched = touched[(tokens[touched] != voc.stop) & alive[touched]]
        new = voc.pair_rank(tokens[touched], tokens[after[touched]])
        early = new < rank
        if early.any():
            odd.update(word_of[touched[early]].tolist())
        rank_at[touched] = new
        file(touched, new)
    keep = alive & (tokens != voc.stop)
    ids, owner = tokens[keep], word_of[keep]
    counts = np.bincount(owner, minlength=len(words)).astype(np.int64)
    single = np.flatnonzero(known)
    if len(single) or odd:
        # Put the whole words, and the few that need the plain rule, in their places.
        fixed = {int(w): merge_one(voc, words[w]) for w in odd}
        if fixed:
            drop = np.isin(owner, np.fromiter(fixed, np.int64, len(fixed)))
            ids, owner = ids[~drop], owner[~drop]
            for w, parts in fixed.items():
                counts[w] = len(parts)
        ids = np.concatenate([ids, whole[single], *(np.array(p, np.int32) for p in fixed.values())])
        owner = np.concatenate([owner, single, *(np.full(len(p), w) for w, p in fixed.items())])
        counts[single] = 1
        ids = ids[np.argsort(owner, kind="stable")]
    return ids, counts


def encode_block(voc: Vocabulary, words: dict[str, int], texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Ids of each text, given as positions in `words`."""
    ids, counts = replay(voc, [w.encode() for w in words]) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    starts = np.cumsum(counts) - counts
    for text in texts:
        yield ids[spread(starts[text], counts[text])] if len(text) else np.zeros(0, np.int32)


def _rows(path: str, pattern: str, batches: Iterator[pa.RecordBatch], most_chars: int, most_words: int):
    """(key values, ids) block by block; keys are the first columns, the text the last."""
    voc, split = vocabulary(path), regex.compile(pattern)
    words: dict[str, int] = {}
    keys, texts, chars = [], [], 0

    def flush():
        done = list(zip(keys, encode_block(voc, words, texts)))
        words.clear(), keys.clear(), texts.clear()
        return done

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(batch.num_columns - 1)):
            text = text.as_py() or ""
            found = split.findall(text)
            keys.append(key.as_py())
            texts.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
            chars += len(text)
            if chars >= most_chars or len(words) >= most_words:
                yield flush()
                chars = 0
    if keys:
        yield flush()


def _digests(path: str, pattern: str, most_chars: int, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for rows in _rows(path, pattern, batches, most_chars, most_words):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for k, _ in rows], pa.int64()),
                "n_tokens": pa.array([len(i) for _, i in rows], pa.int64()),
                "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for _, i in rows],
                "decoded_sha256": [hashlib.sha256(voc.decode(i)).hexdigest() for _, i in rows],
            })

    return run


def _ids(path: str, pattern: str, most_chars: int, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(path, pattern, batches, most_chars, most_words):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([k for k, _ in rows], pa.int64()),
                "ids": pa.array([i for _, i in rows], pa.list_(pa.int32())),
            })

    return run


def encode(docs: DataFrame, path: str, pattern: str, most_chars: int = BLOCK_CHARS, most_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ids) of every document; `path` must lie at the same place on all executors."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(_ids(path, pattern, most_chars, most_words), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            ids = [np.asarray(x.as_py() or [], np.int64) for x in batch.column(1)]
            texts = [voc.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, most_chars: int = BLOCK_CHARS, most_words: int = BLOCK_WORDS) -> DataFrame:
    """Encode and decode every document; what remains are the number of tokens and two digests."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_digests(path, pattern, most_chars, most_words), schema)
