"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are laid into tiles by the population counts of their words of bits. Two
fingerprints within the radius differ by at most the radius in the sum of those counts' differences,
so a tile only meets the tiles around it; every other tile pair is skipped. A tile pair is compared
whole with numpy exclusive-or and bit counts, and gives a spanning forest of its links, never all
its pairs. Linked fingerprints get their component by alternating star steps over checkpointed
tables.

Defined results: null or empty text has fingerprint zero and links like any other; fewer than three
words are one shingle; repeated rows share a fingerprint; a null doc_id takes part and is never the
smallest unless all are null; empty input gives empty output; other columns are ignored by
`components` and carried along by `first_of_each`, which keeps one row of every component, whatever
ids its rows share with those of others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from predia.session import cut

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
TILE = 2048
#: Words of bits per fingerprint, by the number of fingerprints from which they are used.
LAYOUTS = ((0, 4), (1 << 22, 8))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())),
        np.dtype("<u8"), len(words) - shingle + 1,
    )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        got = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_pydict({**{n: batch[n] for n in names}, "fp": pa.array(got.view(np.int64))})


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried, fp) of every document, fp as a signed 64-bit integer like those carried."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), *carried)
    return rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("doc_id", *carried, "fp")))


def _cell(fp: Column, words: int) -> Column:
    """The population counts of the words of bits, packed into one number."""
    width = BITS // words
    mask = F.lit((1 << width) - 1).cast("bigint")
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(mask)).cast("bigint") for i in range(words)]
    total = counts[0]
    for i, c in enumerate(counts[1:], 1):
        total = total + c * F.lit(64**i).cast("bigint")
    return total


def _steps(words: int, radius: int) -> list[list[int]]:
    """Count differences that two fingerprints within the radius can have, each pair of tiles once."""
    each = [range(-radius, radius + 1)] * words if words <= 4 else None
    found = set()
    if each:
        found = {d for d in product(*each) if sum(map(abs, d)) <= radius}
    else:
        layer = {(0,) * words}
        for _ in range(radius + 1):
            found |= layer
            layer = {(*d[:i], d[i] + s, *d[i + 1:]) for d in layer for i in range(words) for s in (-1, 1)}
        found = {d for d in found if sum(map(abs, d)) <= radius}
    return [list(d) for d in sorted(found) if d >= (0,) * words]


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in range(0, len(left), 256):
        near = np.bitwise_count(left[i:i + 256, None] ^ right[None, :]) <= radius
        for x, y in zip(*np.nonzero(near)):
            p, q = int(left[i + x]), int(right[y])
            if p == q or same and p > q:
                continue
            u, v = find(p), find(q)
            if u != v:
                root[u] = v
                a.append(p), b.append(q)
    return a, b


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for one, other, same in zip(*(batch.column(i) for i in range(3))):
                left = np.frombuffer(one.as_py(), ">i8").astype(np.int64).view(np.uint64)
                right = np.frombuffer(other.as_py(), ">i8").astype(np.int64).view(np.uint64)
                a, b = _forest(left, right, radius, same.as_py())
                out_a += a
                out_b += b
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(np.array(out_a, np.uint64).view(np.int64)),
                "b": pa.array(np.array(out_b, np.uint64).view(np.int64)),
            })

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int | None = None) -> DataFrame:
    """(a, b): enough links between distinct fingerprints to join all that are within the radius.

    Crowded tiles are cut into several of `tile` fingerprints, by a hash; all of them meet, so the
    cut changes how the work is dealt out and not what is compared.
    """
    n = distinct.count()
    words = words or max((w for least, w in LAYOUTS if n >= least))
    cells = distinct.select("fp", _cell(F.col("fp"), words).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / tile)
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), parts))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list("fp")), lambda x: F.lpad(F.hex(x), 16, "0")), "")
    tiles = cut(dealt.groupBy("cell", "part").agg(F.unhex(packed).alias("fps")))
    offsets = [sum(s * 64**i for i, s in enumerate(step)) for step in _steps(words, radius)]
    near = tiles.select(
        F.col("cell").alias("own"), F.col("part").alias("own_part"), F.col("fps").alias("one"),
        F.explode(F.array(*[F.col("cell") + F.lit(o).cast("bigint") for o in offsets])).alias("cell"),
    )
    same = (F.col("own") == F.col("cell")) & (F.col("own_part") == F.col("part"))
    pairs = near.join(tiles, "cell").filter((F.col("own") != F.col("cell")) | (F.col("own_part") <= F.col("part")))
    # Dealt out evenly: a tile pair is one piece of work, however many tiles share a cell.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("one", F.col("fps").alias("other"), same.alias("same")).repartition(tasks)
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): every node of (a, b) with the smallest node it reaches, root itself left out.

    Alternating large and small stars: each step hangs the neighbours of a node on the smallest of
    them. A node's neighbours are only ever aggregated to their minimum and joined back.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        before, after = (d.agg(F.count("*").alias("n"), total.alias("h")).first() for d in (edges, small))
        edges = small
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(groups: DataFrame, radius: int, tile: int, words: int | None) -> DataFrame:
    """(fp, first, root) of (fp, first), a row per fingerprint: root is the same in a whole component."""
    roots = connected(links(groups.select("fp"), radius, tile, words))
    return groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def components(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, own included."""
    rows = cut(fingerprints(docs))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = _rooted(groups, radius, tile, words)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 hex digits."""
    return components(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key(docs: DataFrame) -> list[Column]:
    """Two hashes of the whole row; as hashes skip nulls, where they stand is hashed too."""
    held = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in held])
    return [F.xxhash64(nulls, *held).alias("_row_a"), F.xxhash64(F.lit(7), nulls, *held).alias("_row_b")]


def first_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int | None = None) -> DataFrame:
    """One row of each component: the smallest doc_id (null after all others), then by a hash.

    Rows are told apart by all their columns, so a doc_id or null that stands in several components
    stays once in each of them. Only rows that are equal throughout are interchangeable.
    """
    key = ["_row_a", "_row_b"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    groups = cut(fingerprints(docs.select("doc_id", "text", *_row_key(docs)), tuple(key)).groupBy("fp").agg(F.min(place).alias("first")))
    firsts = _rooted(groups, radius, tile, words).groupBy("root").agg(F.min("first").alias("first"))
    # The rows travel as one column, so that no name of theirs can meet one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key(docs))
    return rows.join(firsts.select("first._row_a", "first._row_b"), key).dropDuplicates(key).select("row.*")
