"""Document fingerprints from closed syncmers, in column expressions only.

A run of five words is an anchor when the smallest of its words' hashes is at its first or last
word. Whether a run is an anchor depends on the run alone, so texts that share a passage share its
anchors, wherever it stands. A fingerprint keeps the smallest anchor hashes with the place where
each first stands.

Defined results: null text is an empty text; a text without words has an empty fingerprint, one of
fewer than five words a single anchor; two empty fingerprints are alike (1.0); repeated rows have
equal fingerprints and follow each other; a null doc_id is last in the descending order; empty input
gives empty output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 5
KEPT = 64
SPACE = r"[\x20\x09-\x0D]+"
BLOCKS_A_PARTITION = 4


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _edge(run: Column, k: int) -> Column:
    least = F.array_min(run)
    return (F.get(run, F.lit(0)) == least) | (F.get(run, F.lit(k - 1)) == least)


def anchors(hashes: Column, k: int = K) -> Column:
    """array<struct<at, hash>>: the closed syncmers of word hashes, in order of place."""
    last = F.size(hashes) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.slice(hashes, i + 1, k).alias("run")))
    picked = F.transform(
        F.filter(runs, lambda r: _edge(r["run"], k)),
        lambda r: F.struct(r["at"].alias("at"), F.xxhash64(r["run"]).alias("hash")),
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(hashes).alias("hash")))
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    return F.when(last >= 0, picked).when(F.size(hashes) > 0, whole).otherwise(none)


def sketch(hashes: Column, k: int = K, kept: int = KEPT) -> Column:
    """The smallest anchor hashes of a text."""
    last = F.size(hashes) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(hashes, i + 1, k))
    picked = F.transform(F.filter(runs, lambda r: _edge(r, k)), lambda r: F.xxhash64(r))
    whole = F.array(F.xxhash64(hashes))
    every = F.when(last >= 0, picked).when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, kept)


def text_sketch(text: Column, k: int = K, kept: int = KEPT) -> Column:
    """As `sketch`, with the word hashes bound once."""
    bound = F.transform(F.array(word_hashes(text)), lambda h: sketch(h, k, kept))
    return F.element_at(bound, 1)


def text_anchors(text: Column, k: int = K) -> Column:
    return F.element_at(F.transform(F.array(word_hashes(text)), lambda h: anchors(h, k)), 1)


def shown(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(one: Column, other: Column, kept: int = KEPT) -> Column:
    """Share of the smallest hashes of both that both have: an estimate of the anchors in common."""
    union = F.slice(F.sort_array(F.array_union(one, other)), 1, kept)
    both = F.array_intersect(F.array_intersect(one, other), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def aligned(docs: DataFrame, others: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, other_id, shift, n): anchors that two documents share at one distance of their places.

    `docs` and `others` are (doc_id, text); equal ids are left out. The anchors meet in an equality
    join; an anchor counts once for each pair of documents and shift.
    """
    def spread(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("doc_id").alias(name), F.explode(text_anchors(F.coalesce("text", F.lit("")), k)).alias("s")).select(
            name, F.col("s.hash").alias("hash"), F.col("s.at").alias(f"at_{name}"))

    met = spread(docs, "doc_id").join(spread(others, "other_id"), "hash").filter("doc_id <> other_id")
    shift = (F.col("at_other_id") - F.col("at_doc_id")).alias("shift")
    return met.groupBy("doc_id", "other_id", shift).agg(F.countDistinct("hash").alias("n"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document with the next by descending doc_id.

    Documents are dealt out in blocks of the id order, whose bounds are ids that occur. The greatest
    of a block goes to the block above as well, and the greatest of all to the last block, so every
    row finds its follower inside its block: one shuffle, and no task holds more than a block.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", text_sketch(F.col("text")))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * BLOCKS_A_PARTITION
    shares = [i / n for i in range(1, n + 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("p"), F.max("doc_id").alias("m")).first()
    # Descending: block 0 starts with the greatest id. At most n + 1 numbers, whatever the input.
    bounds = sorted({*(found["p"] or []), *([found["m"]] if found["m"] is not None else [])}, reverse=True)
    if not bounds:
        bounds = [0]
    listed = F.array(*[F.lit(int(b)).cast("bigint") for b in reversed(bounds)])
    above = F.size(F.filter(listed, lambda b: b >= F.col("doc_id")))
    # Ids at or under bound i and over bound i + 1 are in block i; nulls come last of all.
    block = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) - 1)).otherwise(above - 1)
    greatest = F.col("doc_id") == F.get(listed, F.lit(len(bounds) - 1) - block)
    guest = F.when(greatest & (block > 0), block - 1).when(greatest & (block == 0), F.lit(len(bounds) - 1))
    if not found["m"] is not None:
        guest = F.lit(len(bounds) - 1)
    homes = F.array_compact(F.array(
        F.struct(block.alias("block"), F.lit(0).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.alias("block"), F.lit(1).alias("guest"))),
    ))
    spread = rows.withColumn("home", F.explode(homes)).select("doc_id", "text", "sketch", "home.*")
    tie = F.xxhash64("text")
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), tie, F.col("text")]
    by = Window.partitionBy("block").orderBy(*order)
    return spread.select(
        "doc_id", "text", "sketch", "guest", F.lead("text").over(by).alias("next_text"), F.lead("sketch").over(by).alias("next_sketch"),
    ).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = F.char_length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), (n - half).cast("int")), F.left(F.col("next_text"), half))
    rows = with_next(docs).select("doc_id", n.alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", text_sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
