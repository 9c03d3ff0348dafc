"""Lines that many documents share, dropped by levelled sorted runs of line hashes.

Documents are read once: each line that is long enough becomes a 128-bit hash of its key with the
document and the line's place. These rows are taken in batches of descending doc_id. A batch is
reduced to one row per hash, merge-anti-joined with the runs, which drops what they have settled
already, and the rest is added as a run of its own. A run is a table bucketed and sorted by the hash,
so the join reads it without a shuffle. `fanout` runs of a level are compacted to one run of the next
level. A hash is settled when its documents reach the least number; the largest doc_id stands with it.

A hot line is one row per task after partial aggregation; where its places meet the settled hashes,
the join is a plain merge join that Spark can split. Texts move once, to meet the places they lose.

Defined results: a null or empty text is one empty line; a document is a row, so repeated rows count
each, and rows of the largest doc_id all keep their lines, those within one document too; a null
doc_id is below all others; empty input gives empty output; other columns are carried along by
`without_shared_lines` under any name and ignored by `digests`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from predia.session import cut, scratch_path

#: Fixed values of the contract: what is stripped, the least length in code points, the least documents.
BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 6
FANOUT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lowered. Pure ASCII takes the quick way to the same key."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, body, a, b, at, first): a row per long enough line, with a hash of the whole text and the
    line's hash and place; `first` marks one line of each key in a document."""
    keys = F.transform(lines(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k, i: F.struct(
        F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"), i.alias("at"), F.char_length(k).alias("chars")))
    ordered = F.sort_array(F.filter(hashed, lambda h: h["chars"] >= least_chars))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("body"), ordered.alias("keys"))
    rows = rows.select("*", F.posexplode("keys").alias("p", "key"))
    before = F.get("keys", F.col("p") - 1)
    first = before.isNull() | (before["a"] != F.col("key.a")) | (before["b"] != F.col("key.b"))
    return rows.select("doc_id", "body", "key.a", "key.b", "key.at", first.alias("first"))


class LineRuns:
    """Runs of (a, b, n, last): how many documents hold a line, counted until it is settled, and the
    largest of their ids. Use in a `with` block: the tables go when it ends."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.least, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.base, self.folder = f"line_runs_{uuid.uuid4().hex}", scratch_path(spark, "line_runs")
        self.levels: list[list[str]] = []

    def __enter__(self) -> LineRuns:
        self.spark.sql(f"CREATE DATABASE {self.base} LOCATION '{self.folder}'")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE {self.base} CASCADE")

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").format("parquet").saveAsTable(f"{self.base}.{name}")
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        # One scan over the files: Spark 4.1 takes a union of bucketed tables for hash-partitioned even where it
        # reads them unbucketed, and would not bring equal hashes together.
        rows = self.spark.read.schema("a long, b long, n long, last long").parquet(*[f"{self.folder}/{run}" for run in runs])
        return rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, batch: DataFrame) -> None:
        """Take line rows, in any order of batches. What a run has settled with a doc_id as large can
        change nothing any more and is left out."""
        own = batch.filter("first").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        for run in [r for level in self.levels for r in level]:
            settled = self.spark.table(f"{self.base}.{run}").filter(F.col("n") >= self.least).select("a", "b", F.col("last").alias("held"))
            meets = (own["a"] == settled["a"]) & (own["b"] == settled["b"]) & (own["last"].isNull() | (settled["held"] >= own["last"]))
            own = own.join(settled.hint("merge"), meets, "left_anti")
        self._file(0, self._write(own))

    def _file(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._file(level + 1, self._write(self._merged(runs)))
            for old in runs:
                self.spark.sql(f"DROP TABLE {self.base}.{old}")

    def settled(self) -> DataFrame:
        """(a, b, last) of every line that enough documents hold; computed before the tables go."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "a long, b long, last long")
        return cut(self._merged(runs).filter(F.col("n") >= self.least).select("a", "b", "last"))


def _batches(rows: DataFrame, docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    """Line rows written once, in folders of descending doc_id."""
    parts = [i / batches for i in range(1, batches)]
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), parts, 1000)).first()[0] if parts else None
    number = F.lit(batches - 1)
    for i, edge in enumerate(edges or []):
        number = number - F.when(F.col("doc_id") > edge, 1).otherwise(0)
    path = scratch_path(docs.sparkSession, "line_rows")
    rows.withColumn("batch", number.cast("int")).write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema("doc_id long, body long, a long, b long, at int, first boolean, batch int").parquet(path), path


def lost_places(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, body, lost): the places of the lines that a document loses; no row where it loses none."""
    rows, _ = _batches(line_rows(docs, least_chars), docs, batches)
    with LineRuns(docs.sparkSession, least_docs, fanout) as runs:
        for number in range(batches):
            runs.add(rows.filter(F.col("batch") == number))
        settled = runs.settled()
    gone = rows.join(settled, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("doc_id", "body").agg(F.collect_set("at").alias("lost"))


def _with_lost(docs: DataFrame, **options: int) -> tuple[DataFrame, Column]:
    """The documents, and the places each loses, under a name that no column of theirs has."""
    name = "lost"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    gone = lost_places(docs, **options).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), F.col("lost").alias("_lost"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").cast("bigint").alias("_key"), F.xxhash64("text").alias("_own"))
    joined = left.join(gone, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_body")), "left")
    return joined.select("d.*", F.col("_lost").alias(name)), F.col(name)


def kept_text(text: Column, lost: Column) -> Column:
    """The text without the lines at the lost places."""
    every = lines(text)
    places = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), lost)
    kept = F.transform(F.array(every), lambda held: F.array_join(F.transform(places, lambda i: F.get(held, i)), "\n"))
    return F.when(lost.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.get(kept, F.lit(0)))


def without_shared_lines(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with the lines dropped from their texts; all columns stay."""
    marked, lost = _with_lost(docs, **options)
    kept = F.when(F.col("text").isNotNull(), kept_text(F.col("text"), lost)).alias("text")
    return marked.select([kept if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    marked, lost = _with_lost(docs.select("doc_id", "text"), **options)
    return marked.select(
        F.col("doc_id").cast("bigint"),
        F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), lost), 256).alias("kept_sha256"),
    )
