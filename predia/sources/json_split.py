"""Elements of large JSON files, read by many tasks.

A file is read in splits of any size, as fragments that end at a closing brace. Whether a fragment lies
inside a string, and how deep, follows from what stands before it, so two passes are made: the first
takes from each split what it does to that state, for either case at its start; summed over the splits of
a file in order this gives the state at each start. The second pass cuts the split into elements. Only an
element that crosses a border of splits is put together from its pieces, which are a few per split.

Elements are objects that open at the given depth: 1 in an array of records, 2 in the list of a
collection. Texts are UTF-8. Files that are not such JSON give the elements that can be found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from predia.session import cut, scratch_path

#: A backslash takes the next character with it outside of strings too, where JSON has none: so a fragment
#: read in the wrong case turns at the same quotes as in the right one.
TOKEN = re.compile(rb'\\.|"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.DOTALL)
STRING_END = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)
STEP = {b"{": 1, b"[": 1, b"}": -1, b"]": -1}


def _scan(fragment: bytes, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """((place, depth step) of each bracket outside of strings, whether a string is open at the end)."""
    at = 0
    if inside:
        closed = STRING_END.match(fragment)
        if not closed:
            return [], True
        at = closed.end()
    steps, inside = [], False
    for token in TOKEN.finditer(fragment, at):
        found = token.group()
        if found in STEP:
            steps.append((token.start(), STEP[found]))
        elif found[:1] == b'"':
            inside = not token.group(1)
    return steps, inside


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of the split, fragment with its brace) in the order of the file."""
    for batch in batches:
        for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield file, start, value + b"}"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and case at its start: whether a string is open at its end, and the change of depth."""
    state: dict[tuple[str, int], list[list]] = {}
    for file, start, fragment in _splits(batches):
        for case in state.setdefault((file, start), [[False, 0], [True, 0]]):
            steps, case[0] = _scan(fragment, case[0])
            case[1] += sum(s for _, s in steps)
    rows = [{"file": f, "start": s, "turns": out[0], "depth_out": out[1], "depth_in": held[1]} for (f, s), (out, held) in state.items()]
    kinds = {"file": pa.string(), "start": pa.int64(), "turns": pa.bool_(), "depth_out": pa.int64(), "depth_in": pa.int64()}
    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


FOUND = pa.schema([("file", pa.string()), ("start", pa.int64()), ("i", pa.int64()), ("kind", pa.int32()), ("text", pa.binary())])
WHOLE, BEGUN, CARRIED = 0, 1, 2


def _elements(base: int):
    """Elements of each split, numbered where they begin, and pieces: BEGUN here, or CARRIED from an earlier split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, listed = None, False, 0, True
        open_, begun, number, parts, out = False, False, -1, [], []

        def piece(kind: int) -> None:
            out.append({"file": key[0], "start": key[1], "i": -1 if kind == CARRIED else number, "kind": kind, "text": b"".join(parts)})

        for batch in batches:
            states = zip(batch.column("inside").to_pylist(), batch.column("depth").to_pylist())
            rows = _splits(iter([batch.select(["file", "start", "value"])]))
            for (file, start, fragment), (at_inside, at_depth) in zip(rows, states):
                if (file, start) != key:
                    if open_:
                        piece(BEGUN if begun else CARRIED)
                    # What opened the level of the elements before this split is taken for their list.
                    key, inside, depth, listed = (file, start), at_inside, at_depth, True
                    open_, begun, number, parts = at_depth > base, False, -1, []
                since = 0
                steps, inside = _scan(fragment, inside)
                for place, step in steps:
                    opens = fragment[place:place + 1]
                    if step > 0 and depth == base - 1:
                        listed = opens == b"["
                    elif opens == b"{" and depth == base and listed:
                        open_, begun, parts, since = True, True, [], place
                        number += 1
                    depth += step
                    if open_ and step < 0 and depth == base:
                        parts.append(fragment[since:place + 1])
                        piece(WHOLE if begun else CARRIED)
                        open_, begun, parts = False, False, []
                if open_:
                    parts.append(fragment[since:])
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, FOUND)
                out.clear()
        if open_:
            piece(BEGUN if begun else CARRIED)
        yield pa.RecordBatch.from_pylist(out, FOUND)

    return run


def elements(spark: SparkSession, path: str, base: int) -> DataFrame:
    """(file, orden, value): the JSON text of every element, numbered from 0 in the order of its file."""
    fragments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary"))
    changes = cut(fragments.mapInArrow(_changes, "file string, start long, turns boolean, depth_out long, depth_in long"))
    # A string is open at a split's start if an odd number of earlier splits turn that state, and the depth
    # is the sum of the changes of each earlier split's own case. A row per split, so a small table.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turned = changes.withColumn("inside", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    states = turned.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    stated = fragments.join(F.broadcast(states.select("file", "start", "inside", "depth")), ["file", "start"])
    kind, folder = "file string, start long, i long, kind int, text binary", scratch_path(spark, "json_elements")
    stated.select("file", "start", "value", "inside", "depth").mapInArrow(_elements(base), kind).write.parquet(folder)
    held = spark.read.schema(kind).parquet(folder)
    # Carried pieces belong to the last split before theirs that began an element and did not end it.
    begun = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGUN)
    owner = F.last(F.when(F.col("kind") == BEGUN, F.col("start")), ignorenulls=True).over(begun)
    owned = held.filter(F.col("kind") != WHOLE).withColumn("owner", owner).filter("owner IS NOT NULL")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("text").alias("h")))), lambda p: p["h"])
    joined = owned.groupBy("file", F.col("owner").alias("start")).agg(F.max("i").alias("i"), F.unhex(F.array_join(in_order, "")).alias("text"))
    whole = held.filter(F.col("kind") == WHOLE).drop("kind").unionByName(joined)
    counts = held.filter(F.col("kind") != CARRIED).groupBy("file", "start").agg(F.count("*").alias("c"))
    earlier = counts.select("file", "start", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"))
    return whole.join(earlier, ["file", "start"]).select(
        "file", (F.col("earlier") + F.col("i")).alias("orden"), F.col("text").cast("string").alias("value"))
