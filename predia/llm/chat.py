"""Chat formatting with shared prefixes emitted once.

Conversations that begin with the same turns share a path of a prefix tree; its nodes are named by a
running hash over the turns. Conversations sorted by their paths walk the tree depth first, so a turn
is emitted by the first conversation that passes it, and each tree is one sequence of code points.
Every turn gets the place of its node in that sequence, its position from the start of the
conversation, and a conversation's attention intervals are the places of its turns.

Template: `### role: text</turn>\\n`. In texts and roles a backslash goes before each backslash, `#`
and `<`, in roles also before `:`; so no control string is left in them, and dropping the backslashes gives
the text back.

Defined results: null role or text is empty; turns are ordered by turn, nulls first, and
equal ones by the hash of role and text;
rows of a null conv_id form one conversation; repeated rows are turns of their own; empty input gives
empty output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from predia.operators.scale import rank_all, running_total
from predia.session import cut

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    for mark in ("\\", "#", "<"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def formatted(role: str, text: str) -> Column:
    name = F.replace(escaped(F.col(role)), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit(OPEN), name, F.lit(MIDDLE), escaped(F.col(text)), F.lit(CLOSE))


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not turn.startswith(OPEN) or not turn.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    body = turn[len(OPEN):-len(CLOSE)]
    at = 0
    while body[at] != ":":
        at += 2 if body[at] == "\\" else 1
    return ESCAPED.sub(r"\1", body[:at]), ESCAPED.sub(r"\1", body[at + len(MIDDLE):])


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, ra, rb): nulls settled and every turn named by two hashes."""
    empty = F.lit("")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), empty).alias("conv"), F.col("turn").cast("bigint"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    return rows.select("*", F.xxhash64("role", "text").alias("ra"), F.xxhash64("text", "role", F.lit(7)).alias("rb"))


def chained(turns: DataFrame) -> DataFrame:
    """Every turn, without its text, with its place k in the conversation, its node and the parent.

    The node is the exclusive-or of position-salted hashes up to the turn, twice 64 bits. A long
    conversation is spread over range slices: slices are counted and folded on their own, and each
    takes over what the slices before it hold.
    """
    order = ["conv", "turn", "ra", "rb"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = turns.select(*order, F.char_length(formatted("role", "text")).cast("bigint").alias("size"))
    placed = cut(narrow.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()))
    own = Window.partitionBy("conv", "slice").orderBy("turn", "ra", "rb")
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv", "slice").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    zero = F.lit(0).cast("bigint")
    starts = sizes.select("conv", "slice", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}0") for c in "ms"])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.join(starts, ["conv", "slice"]).withColumn("k", F.col("m0") + F.row_number().over(own))
    numbered = numbered.withColumn("position", F.col("s0") + F.sum("size").over(upto) - F.col("size"))
    salted = cut(numbered.withColumn("a", F.xxhash64("k", "ra", "rb")).withColumn("b", F.xxhash64("rb", "ra", "k", F.lit(7))))
    totals = salted.groupBy("conv", "slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    offsets = totals.select("conv", "slice", *[F.coalesce(F.bit_xor(c).over(earlier), zero).alias(f"{c}0") for c in "ab"])
    joined = salted.join(offsets, ["conv", "slice"])
    along = Window.partitionBy("conv", "slice").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    node = {c: F.bit_xor(c).over(along).bitwiseXOR(F.col(f"{c}0")) for c in "ab"}
    named = joined.withColumn("na", node["a"]).withColumn("nb", node["b"])
    up = F.struct(F.col("na").bitwiseXOR(F.col("a")).alias("na"), F.col("nb").bitwiseXOR(F.col("b")).alias("nb"))
    return cut(named.select(
        "conv", "k", "ra", "rb", "size", "position", F.struct("na", "nb").alias("node"),
        F.when(F.col("k") > 1, up).alias("parent"),
    ))


def sequence(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted turns, and the walk of every conversation over them.

    Emitted, a row per node: (tree, start, stop, position, formatted, learned), where `start` and
    `stop` are its place in the tree's sequence and `position` is the position id of its first code
    point. Walks, a row per turn: (conv, k, tree, start, stop), the places a conversation attends to.
    """
    turns = keyed(conversations)
    rows = chained(turns)
    nodes = rows.groupBy("node").agg(F.first("parent", True).alias("parent"))
    below = nodes.filter(F.col("parent").isNotNull())
    forks = below.groupBy("parent").agg(F.count("*").alias("children")).filter(F.col("children") > 1)
    branches = nodes.filter(F.col("parent").isNull()).select("node").unionByName(below.join(forks, "parent").select("node"))
    # Only the turns after a branch tell the paths of two conversations apart.
    steps = rows.select("conv", "k", "node").join(branches, "node")
    paths = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("path"))
    paths = paths.select("conv", F.transform("path", lambda s: s["node"]).alias("path"))
    paths = paths.withColumn("tree", F.element_at("path", 1))
    order = cut(rank_all(paths, ["tree"], [F.col("path"), F.col("conv")], "walk").select("conv", "tree", "walk"))
    walks = rows.join(order, "conv")
    kept = F.struct("walk", "k", "ra", "rb", "size", "position")
    owned = walks.groupBy("tree", "node").agg(F.min(kept).alias("o")).select("tree", "node", "o.*")
    placed = running_total(owned, ["tree"], [F.col("walk"), F.col("k")], F.col("size"), "stop")
    placed = cut(placed.withColumn("start", F.col("stop") - F.col("size")))
    texts = turns.groupBy("ra", "rb").agg(F.first(F.struct("role", "text")).alias("t"))
    texts = texts.select("ra", "rb", "t.role", "t.text")
    emitted = placed.join(texts, ["ra", "rb"]).select(
        "tree", "start", "stop", "position", formatted("role", "text").alias("formatted"),
        (F.col("role") == LEARNED).alias("learned"),
    )
    walked = walks.select("conv", "k", "tree", "node").join(placed.select("tree", "node", "start", "stop"), ["tree", "node"])
    return emitted, walked.drop("node")


def intervals(walked: DataFrame) -> DataFrame:
    """(conv, tree, attends): the places a conversation attends to, neighbours joined."""
    by = Window.partitionBy("conv").orderBy("start")
    fresh = F.coalesce(F.lag("stop").over(by) != F.col("start"), F.lit(True)).cast("int")
    runs = walked.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    joined = runs.groupBy("conv", "tree", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.groupBy("conv", "tree").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("attends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read sorted turns back, one conversation after another, holding hashes only."""
    conv, state, done = None, None, []

    def close():
        if state is not None:
            n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def batch_of(rows):
        names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    for batch in batches:
        for own, text, learned in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if state is None or own != conv:
                close()
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = parse(text)
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode())
            if learned:
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        yield batch_of(done)
        done.clear()
    close()
    yield batch_of(done)


def read_back(emitted: DataFrame, walked: DataFrame) -> DataFrame:
    """What every conversation says, read from the emitted sequences at the places it attends to.

    A digest of a whole conversation takes its turns one after another, so a conversation ends in one
    task; the task streams sorted rows and holds hashes only.
    """
    rows = walked.select("conv", "k", "tree", "start").join(emitted.select("tree", "start", "formatted", "learned"), ["tree", "start"])
    n = int(walked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("conv", "k", "formatted", "learned").repartition(n, "conv").sortWithinPartitions("conv", "k")
    schema = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = ordered.select("conv", "formatted", "learned").mapInArrow(_digests, schema)
    conv_id = F.when(F.col("conv") != "", F.col("conv")).cast("bigint").alias("conv_id")
    return read.select(conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format all conversations and read them back."""
    return read_back(*sequence(conversations))
