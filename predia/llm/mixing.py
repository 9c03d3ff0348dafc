"""Mixing sources to target weights by pivotal dependent rounding, in column expressions only.

Every document of a source may be copied `target / source size` times. The whole part is taken as it
is; the fractional parts are rounded dependently: two documents exchange words at random until one
of them has a whole number of copies, so the words of a group are kept up to one last document.
Blocks of documents are folded on their own and the one residual of each block goes up a reduction
tree, so no task ever holds a whole source.

Size classes are settled from large to small: what the last document of a class leaves too much or too
little is spread over the copies of all smaller ones, so a source ends within one of its small documents
of the target, as far as those can make up for it: that last document is left to chance only if both
outcomes can be made up for.

Defined results: null or empty text has size 0, is never taken and never rounded; a null source is a
source of its own, last in order; equal rows are told apart by rank only; empty input gives empty
output; other columns are ignored by `mix` and carried along by `mixed`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from predia.operators.scale import rank_all
from predia.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CLASS = 8  # sizes of a class lie within this factor
BLOCK = 1024
SEED = 42
UNIT = "struct<rank:bigint,size:bigint,p:double>"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Words each source should give: shares by weight, stopped at `most` times its size.

    What a stopped source leaves is shared again by weight until no source is above its stop; each
    round is one aggregate over the list of sources, read as a single row.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_all(sources, [], [F.col("source").asc_nulls_last()], "source_no")
    place = F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double")))
    stop = (F.col("source_size") * most).cast("double")
    level, stopped = 0.0, -1
    while True:
        above = stop < F.col("weight") * F.lit(level)
        r = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, stop)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(above).alias("stopped"),
        ).first()
        if r["stopped"] == stopped:
            break
        stopped = r["stopped"]
        level = (r["total"] - r["given"]) / r["open"] if r["open"] else level
    target = F.when(stop < F.col("weight") * F.lit(level), stop).otherwise(F.col("weight") * F.lit(level))
    return cut(ranked.select("source", "source_no", "source_size", target.alias("target")))


def _let(values: list[Column], body) -> Column:
    """Bind values once inside an expression."""
    return F.element_at(F.transform(F.array(F.struct(*values)), body), 1)


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _pair(state: Column, x: Column, source_no: Column) -> Column:
    """Move words between the carried document and the next until one is whole."""
    c = state["carry"]
    up = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])
    down = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])

    def move(m: Column) -> Column:
        rise = m["u"] * (m["up"] + m["down"]) < m["down"]
        shift = F.when(rise, m["up"]).otherwise(-m["down"])
        pc, px = c["p"] + shift / c["size"], x["p"] - shift / x["size"]
        # The side that set the length of the move is the one that became whole.
        c_whole = F.when(rise, m["up"] >= (1 - c["p"]) * c["size"]).otherwise(m["down"] >= c["p"] * c["size"])
        c_taken, x_taken = c_whole & rise, ~c_whole & ~rise
        left_rank = F.when(c_whole, x["rank"]).otherwise(c["rank"])
        left_size = F.when(c_whole, x["size"]).otherwise(c["size"])
        left_p = F.when(c_whole, px).otherwise(pc)
        taken = F.when(c_taken, c["rank"]).when(x_taken, x["rank"])
        left_taken = left_p >= 1 - 1e-12
        left = F.when((left_p > 1e-12) & ~left_taken, F.struct(
            left_rank.alias("rank"), left_size.alias("size"), left_p.alias("p"))).cast(UNIT)
        both = F.array_compact(F.array(taken, F.when(left_taken, left_rank)))
        return F.struct(left.alias("carry"), F.concat(state["taken"], both).alias("taken"))

    u = _uniform(c["rank"], x["rank"], source_no)
    paired = _let([up.alias("up"), down.alias("down"), u.alias("u")], move)
    return F.when(c.isNull(), F.struct(x.cast(UNIT).alias("carry"), state["taken"].alias("taken"))).otherwise(paired)


def _fold(units: DataFrame, block: Column) -> DataFrame:
    """One residual and the documents taken per block of units."""
    blocks = units.groupBy("source_no", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "size", "p"))).alias("units")
    )
    start = F.struct(F.lit(None).cast(UNIT).alias("carry"), F.array().cast("array<bigint>").alias("taken"))
    folded = F.aggregate("units", start, lambda s, x: _pair(s, x, F.col("source_no")))
    return cut(blocks.select("source_no", "block", folded.alias("r")).select("source_no", "block", "r.*"))


def round_copies(units: DataFrame, limits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, rank) of the units whose fractional copy is taken.

    `units` has source_no, rank (1.. within the source), size > 0 and p in (0, 1); `limits` has per source
    the words that are open besides what all units weigh (`base`) and those that others can still give (`cap`).
    The last unit of a source is left to chance only if either outcome can be made up for.
    """
    top = units.agg(F.max("rank")).first()[0] or 0
    level = _fold(units, F.floor((F.col("rank") - 1) / block))
    taken = level.select("source_no", F.explode("taken").alias("rank"))
    width = block
    while width < top:
        width *= block
        left = level.filter(F.col("carry").isNotNull()).select("source_no", "carry.*")
        level = _fold(left, F.floor((F.col("rank") - 1) / width))
        taken = taken.unionByName(level.select("source_no", F.explode("taken").alias("rank")))
    last = level.filter(F.col("carry").isNotNull()).select("source_no", "carry.*").join(limits, "source_no")
    left = F.col("base") + F.col("p") * F.col("size")  # open words, if the unit is not taken
    fits, made_up = left >= F.col("size"), left <= F.col("cap")
    by_chance = _uniform(F.col("rank"), F.lit(-1), F.col("source_no")) < F.col("p")
    nearer = F.col("size") - left < left - F.col("cap")
    kept = last.filter(F.when(fits & made_up, by_chance).when(fits, True).when(made_up, False).otherwise(nearer))
    return taken.unionByName(kept.select("source_no", "rank"))


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """Copies of every row of (doc_id, source, size, ...): adds source_size, target, copies.

    One turn per size class in use, a handful whatever the corpus. A turn knows per source the words that
    larger classes took; its documents and all smaller ones share the rest.
    """
    placed = source_targets(sized, weights, most)
    rows = sized.join(placed, sized["source"].eqNullSafe(placed["source"])).drop(placed["source"])
    kind = F.when(F.col("size") > 0, F.floor(F.log(float(CLASS), "size") + 1e-9).cast("int")).otherwise(-1)
    order = [F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = cut(rank_all(rows.withColumn("class", kind), ["source_no", "class"], order))
    sums = ranked.filter("class >= 0").groupBy("source_no", "class").agg(F.sum("size").alias("own"))
    up_to = Window.partitionBy("source_no").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut(sums.withColumn("rest", F.sum("own").over(up_to)))
    state = placed.select("source_no", F.col("target").alias("open"))
    done = [ranked.filter("class < 0").withColumn("copies", F.lit(0).cast("bigint"))]
    for number in sorted((r["class"] for r in sums.select("class").distinct().collect()), reverse=True):
        ratios = state.join(sums.filter(F.col("class") == number), "source_no").select(
            "source_no", "open", "own", "rest", F.least(F.greatest(F.col("open") / F.col("rest"), F.lit(0.0)), F.lit(float(most))).alias("ratio"))
        limits = ratios.select(
            "source_no", (F.col("open") - F.col("ratio") * F.col("own")).alias("base"), (most * (F.col("rest") - F.col("own"))).alias("cap"))
        own = ranked.filter(F.col("class") == number).join(ratios.select("source_no", "ratio"), "source_no")
        own = own.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.floor("ratio")).drop("ratio")
        units = own.filter("p > 0").select("source_no", "rank", "size", "p")
        more = round_copies(units, limits, block).withColumn("more", F.lit(1))
        settled = cut(own.join(more, ["source_no", "rank"], "left").withColumn("copies", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("bigint")))
        done.append(settled.drop("whole", "p", "more"))
        taken = settled.groupBy("source_no").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        state = cut(state.join(taken, "source_no", "left").select("source_no", (F.col("open") - F.coalesce("taken", F.lit(0))).alias("open")))
    return reduce(DataFrame.unionByName, done).drop("source_no", "rank", "class")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    sized = docs.select("doc_id", "source", n_words().alias("size"))
    return copies(sized, weights, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it.

    Rows equal in doc_id, source and text share what their key got; only those are ranked.
    """
    key = [F.xxhash64("doc_id", "source", "text").alias("a"), F.xxhash64("text", "doc_id", "source").alias("b")]
    sized = docs.select("doc_id", "source", n_words().alias("size"), *key)
    got = copies(sized, weights, most).groupBy("a", "b").agg(F.sum("copies").alias("n"), F.count("*").alias("m"))
    # The rows travel as one column, so that no name of theirs can meet one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key).join(got.filter("n > 0"), ["a", "b"])
    repeated = rows.filter("m > 1")
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("a"))
    share = F.floor(F.col("n") / F.col("m")) + (place <= F.col("n") % F.col("m")).cast("bigint")
    repeated = repeated.withColumn("n", share).filter("n > 0")
    every = rows.filter("m = 1").unionByName(repeated)
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select("row.*")
