"""Personal data by rules and by bootstrapped contexts, in column expressions only.

Rules find e-mail addresses, IP addresses, card and phone numbers exactly; these are the seeds. The
two words before a seed are a lexical pattern. Patterns and the identifiers that stand behind them
form a graph, which Spark scores in rounds: a pattern is worth the share of its places in the whole
corpus that hold accepted identifiers, an identifier what its patterns are worth together. Patterns
of high confidence then mark identifiers that no rule knows.

Spans are (kind, start, end) in code points, end exclusive. Defined results: null text is empty and
has no spans; repeated rows have equal spans, and equal instances count once for a pattern; a null
doc_id is treated as any other; empty input gives empty output; other columns are ignored by `find`
and carried along by `redacted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predia.session import cut

KINDS = ("email", "ip", "card", "phone")
# The rules, written so that no match is tried twice from inside a run of characters
# (a match starts where a run starts or where the last match ended) and nothing is given back.
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the rule to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
IDENTIFIER = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
MIN_DIGITS = 5
CONTEXT_CHARS = 80
MIN_SEEDS = 3
CONFIDENCE = 0.8
ROUNDS = 3
#: Up to so many patterns are written into the count's filter; beyond, all word pairs are counted.
LISTED_PATTERNS = 20_000
MENTION = "array<struct<start:bigint,stop:bigint,match:string,before:string>>"
SPAN = "array<struct<start:bigint,kind_no:int,stop:bigint,kind:string>>"


def mentions(text: Column, pattern: str) -> Column:
    """Every match of a pattern with its place and the text since the start of the match before.

    The pieces between matches give the places: both come from the same left-to-right search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("match"), F.slice(pieces, 1, F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("last"), F.array().cast(MENTION).alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["gap"])
        stop = begin + F.char_length(x["match"])
        one = F.struct(begin.alias("start"), stop.alias("stop"), x["match"].alias("match"),
                       F.right(F.concat(s["last"], x["gap"]), F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct(stop.alias("at"), x["match"].alias("last"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.char_length(digits(match))
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits(match)).between(9, 15)
    return F.lit(True)


def rule(text: Column, kind: str) -> Column:
    hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
    found = F.filter(mentions(text, PATTERNS[kind]), lambda m: _holds(kind, m["match"]))
    return F.when(hint, found).otherwise(F.array().cast(MENTION))


def left_context(before: Column) -> Column:
    """Hash of the last two words before a mention; null where there are fewer."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(words) > 1, F.xxhash64(F.element_at(words, -2), F.element_at(words, -1)))


def extracted(docs: DataFrame, key: list[Column]) -> DataFrame:
    """(key, rules, others) per document: matches of each rule and identifier-like tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*key, text.alias("text"))
    other = F.filter(
        F.when(F.rlike("text", F.lit("[0-9]{2}")), mentions(F.col("text"), IDENTIFIER)).otherwise(F.array().cast(MENTION)),
        lambda m: F.char_length(digits(m["match"])) >= MIN_DIGITS,
    )
    return rows.select(*[c for c in rows.columns if c != "text"], *[rule(F.col("text"), k).alias(k) for k in KINDS], other.alias("other"))


def _mentioned(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, start, stop, instance, left): a row per mention; kind is null for tokens."""
    def rows(column: str, kind: Column) -> Column:
        return F.transform(column, lambda m: F.struct(
            kind.alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), m["match"].alias("match"),
            left_context(m["before"]).alias("left")))

    every = F.concat(*[rows(k, F.lit(k)) for k in KINDS], rows("other", F.lit(None).cast("string")))
    flat = found.select(*key, F.explode(every).alias("m")).select(*key, "m.*")
    # Punctuation around a token is not part of it.
    front = F.when(F.col("kind").isNull(), F.char_length(F.regexp_extract("match", r"^[^\p{L}\p{N}+]*", 0))).otherwise(F.lit(0))
    core = F.when(F.col("kind").isNull(), F.regexp_replace("match", r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")).otherwise(F.col("match"))
    return flat.withColumn("start", F.col("start") + front).withColumn("core", core).select(
        *key, "kind", "start", (F.col("start") + F.char_length("core")).alias("stop"), F.lower("core").alias("instance"), "left"
    ).filter(F.col("left").isNotNull())


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(left, places): how often the two words of each pattern stand in all documents."""
    words = docs.select(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\S+"), F.lit(0)).alias("w"))
    last = F.size("w") - 2
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    pairs = words.select(F.explode(F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("left"))
    wanted = patterns.select("left").distinct()
    if (n := wanted.count()) <= LISTED_PATTERNS:
        listed_ = ",".join(str(r["left"]) for r in wanted.collect()) if n else "NULL"
        pairs = pairs.filter(f"left IN ({listed_})")
    return pairs.groupBy("left").agg(F.count("*").alias("places"))


def bootstrapped(docs: DataFrame, mentioned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(left, instance, kind): what the confident patterns hold beyond the rules."""
    edges = cut(mentioned.groupBy("left", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("seed")))
    seeded = edges.filter(F.col("seed").isNotNull()).groupBy("left", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    patterns = cut(seeded.filter(F.col("seeds") >= min_seeds))
    shown = edges.groupBy("left").agg(F.sum("n").alias("shown"))
    totals = patterns.select("left").distinct().join(_places(docs, patterns), "left", "left").join(shown, "left").select(
        "left", F.greatest(F.coalesce("places", F.lit(0)), F.coalesce("shown", F.lit(0))).alias("places"))
    graph = cut(edges.join(patterns.select("left", "kind"), "left").join(totals, "left").withColumn(
        "worth", F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0)))
    for _ in range(rounds):
        scored = graph.groupBy("left", "kind").agg((F.sum(F.col("n") * F.col("worth")) / (F.max("places") + 1)).alias("trust"))
        weighed = graph.drop("worth", "trust").join(scored, ["left", "kind"])
        # Evidence of several patterns adds up; one is enough only when it is sure.
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        held = weighed.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("held"))
        seed = F.col("seed") == F.col("kind")
        graph = cut(weighed.join(held, ["instance", "kind"]).withColumn(
            "worth", F.when(seed, 1.0).when(F.col("held") >= confidence, F.col("held")).otherwise(0.0)
        ).select("left", "instance", "n", "seed", "kind", "places", "trust", "worth"))
    sure = (F.col("trust") >= confidence) & (F.col("worth") >= confidence)
    return graph.filter(F.col("seed").isNull() & sure).groupBy("left", "instance").agg(F.max_by("kind", "trust").alias("kind"))


def _text_key() -> list[Column]:
    return [F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_a"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("_text_b")]


KEY = ["_text_a", "_text_b"]


def spans(docs: DataFrame) -> DataFrame:
    """(_text_a, _text_b, doc_id, base, every): spans by rule, and those with the method's, by start.

    Texts are known by two hashes; equal texts have equal spans, so what is found once for a text
    serves all its rows.
    """
    found = cut(extracted(docs, [F.col("doc_id"), *_text_key()]))
    mentioned = _mentioned(found, KEY)
    new = bootstrapped(docs, mentioned)
    more = mentioned.filter(F.col("kind").isNull()).drop("kind").join(new, ["left", "instance"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "stop", "kind")).cast(SPAN).alias("more"))
    def of_kind(number: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind_no"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))

    ruled = F.sort_array(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)])).cast(SPAN)
    rows = found.select(*KEY, "doc_id", ruled.alias("base")).join(more, KEY, "left")
    fresh = F.filter(F.coalesce("more", F.array().cast(SPAN)), lambda m: ~F.exists(
        "base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return rows.select(*KEY, "doc_id", "base", F.sort_array(F.concat("base", fresh)).alias("every"))


def listed(spans_: str) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs.select("doc_id", "text")).select(
        "doc_id", *map(count, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("every").alias("spans"))


def _masked(text: Column, every: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its kind in brackets."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.concat(s["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(x["start"] >= s["at"], out).otherwise(s["out"]).alias("out"))

    return F.aggregate(every, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked; texts without spans stay as they are."""
    found = spans(docs.select("doc_id", "text")).filter(F.size("every") > 0).groupBy(*KEY).agg(F.first("every").alias("every"))
    # The rows travel as one column, so that no name of theirs can meet one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_key()).join(found, KEY, "left")
    text = F.when(F.col("every").isNotNull(), _masked(F.col("row.text"), F.col("every"))).otherwise(F.col("row.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
