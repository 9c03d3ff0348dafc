"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from predia.llm import bpe, chat, fingerprints, licenses, lines, mixing, phrases, pii, quality, scoring, search, simhash, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the control strings of common templates.
TRAP = "\\### Assistant: </turn> ok"


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(given.unionByName(trap))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.given_labels(spark, f"{sf_dir}/labels.parquet")
    return quality.judge(table(spark, sf_dir, "documents"), labels)


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_syncmer_fingerprints, op2_chat_prefix_tree, op3_license_scan, op4_quality_rules, op5_warc_packages, op6_simhash_tiles, op7_pii_contexts, op8_source_mix, op9_pseudo_likelihood, op10_byte_bpe,
    op11_son_collocations, op12_line_runs, op13_block_max_search,
)}

def _escaped(text: str) -> str:
    for mark in ("\\", "#", "<"):
        text = f"replace({text}, '{mark}', '\\{mark}')"
    return text


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 160 bits of SHA-1 in eight groups of 20, each four characters of five bits.
_DIGEST = " || ".join(
    f"substr('{_BASE32}', ((('0x' || substr(h, {5 * group + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for group in range(8) for shift in (15, 10, 5, 0)
)

def _terms(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{lines.UPPER}', '{lines.LOWER}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES: dict[str, str] = {
    "op2_chat_prefix_tree": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || replace({_escaped("role")}, ':', '\\:') || ': ' || {_escaped("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op5_warc_packages": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS erste FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = erste THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> erste THEN erste END AS refers_to FROM q""".replace("erste", "first_id"),
    "op11_son_collocations": f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS place FROM p),
g AS (SELECT lang, size, array_to_string(list_slice(w, place, place + size - 1), ' ') AS phrase, count(*) AS m
  FROM i, (SELECT unnest([1, 2, 3]) AS size) WHERE place + size - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(m)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, m AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND m >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.size, k.phrase, k.a, k.k, x.m AS l, y.m AS r, ((1000000::HUGEINT * k.a * k.a) // (x.m::HUGEINT * y.m))::BIGINT AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(w, 1, k.k), ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(w, k.k + 1, k.size), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN v USING (lang, phrase) WHERE v.f IS NULL OR 100 * v.f < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_line_runs": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
p AS (SELECT doc_id, unnest(every) AS line, generate_subscripts(every, 1) AS place FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS line_key FROM p),
g AS (SELECT line_key, max(doc_id) AS last FROM k WHERE length(line_key) >= 20 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.last IS NOT NULL AND g.last <> k.doc_id AS lost FROM k LEFT JOIN g USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op13_block_max_search": f"""
WITH d AS (SELECT doc_id, {_terms("text")} AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS held, sum(len(terms))::BIGINT AS words FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(held) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * held) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
}
