"""Data-quality gates as reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from predia.operators import gates as G
from predia.plans import matching as M, views as V
from predia.plans.constraints import TABLES, report
from predia.registry import entry
from predia.registry.aggregation import DRIFT_SQL, drift_query
from predia.registry.filtering import PROFILE_MATCH
from predia.registry.sql import sql
from predia.registry.valuation import pool


@entry("g1_row_count", sql("SELECT count(*) AS filas, (count(*) <> (SELECT count(*) FROM orders))::BIGINT AS violaciones FROM listing"))
def _(spark, d):
    expected = V.table(spark, d, "orders").agg(F.count("*").alias("n")).scalar()
    return G.row_count(V.listing(spark, d), expected)


@entry("g2_table_checks", """
SELECT 'tipo' AS regla, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS violaciones FROM lineitem
UNION ALL SELECT 'cantidad', count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 49) FROM lineitem
UNION ALL SELECT 'uno_de_dos', count(*) FILTER (WHERE l_linenumber % 2 = 0 AND l_partkey % 2 = 1 OR l_linenumber % 2 = 1 AND l_partkey % 2 = 0) FROM lineitem
UNION ALL SELECT 'unico:l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'referencia:l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)""")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(1)).alias("perfil"), F.when(F.col("l_partkey") % 2 == 1, F.lit(1)).alias("sesion"),
    )
    reports = [
        G.check_rules(rows, {
            "tipo": G.in_set("l_returnflag", ["A", "N"]), "cantidad": F.col("l_quantity").between(1, 49),
            "uno_de_dos": G.exactly_one("perfil", "sesion"),
        }),
        G.unique_key(rows, ["l_orderkey", "l_linenumber"]),
        G.foreign_key(rows, "l_orderkey", V.table(spark, d, "documents"), "doc_id"),
    ]
    return reduce(DataFrame.unionByName, reports)




def _turns(column: str, rules) -> list | None:
    """Values a column takes in turn, with one outside of its set or range; None for columns without such a rule."""
    if column in rules.sets:
        values = list(rules.sets[column])
        return [*values, "fuera" if isinstance(values[0], str) else not values[0] if isinstance(values[0], bool) else 99]
    if column in rules.ranges:
        low, high = rules.ranges[column]
        return [*range(low, high + 1), high + 1]
    return None


def _columns(rules) -> list[str]:
    return list(dict.fromkeys([*rules.key, *rules.required, *rules.sets, *rules.ranges, *(c for u in rules.unique for c in u), *rules.references, *rules.one_of]))


def checked_table(rows, name: str):
    """Rows of a table by order key k: keys repeat at every 97th, required values lack at every 31st, references
    point to nothing at every 11th, and both of two exclusive columns are given at every 5th."""
    k, rules, out = F.col("k"), TABLES[name], []
    key = F.when(k % 97 == 0, k - 1).otherwise(k)
    for i, c in enumerate(_columns(rules)):
        turns = _turns(c, rules)
        if c in rules.one_of:
            value = F.when((k % 2 == rules.one_of.index(c)) | (k % 5 == 0), key.cast("string"))
        elif c in rules.references:
            value = F.when(k % 11 == 0, F.lit("-1")).otherwise(key.cast("string"))
        elif c in rules.key or c in [u for one in rules.unique for u in one]:
            value = key.cast("string")
        elif turns:
            value = F.get(F.array(*map(F.lit, turns)), ((k + i) % len(turns)).cast("int"))
        else:
            value = F.when((k + i) % 31 != 0, F.lit("x"))
        out.append(value.alias(c))
    return rows.select(*out)


def checked_sql(name: str) -> list[str]:
    rules, given = TABLES[name], set(TABLES)
    cols = _columns(rules)
    uniques = [u for one in rules.unique for u in one]
    lines = []

    def add(rule: str, count: str) -> None:
        lines.append(f"SELECT '{name}' AS tabla, '{rule}' AS regla, ({count})::BIGINT AS violaciones")

    for c in dict.fromkeys((*rules.key, *rules.required)):
        plain = not (_turns(c, rules) or c in rules.references or c in rules.key or c in uniques or c in rules.one_of)
        add(f"requerido:{c}", f"SELECT count(*) FILTER ((k + {cols.index(c)}) % 31 = 0) FROM o" if plain else "SELECT 0")
    for c in (*rules.sets, *rules.ranges):
        n = len(_turns(c, rules))
        add(f"{'conjunto' if c in rules.sets else 'rango'}:{c}", f"SELECT count(*) FILTER ((k + {cols.index(c)}) % {n} = {n - 1}) FROM o")
    if rules.one_of:
        add("uno_de:" + ",".join(rules.one_of), "SELECT count(*) FILTER (k % 5 = 0) FROM o")
    for keys in (rules.key, *rules.unique):
        own = [c for c in keys if c in rules.references and c not in rules.one_of]
        parts = ", ".join("CASE WHEN k % 11 = 0 THEN -1 ELSE kk END" if c in own else "kk" for c in keys)
        add("unico:" + ",".join(keys), f"SELECT count(*) FROM (SELECT {parts} FROM o GROUP BY ALL HAVING count(*) > 1)".replace(f"SELECT {parts} FROM", f"SELECT {', '.join(f'{p} AS c{i}' for i, p in enumerate(parts.split(', ')))} FROM"))
    for c, (parent, parent_key) in rules.references.items():
        value = f"CASE WHEN k % 2 = {rules.one_of.index(c)} OR k % 5 = 0 THEN kk END" if c in rules.one_of else "CASE WHEN k % 11 = 0 THEN -1 ELSE kk END"
        held = "SELECT CASE WHEN k % 11 = 0 THEN -1 ELSE kk END FROM o" if parent_key in TABLES[parent].references else "SELECT kk FROM o"
        if parent in given:
            add(f"referencia:{c}", f"SELECT count(*) FROM (SELECT {value} AS v FROM o) WHERE v IS NOT NULL AND v NOT IN ({held})")
    return lines


@entry("g2_reference_rules", "WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS kk FROM orders)\n"
    + "\nUNION ALL ".join(line for name in TABLES for line in checked_sql(name)))
def _(spark, d):
    """Every closed set, range, required column, key and reference of the stored tables, each with rows that break it."""
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return report({name: checked_table(rows, name) for name in TABLES})


@entry("g3_vector_size", "SELECT count(*) AS filas, count(*) FILTER (WHERE len(embedding) <> 64) AS violaciones FROM embeddings")
def _(spark, d):
    return G.vector_size(V.table(spark, d, "embeddings"), "embedding", 64)


@entry("g4_unmatched_keys", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    base = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return G.unmatched_keys(V.table(spark, d, "labels").select("doc_id", "quality"), base, "doc_id")


@entry("g5_declared_counts", sql("SELECT p.perfil, count(*) + (p.perfil = 'joven')::INT AS declarados, count(*) AS reales, (p.perfil = 'joven')::BIGINT AS violaciones "
    + PROFILE_MATCH.replace("listing_text", "listing") + " GROUP BY 1"))
def _(spark, d):
    members = M.rule_matches(V.listing(spark, d), M.profile_table(spark, V.PROFILES)).select("perfil", "listing_id")
    declared = members.groupBy("perfil").agg((F.count("*") + F.max((F.col("perfil") == "joven").cast("int"))).alias("n_ground_truth"))
    return G.declared_counts(declared, members, "perfil")


@entry("g6_reference_values", sql("""
SELECT 'media' AS medida, round(avg(price_usd), 4) AS valor, (NOT abs(avg(price_usd) - 250000) <= 20000)::BIGINT AS violaciones FROM listing
UNION ALL SELECT 'desviacion', round(stddev_samp(price_usd), 4), (NOT abs(stddev_samp(price_usd) - 1000) <= 20000)::BIGINT FROM listing"""))
def _(spark, d):
    got = G.close_to(V.listing(spark, d), {"media": (F.avg("price_usd"), 250000), "desviacion": (F.stddev_samp("price_usd"), 1000)}, 20000)
    return got.select("medida", F.round("valor", 4).alias("valor"), "violaciones")


@entry("g7_weights_sum", "SELECT round(sum(w), 9) AS suma, (abs(sum(w) - 1) > 1e-9)::BIGINT AS violaciones FROM (SELECT count(*) / sum(count(*)) OVER () AS w FROM customer GROUP BY c_mktsegment)")
def _(spark, d):
    from predia.operators.aggregates import group_share

    shares = group_share(V.table(spark, d, "customer"), "c_mktsegment").withColumnRenamed("share", "peso")
    return G.weights_sum(shares).withColumn("suma", F.round("suma", 9))


entry("g8_drift_gate", DRIFT_SQL)(drift_query)


@entry("g9_price_alignment", sql("""
SELECT count(*) AS claves, count(*) FILTER (WHERE p.listing_id IS NULL) AS sin_pareja, count(*) FILTER (WHERE p.price_usd <> o_totalprice) AS violaciones
FROM orders LEFT JOIN pool p ON p.listing_id = o_orderkey"""))
def _(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("price_usd"))
    return G.aligned(orders, pool(spark, d), "listing_id", "price_usd")
