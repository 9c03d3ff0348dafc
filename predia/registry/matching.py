"""Preference matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.operators import gates as G, sets as S
from predia.operators.filters import evaluable
from predia.operators.overlap import overlap
from predia.operators.vector_search import vector_topk
from predia.plans import matching as M, profile_tables as T, views as V
from predia.registry import entry
from predia.registry.filtering import PROFILE_MATCH
from predia.registry.joining import PROBES, probes
from predia.registry.sql import sql
from predia.registry.windows_sets import OVERLAP_SQL
from predia.session import cut, scratch_path
from predia.sources.writers import write_table

P = V.PROFILES
KEYWORDS = """ AND len(list_filter(p.incluye, lambda w: contains(lower(l.descripcion), w))) > 0
  AND len(list_filter(p.excluye, lambda w: contains(lower(l.descripcion), w))) = 0 AND l.descripcion_fuente <> 'ninguna'"""


def _case(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 1.0 ELSE 0.0 END"


def structural_sql() -> str:
    parts = []
    for p in P:
        zones = ", ".join(f"'{z}'" for z in p["corregimientos"])
        criteria = [f"corregimiento IN ({zones})"]
        for c in M.RULE_COLUMNS:
            for side, op in (("min", ">="), ("max", "<=")):
                if p.get(f"{c}_{side}") is not None:
                    criteria.append(f"{c} {op} {p[f'{c}_{side}']}")
        score = f"({' + '.join(_case(c) for c in criteria)})::DOUBLE / {len(criteria)}"
        parts.append(f"SELECT listing_id, '{p['perfil']}' AS perfil, {score} AS score_estructurado, embedding FROM lv")
    return " UNION ALL ".join(parts)


def score_heads() -> list[str]:
    names = ", ".join(f"'{p['perfil']}'" for p in P)
    return [
        "lv AS (SELECT * FROM listing_vector WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable)",
        PROBES,
        f"pv AS (SELECT [{names}][(query_id % {len(P)} + 1)::INT] AS perfil, vector FROM probe WHERE query_id < {len(P)})",
        f"st AS ({structural_sql()})",
        "co AS (SELECT st.listing_id, st.perfil, score_estructurado, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS coseno FROM st JOIN pv ON st.perfil = pv.perfil)",
        """se AS (SELECT *, CASE WHEN max(coseno) OVER w = min(coseno) OVER w THEN 0 ELSE (coseno - min(coseno) OVER w) / (max(coseno) OVER w - min(coseno) OVER w) END AS score_semantico
  FROM co WINDOW w AS (PARTITION BY perfil))""",
        "hy AS (SELECT *, round(0.6::DOUBLE * score_estructurado + 0.4::DOUBLE * score_semantico, 9) AS score_hibrido FROM se)",
        "gt AS (SELECT p.perfil, l.listing_id " + PROFILE_MATCH + KEYWORDS + ")",
    ]


def scored_sql(body: str) -> str:
    heads = score_heads()
    marker = "/*extra*/"
    text = sql(f"{marker}{', '.join(heads)}\n{body}")
    return text.replace(f"\n{marker}", ",\n")


def candidates(spark, d):
    return evaluable(V.listing_vector(spark, d))


def profile_vectors(spark, d):
    names = F.array(*[F.lit(p["perfil"]) for p in P])
    return probes(spark, d).filter(F.col("query_id") < len(P)).select(
        F.get(names, F.col("query_id").cast("int")).alias("perfil"), "vector"
    )


def scored(spark, d):
    listings = candidates(spark, d).select("listing_id", "corregimiento", "price_usd", "bedrooms", "area_m2", "embedding")
    return M.profile_scores(listings, profile_vectors(spark, d), P)


@entry("pm1_structural_score", scored_sql("SELECT listing_id, perfil, round(score_estructurado, 9) AS score FROM st"))
def _(spark, d):
    got = M.structural_scores(candidates(spark, d), P)
    return got.select("listing_id", "perfil", F.round("score_estructurado", 9).alias("score"))


@entry("pm2_semantic_score", scored_sql("SELECT listing_id, perfil, round(score_semantico, 6) AS score FROM se"))
def _(spark, d):
    return scored(spark, d).select("listing_id", "perfil", F.round("score_semantico", 6).alias("score"))


@entry("pm3_hybrid_ranking", scored_sql("""
SELECT perfil, listing_id, score_hibrido AS score, row_number() OVER (PARTITION BY perfil ORDER BY score_hibrido DESC, listing_id) AS rank FROM hy"""))
def _(spark, d):
    ranked = M.ranking(M.hybrid(scored(spark, d)).select("perfil", "listing_id", "score_hibrido"))
    return ranked.select("perfil", "listing_id", F.col("score_hibrido").alias("score"), "rank")


def customer_profiles(spark, d):
    """Every customer as a profile: its zone and NATION_1, a price limit, rooms, and the vector of its label."""
    k = F.col("c_custkey")
    nothing = F.lit(None).cast("double")
    vectors = probes(spark, d).withColumnRenamed("query_id", "etiqueta")
    return V.table(spark, d, "customer").select(
        k.cast("string").alias("perfil"), F.array(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), F.lit("NATION_1")).alias("corregimientos"),
        nothing.alias("price_usd_min"), (F.col("c_acctbal") * 40).cast("double").alias("price_usd_max"),
        F.nullif(k % 5, F.lit(0)).cast("double").alias("bedrooms_min"), *[nothing.alias(c) for c in ("bedrooms_max", "area_m2_min", "area_m2_max")],
        (k % 10).cast("bigint").alias("etiqueta"),
    ).join(vectors, "etiqueta")


@entry("pm3_customer_ranking", scored_sql("""
, cu AS (SELECT c_custkey, 'NATION_' || c_nationkey AS z, c_acctbal * 40 AS tope, c_custkey % 5 AS cuartos, c_custkey % 10 AS etiqueta FROM customer),
cc AS (SELECT query_id, listing_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS c FROM probe, lv),
ex AS (SELECT query_id, min(c) AS lo, max(c) AS hi FROM cc GROUP BY 1),
ss AS (SELECT c_custkey, lv.listing_id, (CASE WHEN corregimiento IN (z, 'NATION_1') THEN 1 ELSE 0 END + CASE WHEN price_usd <= tope THEN 1 ELSE 0 END
    + CASE WHEN cuartos > 0 AND bedrooms >= cuartos THEN 1 ELSE 0 END)::DOUBLE / (CASE WHEN cuartos > 0 THEN 3 ELSE 2 END) AS s, CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0 END AS m
  FROM cu JOIN cc ON cc.query_id = etiqueta JOIN ex ON ex.query_id = etiqueta JOIN lv ON lv.listing_id = cc.listing_id),
rr AS (SELECT *, round(0.6::DOUBLE * s + 0.4::DOUBLE * m, 9) AS h FROM ss)
SELECT c_custkey::VARCHAR AS perfil, rank, listing_id, round(h, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY h DESC, listing_id) AS rank FROM rr) WHERE rank <= 10""".lstrip()))
def _(spark, d):
    best = T.best_listings(candidates(spark, d), customer_profiles(spark, d), 10)
    return best.select("perfil", F.col("rank").cast("bigint").alias("rank"), "listing_id", F.round("score_hibrido", 6).alias("score"))


@entry("pm4_ground_truth", sql(f"""
SELECT perfil, count(*) AS n_solo_estructural, count(*) FILTER (WHERE k) AS n_ground_truth, count(*) FILTER (WHERE k AND f = 'completa') AS de_completa,
  count(*) FILTER (WHERE k AND f = 'preview') AS de_preview FROM (SELECT p.perfil, l.descripcion_fuente AS f, ({KEYWORDS[5:]}) AS k {PROFILE_MATCH}) GROUP BY 1"""))
def _(spark, d):
    return M.ground_truth_counts(M.ground_truth(V.listing_text(spark, d), P))


@entry("pm5_materialised_truth", sql(f"""
SELECT perfil, n + (perfil < 'i')::BIGINT AS declarados, n AS reales, (perfil < 'i')::BIGINT AS violaciones FROM (
  SELECT perfil, count(*) AS n FROM (SELECT p.perfil, l.listing_id {PROFILE_MATCH}{KEYWORDS}) GROUP BY 1)"""))
def _(spark, d):
    matches = cut(M.ground_truth(V.listing_text(spark, d), P))
    profiles, members = scratch_path(spark, "perfiles"), scratch_path(spark, "referencia")
    # Some profiles declare one match too many, which the gate has to find.
    counts = M.ground_truth_counts(matches)
    write_table(counts.withColumn("n_ground_truth", F.col("n_ground_truth") + (F.col("perfil") < "i").cast("bigint")), profiles)
    write_table(matches.filter("cualitativo").select("perfil", "listing_id", F.lit(True).alias("flag_sintetico")), members)
    return G.declared_counts(spark.read.parquet(profiles), spark.read.parquet(members), "perfil")


def truth(spark, d):
    return M.ground_truth(V.listing_text(spark, d), P).filter("cualitativo").select("perfil", "listing_id")


PRECISION = "SELECT perfil, " + ", ".join(
    f"count(*) FILTER (WHERE r <= {k} AND hit) / {k}::DOUBLE AS p{k}" for k in (3, 5, 10)
) + """ FROM (SELECT x.*, gt.listing_id IS NOT NULL AS hit FROM (SELECT perfil, listing_id, row_number() OVER (PARTITION BY perfil ORDER BY {0} DESC, listing_id) AS r FROM hy) x
  LEFT JOIN gt ON gt.perfil = x.perfil AND gt.listing_id = x.listing_id WHERE r <= 10) GROUP BY 1"""


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@entry("pm6_precision_at_k", scored_sql(f"SELECT perfil, round(p3, 6) AS p3, round(p5, 6) AS p5, round(p10, 6) AS p10 FROM ({PRECISION.format('score_hibrido')})"))
def _(spark, d):
    hybrid = M.hybrid(scored(spark, d))
    return rounded(M.precision_at(hybrid, truth(spark, d), ["perfil"], "score_hibrido"), ["p3", "p5", "p10"])


@entry("pm7_lift", scored_sql(f"""
, a AS ({PRECISION.format('score_hibrido')}), b AS ({PRECISION.format('score_estructurado')}),
c AS (SELECT a.perfil, a.p3 - b.p3 AS x, a.p5 - b.p5 AS y, a.p10 - b.p10 AS z FROM a JOIN b USING (perfil))
SELECT perfil, round(x, 6) AS lift_p3, round(y, 6) AS lift_p5, round(z, 6) AS lift_p10 FROM c
UNION ALL SELECT 'promedio', round(avg(x), 6), round(avg(y), 6), round(avg(z), 6) FROM c""".lstrip()))
def _(spark, d):
    both = cut(M.hybrid(scored(spark, d)))
    t = cut(truth(spark, d))
    hybrid = M.precision_at(both, t, ["perfil"], "score_hibrido")
    plain = M.precision_at(both, t, ["perfil"], "score_estructurado")
    return rounded(M.lift(hybrid, plain), ["lift_p3", "lift_p5", "lift_p10"])


@entry("pm8_weight_sweep", scored_sql("""
, sw AS (SELECT perfil, listing_id, w.pesos, round(w.a * score_estructurado + w.b * score_semantico, 9) AS s FROM se,
  (VALUES ('1.0/0.0', 1.0::DOUBLE, 0.0::DOUBLE), ('0.8/0.2', 0.8, 0.2), ('0.7/0.3', 0.7, 0.3), ('0.6/0.4', 0.6, 0.4), ('0.5/0.5', 0.5, 0.5)) w(pesos, a, b))
SELECT x.pesos, x.perfil, """.lstrip() + ", ".join(f"round(count(*) FILTER (WHERE r <= {k} AND gt.listing_id IS NOT NULL) / {k}::DOUBLE, 6) AS p{k}" for k in (3, 5, 10)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY pesos, perfil ORDER BY s DESC, listing_id) AS r FROM sw) x
LEFT JOIN gt ON gt.perfil = x.perfil AND gt.listing_id = x.listing_id WHERE r <= 10 GROUP BY 1, 2"""))
def _(spark, d):
    return rounded(M.weight_sweep(scored(spark, d), truth(spark, d)), ["p3", "p5", "p10"])


def _overlap_part(kind: str, members: str) -> str:
    return f"SELECT '{kind}' AS etapa, * FROM (WITH m AS ({members}),\n{OVERLAP_SQL})"


@entry("pm9_overlap_before_after", sql(
    _overlap_part("estructural", "SELECT p.perfil, l.listing_id " + PROFILE_MATCH) + " UNION ALL "
    + _overlap_part("final", "SELECT p.perfil, l.listing_id " + PROFILE_MATCH + KEYWORDS)))
def _(spark, d):
    matches = cut(M.ground_truth(V.listing_text(spark, d), P))
    names = [p["perfil"] for p in P]
    return S.union_labelled({
        "estructural": overlap(matches, names), "final": overlap(matches.filter("cualitativo"), names),
    }, "etapa")


def user_profiles(spark, d):
    """Customers as stored preferences."""
    k = F.col("c_custkey")
    zone = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return V.table(spark, d, "customer").select(
        k.alias("perfil_id"), (F.col("c_acctbal") * 40).alias("precio_maximo"), (k % 5).alias("habitaciones_min"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 9 == 0, F.array(zone, F.lit("OCEANO"))).otherwise(F.array(zone, F.lit("NATION_1"))).alias("zonas_preferidas"),
    )


@entry("pm10_profile_validation", """
SELECT c_custkey AS perfil_id, m AS motivo, m = '' AS valido FROM (SELECT c_custkey, concat_ws('; ',
  CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 9 = 0 THEN 'zonas inválidas: OCEANO' END,
  CASE WHEN c_acctbal * 40 <= 0 THEN 'precio_maximo debe ser positivo' END, CASE WHEN c_custkey % 5 <= 0 THEN 'habitaciones_min debe ser positivo' END) AS m FROM customer)""")
def _(spark, d):
    return M.validate_profiles(user_profiles(spark, d), [f"NATION_{i}" for i in range(25)]).select("perfil_id", "motivo", "valido")


def explained_input(spark, d):
    """Every listing next to its own customer's preferences, with a transport score per zone."""
    prefs = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("perfil_id")).join(
        user_profiles(spark, d), "perfil_id"
    )
    score = F.when(F.col("zona_id") % 4 != 0, F.col("zona_id") / 24.0)
    return V.listing(spark, d).withColumn("transporte_score", score).join(prefs, "listing_id").withColumn(
        "habitaciones_min", F.nullif("habitaciones_min", F.lit(0))
    )


@entry("pm11_explanation", sql("""
SELECT listing_id, dimension, coalesce(cumplido::VARCHAR, '?') AS cumplido FROM (SELECT listing_id,
  unnest(['precio', 'habitaciones', 'zona', 'transporte']) AS dimension,
  unnest([price_usd <= c_acctbal * 40, CASE WHEN c_custkey % 5 > 0 THEN coalesce(bedrooms >= c_custkey % 5, false) END,
    CASE WHEN c_custkey % 6 <> 0 THEN corregimiento = 'NATION_' || c_nationkey OR corregimiento = CASE WHEN c_custkey % 9 = 0 THEN 'OCEANO' ELSE 'NATION_1' END END,
    CASE WHEN zona_id % 4 <> 0 THEN zona_id / 24.0::DOUBLE >= 0.5 END]) AS cumplido
  FROM listing JOIN orders ON o_orderkey = listing_id JOIN customer ON o_custkey = c_custkey)"""))
def _(spark, d):
    rows = M.explain(explained_input(spark, d), 0.5)
    return rows.select("listing_id", "dimension", F.coalesce(F.col("cumplido").cast("string"), F.lit("?")).alias("cumplido"))


@entry("pm12_match_request", scored_sql("""
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distancia, listing_id) AS rank FROM (
  SELECT query_id, lv.*, round(1 - list_cosine_similarity(vector, embedding::DOUBLE[]), 9) AS distancia FROM probe, lv WHERE price_usd <= 200000 AND bedrooms >= 2))
SELECT query_id, listing_id, distancia, dimension, coalesce(cumplido::VARCHAR, '?') AS cumplido FROM (SELECT query_id, listing_id, distancia,
  unnest(['precio', 'habitaciones', 'zona', 'transporte']) AS dimension,
  unnest([true, true, corregimiento IN ('NATION_1', 'NATION_2'), CASE WHEN zona_id % 4 <> 0 THEN zona_id / 24.0::DOUBLE >= 0.5 END]) AS cumplido FROM r WHERE rank <= 10)""".lstrip()))
def _(spark, d):
    wanted = "price_usd <= 200000 AND bedrooms >= 2"
    found = cut(vector_topk(probes(spark, d), candidates(spark, d).filter(wanted).select("listing_id", "embedding"), 10))
    # Only ids and distances are written; the attributes of what was found come from the catalogue.
    attributes = V.listing(spark, d).select("listing_id", "price_usd", "bedrooms", "corregimiento", "zona_id")
    joined = found.join(attributes, "listing_id").select(
        "*", F.lit(200000.0).alias("precio_maximo"), F.lit(2).alias("habitaciones_min"),
        F.array(F.lit("NATION_1"), F.lit("NATION_2")).alias("zonas_preferidas"),
        F.when(F.col("zona_id") % 4 != 0, F.col("zona_id") / 24.0).alias("transporte_score"),
    )
    rows = M.explain(joined, 0.5, ["query_id", "listing_id", "distancia"])
    return rows.select("query_id", "listing_id", "distancia", "dimension", F.coalesce(F.col("cumplido").cast("string"), F.lit("?")).alias("cumplido"))


@entry("pm13_embedding_coverage", sql("""
SELECT listing_id, corregimiento = 'zona_no_determinada' OR precio_no_evaluable AS esperado FROM listing WHERE listing_id NOT IN (SELECT vec_id FROM embeddings)"""))
def _(spark, d):
    embedded = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("listing_id"))
    return M.embedding_coverage(V.listing(spark, d), embedded).select("listing_id", "esperado")
