"""Query orchestration."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions.intent import IntentRules
from predia.operators.filters import evaluable
from predia.plans import orchestration as O, valuation as W, views as V
from predia.registry import entry
from predia.registry.sql import sql
from predia.registry.valuation import MAE, REASON_SQL, pool, reason
from predia.session import cut

# Words of the invented prose stand for zones, types, topics and qualifiers.
RULES = IntentRules(
    zones=["thon", "eauen", "schen"],
    types={"Casa": ["erhe"], "Apartamento": ["tion"]},
    topic_words=["the", "eau", "sch"],
    vague_words=["onen", "que "],
    place=r"(?:^|\s)(?:of|de|in)\s+([a-zA-Z]{4,})",
)

INTENT = r"""intent AS (SELECT *, CASE WHEN nz > 1 THEN 0.3 WHEN anchors = 0 THEN 0.2 WHEN NOT vague THEN 0.95 WHEN anchors >= 3 THEN 0.8 WHEN anchors = 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS confianza FROM (
  SELECT *, (zona IS NOT NULL)::INT + (tipo IS NOT NULL)::INT AS anchors FROM (
  SELECT consulta_id, contains(t, 'the') OR contains(t, 'eau') OR contains(t, 'sch') AS tema, len(zs) AS nz, CASE WHEN len(zs) = 1 THEN zs[1] END AS zona,
    CASE WHEN len(zs) > 0 THEN array_to_string(zs, ' / ') ELSE nullif(regexp_extract(consulta, '(?:^|\s)(?:of|de|in)\s+([a-zA-Z]{4,})', 1), '') END AS mencion,
    CASE WHEN contains(t, 'erhe') THEN 'Casa' WHEN contains(t, 'tion') THEN 'Apartamento' END AS tipo,
    contains(t, 'onen') OR contains(t, 'que ') AS vague FROM (
    SELECT consulta_id, consulta, lower(consulta) AS t, [z FOR z IN ['thon', 'eauen', 'schen'] IF contains(lower(consulta), z)] AS zs FROM query_log))))"""
CLASSIFIED = """classified AS (SELECT *, CASE WHEN NOT tema THEN 'fallback_fuera_tema'
  WHEN mencion IS NOT NULL AND zona IS NULL AND NOT (contains(lower(mencion), 'thon') OR contains(lower(mencion), 'eauen') OR contains(lower(mencion), 'schen')) THEN 'fallback_cobertura'
  WHEN confianza < 0.65 THEN 'fallback_ambiguedad' ELSE 'exito' END AS categoria FROM intent)"""


def intent_sql(body: str) -> str:
    head = sql("SELECT 1 FROM query_log")
    return head[: head.rindex("\n")] + ",\n" + INTENT + ",\n" + CLASSIFIED + "\n" + body


def classified(spark, d):
    return O.classify(V.query_log(spark, d), RULES)


# Wishes with numbers, added to the queries by key.
WISHES = [" entre $100,000 y 250,000", " hasta $ 90.000", " desde $5,000 con 3 habitaciones", " con 2 baños y 4 cuartos", ""]


def _number_sql(pattern: str, group: int = 1) -> str:
    return f"try_cast(regexp_replace(regexp_extract(t, '{pattern}', {group}), '[,.]', '', 'g') AS DOUBLE)"


FULL_INTENT = rf"""deseo AS (SELECT consulta_id, consulta, lower(consulta) AS t FROM (
  SELECT consulta_id, consulta || {WISHES!r}[consulta_id % 5 + 1] AS consulta FROM query_log)),
campos AS (SELECT *, [z FOR z IN ['thon', 'eauen', 'schen'] IF contains(t, z)] AS zs,
    coalesce({_number_sql(RULES.range_price)}, {_number_sql(RULES.min_price)}) AS minimo,
    coalesce({_number_sql(RULES.range_price, 2)}, {_number_sql(RULES.max_price)}) AS maximo,
    {_number_sql(RULES.rooms)}::INT AS habitaciones, {_number_sql(RULES.baths)}::INT AS banos,
    CASE WHEN contains(t, 'erhe') THEN 'Casa' WHEN contains(t, 'tion') THEN 'Apartamento' END AS tipo, contains(t, 'onen') OR contains(t, 'que ') AS vago FROM deseo),
anclas AS (SELECT *, (len(zs) = 1)::INT + (tipo IS NOT NULL)::INT + (minimo IS NOT NULL OR maximo IS NOT NULL)::INT
  + (habitaciones IS NOT NULL)::INT + (banos IS NOT NULL)::INT AS n FROM campos)"""


def full_intent_sql(body: str) -> str:
    head = sql("SELECT 1 FROM query_log")
    return head[: head.rindex("\n")] + ",\n" + FULL_INTENT + "\n" + body


def wished(spark, d):
    """The queries with their wishes, extracted and classified."""
    wish = F.get(F.array(*map(F.lit, WISHES)), (F.col("consulta_id") % 5).cast("int"))
    return O.classify(V.query_log(spark, d).withColumn("consulta", F.concat("consulta", wish)), RULES)


@entry("q1_intent", full_intent_sql(r"""
SELECT consulta_id, contains(t, 'the') OR contains(t, 'eau') OR contains(t, 'sch') AS es_consulta_inmobiliaria, CASE WHEN len(zs) = 1 THEN zs[1] ELSE '-' END AS zona,
  CASE WHEN len(zs) > 0 THEN array_to_string(zs, ' / ') ELSE coalesce(nullif(regexp_extract(consulta, '(?:^|\s)(?:of|de|in)\s+([a-zA-Z]{4,})', 1), ''), '-') END AS zona_mencion_texto,
  coalesce(tipo, '-') AS tipo_inmueble, coalesce(minimo, -1) AS precio_min, coalesce(maximo, -1) AS precio_max, coalesce(habitaciones, -1) AS habitaciones_min,
  coalesce(banos, -1) AS banos_min, CASE WHEN len(zs) > 1 THEN 0.3 WHEN n = 0 THEN 0.2 WHEN NOT vago THEN 0.95 WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS confianza
FROM anclas"""))
def _(spark, d):
    return wished(spark, d).select(
        "consulta_id", "es_consulta_inmobiliaria", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("zona", "zona_mencion_texto", "tipo_inmueble")],
        *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("precio_min", "precio_max")],
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("habitaciones_min", "banos_min")], "confianza",
    )


@entry("q2_outcome", intent_sql("SELECT consulta_id, categoria FROM classified"))
def _(spark, d):
    return classified(spark, d).select("consulta_id", "categoria")


@entry("q3_watch_band", intent_sql("SELECT consulta_id, confianza FROM classified WHERE confianza BETWEEN 0.55 AND 0.75"))
def _(spark, d):
    return O.watch_band(classified(spark, d)).select("consulta_id", "confianza")


@entry("q4_confidence_by_group", intent_sql("SELECT consulta_id % 1000 AS turno, count(*) AS n, round(avg(confianza), 6) AS confianza_media FROM classified GROUP BY 1"))
def _(spark, d):
    got = O.confidence_by_group(classified(spark, d).withColumn("turno", F.col("consulta_id") % 1000), "turno")
    return got.withColumn("confianza_media", F.round("confianza_media", 6))


#: Values of the catalogue for the words of the queries.
ZONE_NAMES = {"thon": "NATION_1", "eauen": "NATION_4", "schen": "NATION_7"}
TYPE_NAMES = {"Casa": "BUILDING", "Apartamento": "MACHINERY"}


def requests(spark, d, asked=None):
    """The queries that can be searched, with the bounds they state and a vector each."""
    vectors = V.table(spark, d, "embeddings")
    base = O.search_requests(wished(spark, d) if asked is None else asked, ZONE_NAMES, TYPE_NAMES)
    base = base.withColumn("vec_id", F.pmod("consulta_id", vectors.agg(F.count("*").alias("n")).scalar()))
    return base.join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def _renamed(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


SEARCH = FULL_INTENT + rf""",
leido AS (SELECT *, contains(t, 'the') OR contains(t, 'eau') OR contains(t, 'sch') AS tema, CASE WHEN len(zs) = 1 THEN zs[1] END AS zona,
    CASE WHEN len(zs) > 0 THEN array_to_string(zs, ' / ') ELSE nullif(regexp_extract(consulta, '(?:^|\s)(?:of|de|in)\s+([a-zA-Z]{{4,}})', 1), '') END AS mencion,
    CASE WHEN len(zs) > 1 THEN 0.3 WHEN n = 0 THEN 0.2 WHEN NOT vago THEN 0.95 WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS confianza FROM anclas),
juzgado AS (SELECT *, CASE WHEN NOT tema THEN 'fallback_fuera_tema'
  WHEN mencion IS NOT NULL AND zona IS NULL AND NOT (contains(lower(mencion), 'thon') OR contains(lower(mencion), 'eauen') OR contains(lower(mencion), 'schen')) THEN 'fallback_cobertura'
  WHEN confianza < 0.65 THEN 'fallback_ambiguedad' ELSE 'exito' END AS categoria FROM leido),
pedido AS (SELECT consulta_id, {_renamed("zona", ZONE_NAMES)} AS zona, {_renamed("tipo", TYPE_NAMES)} AS tipo_pedido, minimo AS precio_min, maximo AS precio_max,
  habitaciones AS habitaciones_min, banos AS banos_min, consulta_id % (SELECT count(*) FROM embeddings) AS q_vec FROM juzgado WHERE categoria = 'exito'),
vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
par AS MATERIALIZED (SELECT a.vec_id AS q_vec, b.vec_id, round(1 - list_cosine_similarity(a.v, b.v), 9) AS distancia
  FROM (SELECT * FROM vec WHERE vec_id IN (SELECT q_vec FROM pedido)) a, vec b),
hallado AS (SELECT * FROM (SELECT consulta_id, q.listing_id, corregimiento, tipo_inmueble, price_usd, bedrooms, bathrooms, area_m2, distancia,
    row_number() OVER (PARTITION BY consulta_id ORDER BY distancia, q.listing_id) AS rank FROM (
  SELECT consulta_id, l.*, distancia FROM pedido p JOIN par USING (q_vec) JOIN listing_vector l ON l.vec_id = par.vec_id
       AND l.corregimiento <> 'zona_no_determinada' AND NOT l.precio_no_evaluable AND (p.zona IS NULL OR l.corregimiento = p.zona) AND (p.tipo_pedido IS NULL OR l.tipo_inmueble = p.tipo_pedido)
    AND (p.precio_min IS NULL OR l.price_usd >= p.precio_min) AND (p.banos_min IS NULL OR l.bathrooms >= p.banos_min)
    AND (p.precio_max IS NULL OR l.price_usd <= p.precio_max) AND (p.habitaciones_min IS NULL OR l.bedrooms >= p.habitaciones_min)) q) WHERE rank <= 10),
luz AS (SELECT listing_id, CASE WHEN precio_real - precio_predicho > 1.5 * {MAE} THEN 'rojo' WHEN precio_real - precio_predicho < -1.5 * {MAE} THEN 'verde' ELSE 'amarillo' END AS luz FROM estimate),
resultado AS (SELECT h.*, luz.luz, CASE WHEN luz.luz IS NULL THEN coalesce({REASON_SQL}, 'sin valuación') END AS motivo FROM hallado h LEFT JOIN luz USING (listing_id))"""


def search_sql(body: str) -> str:
    marker = "/*extra*/"
    return sql(f"{marker}{SEARCH}\n{body}").replace(f"\n{marker}", ",\n")


def search(spark, d, asked=None):
    p = pool(spark, d)

    def value(found):
        return W.valuation(p.join(found, "listing_id", "left_semi"), p.filter("es_train"), mae_reference=MAE)

    # Derived once: the search and the attributes of what it finds read the listings several times.
    base = cut(evaluable(V.listing(spark, d)).select(
        "listing_id", "corregimiento", "tipo_inmueble", "price_usd", "bedrooms", "bathrooms", "area_m2"
    ))
    listings = V.listing_vector(spark, d, base).drop("vec_id")
    return O.enriched_search(requests(spark, d) if asked is None else asked, listings, value, reason())


@entry("q5_search_with_valuation", search_sql("""
SELECT consulta_id, rank, listing_id, distancia, coalesce(luz, '-') AS luz, coalesce(motivo, '-') AS motivo FROM resultado"""))
def _(spark, d):
    return search(spark, d).select(
        "consulta_id", "rank", "listing_id", "distancia", F.coalesce("categoria_semaforo", F.lit("-")).alias("luz"),
        F.coalesce("motivo_sin_semaforo", F.lit("-")).alias("motivo"),
    )


@entry("q6_answer_text", search_sql("""
SELECT consulta_id, categoria, coalesce(n_candidatos, 0) AS n_candidatos, coalesce(n_con_semaforo, 0) AS n_con_semaforo, coalesce(respuesta, CASE categoria
  WHEN 'fallback_fuera_tema' THEN 'La consulta no trata de una propiedad. Indica zona, tipo o presupuesto.'
  WHEN 'fallback_cobertura' THEN '''' || mencion || ''' está fuera de las zonas cubiertas.'
  ELSE 'Consulta ambigua (confianza ' || printf('%.2f', confianza) || ', umbral 0.65: ' || CASE WHEN len(zs) > 1 THEN 'varias zonas sin desempate' WHEN anclado = 0 THEN 'sin entidades concretas'
    WHEN NOT vago THEN 'entidades con ancla clara' ELSE 'mezcla de anclas y calificativos' END || ').' END) AS respuesta
FROM (SELECT consulta_id, categoria, mencion, confianza, zs, vago, n AS anclado FROM juzgado) LEFT JOIN (SELECT consulta_id, n AS n_candidatos, c AS n_con_semaforo, CASE
  WHEN n = 0 AND m IS NOT NULL THEN 'Sin propiedades para esos criterios en ' || zona || '. El modelo de precio tampoco cubre la zona o el tipo (' || m || ').'
  WHEN n = 0 THEN 'Sin propiedades para esos criterios en ' || coalesce(zona, 'la zona indicada') || '. Prueba otro precio, tipo o habitaciones.'
  WHEN c = 0 THEN n || ' propiedades coinciden, ninguna con semáforo de precio (' || coalesce(m, primero) || ').'
  WHEN c < n THEN n || ' propiedades coinciden, ' || c || ' con semáforo de precio.' ELSE n || ' propiedades coinciden, todas con semáforo de precio.' END AS respuesta
FROM (SELECT p.consulta_id, p.zona, coalesce(k.n, 0) AS n, coalesce(k.c, 0) AS c, k.primero, CASE WHEN p.zona IS NOT NULL AND p.tipo_pedido IS NOT NULL THEN nullif(concat_ws('; ',
    CASE WHEN p.zona IN ('NATION_7', 'NATION_8') THEN '''' || p.zona || ''' no entra en el modelo de precio' END,
    CASE WHEN p.tipo_pedido <> 'BUILDING' THEN 'tipo_inmueble ''' || p.tipo_pedido || ''' no entra en el modelo de precio' END), '') END AS m
  FROM pedido p LEFT JOIN (SELECT consulta_id, count(*) AS n, count(luz) AS c, arg_min(motivo, rank) AS primero FROM resultado GROUP BY 1) k USING (consulta_id))) USING (consulta_id)"""))
def _(spark, d):
    """One job: extract and classify, search what can be searched, value what was found, answer every query."""
    zones = [f"NATION_{i}" for i in range(24) if i not in (7, 8)]
    asked = cut(wished(spark, d))
    ready = cut(requests(spark, d, asked))
    return O.respond(asked, O.answers(ready.drop("vector"), search(spark, d, ready), zones, V.MODEL_TYPE))


@entry("q7_fallback_message", intent_sql("""
SELECT consulta_id, CASE categoria WHEN 'fallback_fuera_tema' THEN 'La consulta no trata de una propiedad. Indica zona, tipo o presupuesto.'
  WHEN 'fallback_cobertura' THEN '''' || mencion || ''' está fuera de las zonas cubiertas.'
  ELSE 'Consulta ambigua (confianza ' || printf('%.2f', confianza) || ', umbral 0.65: ' || CASE WHEN nz > 1 THEN 'varias zonas sin desempate' WHEN anchors = 0 THEN 'sin entidades concretas'
    WHEN NOT vague THEN 'entidades con ancla clara' ELSE 'mezcla de anclas y calificativos' END || ').' END AS mensaje FROM classified WHERE categoria <> 'exito'"""))
def _(spark, d):
    return classified(spark, d).filter("categoria <> 'exito'").select("consulta_id", "mensaje")


@entry("q8_outcome_mix", intent_sql("""
SELECT k AS categoria, count(*) FILTER (WHERE categoria = k) AS n, round(count(*) FILTER (WHERE categoria = k) / count(*)::DOUBLE, 6) AS share
FROM classified, (SELECT unnest(['exito', 'fallback_cobertura', 'fallback_fuera_tema', 'fallback_ambiguedad']) AS k) GROUP BY 1"""))
def _(spark, d):
    return O.outcome_mix(classified(spark, d)).withColumn("share", F.round("share", 6))
