"""SQL texts of the derived views, for checking queries on another engine."""

from __future__ import annotations

import re

from predia.plans import views as V


def _profiles() -> str:
    def value(p, key):
        return "NULL" if p.get(key) is None else f"{p[key]}::DOUBLE"

    def words(p, key):
        return "[" + ", ".join("'" + w + "'" for w in p.get(key, [])) + "]::VARCHAR[]"

    rows = []
    for p in V.PROFILES:
        bounds = ", ".join(
            value(p, f"{c}_{s}") for c in ("price_usd", "bedrooms", "area_m2") for s in ("min", "max")
        )
        rows.append(
            f"('{p['perfil']}', {words(p, 'corregimientos')}, {bounds}, {words(p, 'incluye')}, {words(p, 'excluye')})"
        )
    return (
        "profile(perfil, corregimientos, price_usd_min, price_usd_max, bedrooms_min, bedrooms_max, "
        "area_m2_min, area_m2_max, incluye, excluye) AS (VALUES " + ", ".join(rows) + ")"
    )


def _edges() -> str:
    rows = []
    for i, (name, shape) in enumerate(V.SHAPES.items()):
        for part_no, part in enumerate(shape):
            for ring_no, ring in enumerate(part):
                for j, (x, y) in enumerate(ring):
                    x2, y2 = ring[(j + 1) % len(ring)]
                    rows.append(f"('{name}', {i}, {part_no}, {ring_no}, {x}, {y}, {x2}, {y2})")
    body = ", ".join(rows)
    return (
        "edge AS (SELECT v.nombre, v.orden, v.part_no, v.ring_no, v.x1::DOUBLE x1, v.y1::DOUBLE y1, "
        f"v.x2::DOUBLE x2, v.y2::DOUBLE y2 FROM (VALUES {body}) "
        "v(nombre, orden, part_no, ring_no, x1, y1, x2, y2))"
    )


def contain_sql(points: str, key: str = "id") -> str:
    """(key, nombre) of the first shape holding each point of a table with lat and lng."""
    return f"""
SELECT {key}, min_by(nombre, orden) AS corregimiento_asignado FROM (
  SELECT p.{key}, e.nombre, e.orden,
    count(*) FILTER (WHERE (e.y1 > p.lat) <> (e.y2 > p.lat)
      AND p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1) % 2 = 1 AS odd,
    count(*) FILTER (WHERE (e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lng - e.x1) = 0
      AND p.lng BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
      AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) > 0 AS touch
  FROM {points} p, edge e GROUP BY p.{key}, e.nombre, e.orden) WHERE odd OR touch GROUP BY {key}"""


VIEWS: dict[str, str] = {
    "listing": """listing AS (
SELECT *, precio_no_evaluable_motivo <> '' AS precio_no_evaluable FROM (
SELECT *, CASE
  WHEN price_usd IS NULL OR price_usd < CASE WHEN operation = 'venta' THEN 20000 ELSE 400 END THEN 'precio_bajo_umbral'
  WHEN operation = 'venta' AND area_m2 > 0 AND NOT (price_usd / area_m2 BETWEEN 100 AND 15000) THEN 'precio_m2_fuera_de_rango'
  ELSE '' END AS precio_no_evaluable_motivo
FROM (SELECT o_orderkey AS listing_id,
  'https://example.test/propiedad_p-' || o_orderkey || '.htm' AS listing_url,
  o_orderpriority || ' ' || c_mktsegment || ' ' || n_name AS title,
  CASE WHEN n_nationkey = 24 THEN 'zona_no_determinada' ELSE n_name END AS corregimiento,
  n_nationkey::BIGINT AS zona_id, r_name AS corregimiento_archivo, c_mktsegment AS tipo_inmueble,
  o_totalprice AS price_usd, nullif(n, 8) AS bedrooms, ns AS bathrooms, nullif(q, 100) AS area_m2,
  CASE WHEN contains(lower(o_orderpriority || ' ' || c_mktsegment || ' ' || n_name), '5-low') THEN 'alquiler' ELSE 'venta' END AS operation,
  o_orderdate AS scraped_at, o_orderstatus AS estado
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS ns, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey)))""",
    "listing_text": """listing_text AS (
SELECT l.*, d.text AS descripcion, CASE WHEN d.n_chars < 300 THEN 'ninguna' WHEN d.n_chars < 1000 THEN 'preview' ELSE 'completa' END AS descripcion_fuente
FROM listing l JOIN documents d ON l.listing_id % (SELECT count(*) FROM documents) = d.doc_id)""",
    "listing_vector": """listing_vector AS (
SELECT l.*, e.vec_id, e.embedding FROM listing l
JOIN embeddings e ON l.listing_id % (SELECT count(*) FROM embeddings) = e.vec_id)""",
    "zone": """zone AS (
SELECT n_nationkey::BIGINT AS zona_id, n_name AS nombre, n_nationkey < 15 AS es_oficial,
  CASE WHEN n_nationkey >= 15 AND n_nationkey < 24 THEN primera END AS hereda_de,
  n_nationkey = 24 AS sin_score, n_nationkey = 3 AS oculta, 4.0::DOUBLE + n_nationkey % 7 * 3.5::DOUBLE AS superficie_km2
FROM nation JOIN (SELECT n_regionkey AS rk, min_by(n_name, n_nationkey) AS primera FROM nation GROUP BY 1) ON n_regionkey = rk)""",
    "customer_stats": """customer_stats AS (
SELECT z.nombre, coalesce(p.n, 0) AS poblacion, coalesce(e.n, 0) AS incidentes, z.superficie_km2, z.es_oficial
FROM zone z LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) p ON z.zona_id = p.k
LEFT JOIN (SELECT user_id % 25 AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e ON z.zona_id = e.k)""",
    "poi": """poi AS (
SELECT s_suppkey * 2 AS id, s_suppkey AS clave, s_name AS nombre, 'google_places' AS fuente,
  ['supermercado','farmacia','hospital','clinica','parque','colegio'][(s_suppkey % 6 + 1)::INT] AS categoria,
  8.9::DOUBLE + (s_suppkey * 37 % 1000) / 5000::DOUBLE AS lat, -79.6::DOUBLE + (s_suppkey * 91 % 1000) / 5000::DOUBLE AS lng,
  'NATION_' || (s_nationkey % 5) AS zona_etiquetada_origen,
  CASE WHEN s_suppkey % 4 <> 0 THEN round(1 + s_suppkey % 40 / 10::DOUBLE, 1) END AS rating FROM supplier
UNION ALL
SELECT p_partkey * 2 + 1, p_partkey, p_name, 'osm_overpass',
  ['supermercado','farmacia','hospital','clinica','parque','colegio'][(p_partkey % 6 + 1)::INT],
  8.9::DOUBLE + (p_partkey * 37 % 1000) / 5000::DOUBLE, -79.6::DOUBLE + (p_partkey * 91 % 1000) / 5000::DOUBLE,
  'NATION_' || (p_size % 5), CASE WHEN p_partkey % 4 <> 0 THEN round(1 + p_partkey % 40 / 10::DOUBLE, 1) END FROM part)""",
    "stop": """stop AS (
SELECT c_custkey AS id, 8.88::DOUBLE + (c_custkey * 53 % 1201) / 5000::DOUBLE AS lat,
  -79.62::DOUBLE + (c_custkey * 71 % 1201) / 5000::DOUBLE AS lng,
  CASE WHEN c_custkey % 10 = 0 THEN 'metro' ELSE 'bus' END AS tipo FROM customer)""",
    "query_log": """query_log AS (
SELECT conv_id * 1000 + turn AS consulta_id, text AS consulta FROM conversations WHERE role = 'user')""",
    "profile": _profiles(),
    "edge": _edges(),
    "poi_zone": "poi_zone AS (SELECT p.*, a.corregimiento_asignado FROM poi p LEFT JOIN ("
    + contain_sql("poi") + ") a USING (id))",
    "stop_zone": "stop_zone AS (SELECT p.*, a.corregimiento_asignado FROM stop p LEFT JOIN ("
    + contain_sql("stop") + ") a USING (id))",
    "pool": """pool AS (SELECT *, ('0x' || substr(md5(listing_id || '_42'), 1, 8))::BIGINT % 100 AS cubo,
  ('0x' || substr(md5(listing_id || '_42k'), 1, 8))::BIGINT % 5 AS pliegue FROM listing
WHERE corregimiento <> 'zona_no_determinada' AND NOT precio_no_evaluable
  AND corregimiento NOT IN ('NATION_7', 'NATION_8') AND tipo_inmueble = 'BUILDING' AND area_m2 IS NOT NULL
  AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL)""",
    "train": "train AS (SELECT * FROM pool WHERE cubo < 80)",
    "scale": """scale AS (SELECT 1 / var_pop(bedrooms::DOUBLE) AS wb, 1 / var_pop(bathrooms::DOUBLE) AS wt, 1 / var_pop(area_m2) AS wa FROM train)""",
    "comparable": """comparable AS (SELECT listing_id, real, corregimiento, cubo, rank, vecino_id, vecino_precio, distancia FROM (
  SELECT q.listing_id, q.price_usd AS real, q.corregimiento, q.cubo, t.listing_id AS vecino_id, t.price_usd AS vecino_precio,
    sqrt(d2) AS distancia, row_number() OVER (PARTITION BY q.listing_id ORDER BY d2, t.listing_id) AS rank
  FROM pool q, train t, scale s,
    LATERAL (SELECT wb * (q.bedrooms - t.bedrooms) * (q.bedrooms - t.bedrooms)
      + wt * (q.bathrooms - t.bathrooms) * (q.bathrooms - t.bathrooms)
      + wa * (q.area_m2 - t.area_m2) * (q.area_m2 - t.area_m2)
      + CASE WHEN q.corregimiento = t.corregimiento THEN 0.0 ELSE 2.0 END AS d2)
  WHERE t.listing_id <> q.listing_id) WHERE rank <= 5)""",
    "estimate": """estimate AS (SELECT listing_id, any_value(corregimiento) AS corregimiento, any_value(real) AS precio_real, any_value(cubo) AS cubo,
  avg(vecino_precio) AS precio_predicho, count(*) AS n_comparables FROM comparable GROUP BY listing_id)""",
}


def sql(body: str) -> str:
    """Prefix a SELECT with the views it names, in dependency order."""
    order = list(VIEWS)
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"(?<![\w.'])({name})(?![\w'])", text):
                head = VIEWS[name]
                if head == text:
                    continue
                needed.add(name)
                add(head[head.index(" AS (") + 5:])

    add(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(VIEWS[n] for n in order if n in needed) + "\n" + body
