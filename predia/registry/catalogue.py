"""Catalogue construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from predia.functions import text as T
from predia.functions.pricing import price_problem
from predia.operators import catalogue as C
from predia.operators.pages import page_details
from predia.plans import views as V
from predia.registry import entry
from predia.registry.sql import sql

BUILDINGS = {"4-not": "Torre Cuatro", "2-high": "Torre Dos"}
NEIGHBOURHOODS = {f"nation_{i}": f"NATION_{i % 5}" for i in range(5, 10)}
OFFICIAL = [f"NATION_{i}" for i in range(15)]


@entry("c1_number_parse", """
SELECT l_orderkey, l_linenumber, l_partkey,
  coalesce(TRY_CAST(regexp_extract(regexp_replace('$' || l_extendedprice::VARCHAR || ' USD', '[.,]', '', 'g'), '\\d+') AS BIGINT), -1) AS numero
FROM lineitem""")
def _(spark, d):
    price = F.concat(F.lit("$"), F.col("l_extendedprice").cast("string"), F.lit(" USD"))
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce(T.number_in_text(price), F.lit(-1)).alias("numero")
    )


@entry("c2_listing_id", sql("SELECT listing_url, listing_id::VARCHAR AS id FROM listing"))
def _(spark, d):
    return V.listing(spark, d).select("listing_url", T.listing_id_from_url("listing_url").alias("id"))


@entry("c3_operation", sql("SELECT listing_id, operation FROM listing"))
def _(spark, d):
    return V.listing(spark, d).select("listing_id", T.operation_of("title", V.RENT_WORDS).alias("operation"))


@entry("c4_price_validity", sql("""
SELECT operation, precio_no_evaluable_motivo AS motivo, count(*) AS n, round(sum(price_usd), 2) AS total FROM listing GROUP BY 1, 2"""))
def _(spark, d):
    motivo = price_problem("price_usd", "area_m2", "operation")
    return V.listing(spark, d).groupBy("operation", motivo.alias("motivo")).agg(
        F.count("*").alias("n"), F.round(F.sum("price_usd"), 2).alias("total")
    )


ZONE_SQL = """
CASE WHEN z IN ('nation_5','nation_6','nation_7','nation_8','nation_9') THEN 'NATION_' || (substr(z, 8)::INT % 5)
  WHEN substr(z, 8)::INT < 15 THEN trim(zone_raw)
  WHEN contains(lower(title), '4-not') THEN 'Torre Cuatro' WHEN contains(lower(title), '2-high') THEN 'Torre Dos' ELSE corregimiento_archivo END AS zone,
CASE WHEN z IN ('nation_5','nation_6','nation_7','nation_8','nation_9') THEN 'zone_raw_barrio_mapeado'
  WHEN substr(z, 8)::INT < 15 THEN 'zone_raw'
  WHEN contains(lower(title), '4-not') OR contains(lower(title), '2-high') THEN 'titulo_ph_mapeado' ELSE 'pagina_scrapeada_no_resuelto' END AS zone_source
FROM (SELECT *, 'NATION_' || zona_id || ' ' AS zone_raw, lower('nation_' || zona_id) AS z FROM listing)"""


def _raw_zone():
    return F.concat(F.lit("NATION_"), F.col("zona_id").cast("string"), F.lit(" "))


@entry("c5_zone_resolution", sql("SELECT listing_id, " + ZONE_SQL))
def _(spark, d):
    z = C.resolve_zone(_raw_zone(), F.col("title"), F.col("corregimiento_archivo"), NEIGHBOURHOODS, OFFICIAL, BUILDINGS)
    return V.listing(spark, d).select("listing_id", z.alias("z")).select("listing_id", "z.zone", "z.zone_source")


def cards(spark, d):
    """Listings back as the raw texts of a result card."""
    return V.listing(spark, d).select(
        "listing_url", "title", _raw_zone().alias("zone_raw"), F.col("corregimiento_archivo").alias("zone_label"),
        F.concat(F.lit("$"), F.format_number("price_usd", 0)).alias("price_raw"),
        F.concat(F.col("bedrooms").cast("string"), F.lit(" camas")).alias("bedrooms_raw"),
        F.concat(F.col("bathrooms").cast("string"), F.lit(" baños")).alias("bathrooms_raw"),
        F.concat(F.col("area_m2").cast("bigint").cast("string"), F.lit(" m2")).alias("area_raw"),
        F.lit("tabla").alias("source"), "scraped_at",
    )


def parsed(spark, d):
    return C.parse_cards(
        cards(spark, d), V.RENT_WORDS, neighbourhoods=NEIGHBOURHOODS, official=OFFICIAL, buildings=BUILDINGS
    )


# The card price rounds half to even, so prices that end in .5 follow that rule in the SQL too.
@entry("c6_card_records", sql("""
SELECT listing_id::VARCHAR AS listing_id, coalesce(bedrooms, -1) AS bedrooms, bathrooms, coalesce(area_m2, -1)::BIGINT AS area_m2,
  price_usd, operation, zone, zone_source, CASE
  WHEN price_usd < CASE WHEN operation = 'venta' THEN 20000 ELSE 400 END THEN 'precio_bajo_umbral'
  WHEN operation = 'venta' AND area_m2 > 0 AND NOT (price_usd::DOUBLE / area_m2 BETWEEN 100 AND 15000) THEN 'precio_m2_fuera_de_rango' ELSE '' END AS motivo
FROM (SELECT listing_id, bedrooms, bathrooms, area_m2, operation, round_even(price_usd, 0)::BIGINT AS price_usd, """ + ZONE_SQL + ")"))
def _(spark, d):
    return parsed(spark, d).select(
        "listing_id", F.coalesce("bedrooms", F.lit(-1)).alias("bedrooms"), "bathrooms",
        F.coalesce("area_m2", F.lit(-1)).alias("area_m2"), "price_usd", "operation", "zone", "zone_source",
        F.col("precio_no_evaluable_motivo").alias("motivo"),
    )


# On these pages the menu plays the breadcrumb and the article the full description.
PAGE_RULES = {
    "crumb_list": r"(?s)<nav>(.*?)</nav>", "crumb_item": r"(?s)<li>(.*?)</li>",
    "full_text": r"(?s)<article>(.*?)</article>", "full_group": 1,
    "preview_text": r"(?s)<title>(.*?)</title>", "preview_group": 1,
}
TIDY = r"""array_to_string(list_filter(list_transform(string_split_regex({0}, '<[^>]*>'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), '{1}')"""
DETAIL_SQL = f"""SELECT page_id, url, kind AS tipo_inmueble, CASE WHEN f <> '' THEN f ELSE p END AS descripcion,
  CASE WHEN f <> '' THEN 'completa' WHEN p <> '' THEN 'preview' ELSE 'ninguna' END AS descripcion_fuente,
  CASE WHEN kind <> '' AND (f <> '' OR p <> '') THEN 'ok' WHEN kind = '' AND f = '' AND p = '' THEN 'sin_ambos'
    WHEN kind = '' THEN 'sin_breadcrumb' ELSE 'sin_descripcion' END AS estado
FROM (SELECT page_id, url, coalesce(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1),
    lambda c: {TIDY.format('c', '')}), lambda c: c NOT IN ('', '›', '>', '&rsaquo;', '&gt;'))[3], '') AS kind,
  {TIDY.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)", ' ')} AS f,
  {TIDY.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", ' ')} AS p FROM pages)"""


def details(spark, d):
    return V.table(spark, d, "pages").select("page_id", "url", "html", C.detail_fields(F.col("html"), **PAGE_RULES).alias("x"))


@entry("c7_page_detail", f"SELECT page_id, tipo_inmueble, md5(descripcion) AS descripcion_md5, descripcion_fuente, estado FROM ({DETAIL_SQL})")
def _(spark, d):
    return details(spark, d).select(
        "page_id", "x.tipo_inmueble", F.md5("x.descripcion").alias("descripcion_md5"), "x.descripcion_fuente", "x.estado"
    )


#: What the pages are wrapped in by key: plain, nested, unclosed, with references, or without a region.
ODD_PAGES = [
    ('<ol class="nb-breadcrumb-list"><li>Inicio</li><li>Venta</li><li>Casas</li></ol><div class="nb-desc-full-content">{0}</div>', "Casas", "{0}", "completa", "ok"),
    ('<ol class="nb-breadcrumb-list"><li>a</li><li>b</li><li><a>Locales</a></li></ol><div class="nb-desc-full-content"><div>{0}</div><div>fin &amp; mas</div></div><p>fuera', "Locales", "{0} fin & mas", "completa", "ok"),
    ('<ol class="nb-breadcrumb-list"><li>a</li><li>b</li><li>Terrenos</li></ol><div class="nb-desc-preview"><p>{0}', "Terrenos", "{0}", "preview", "ok"),
    ('<div class="nb-desc-full-content"><section><div>{0}</div></section></div>', "", "{0}", "completa", "sin_breadcrumb"),
    ('<ol class="nb-breadcrumb-list"><li>a</li><li>b</li><li>Casas</li></ol><div class="nb-desc-full-content"><script>{0}</script></div>', "Casas", "", "ninguna", "sin_descripcion"),
    ('<ol class="nb-breadcrumb-list"><li>Inicio<li>{0}', "", "", "ninguna", "sin_ambos"),
]


def _odd(column: int) -> str:
    return f"[{', '.join(repr(p[column]) for p in ODD_PAGES)}][(page_id % {len(ODD_PAGES)} + 1)::INT]"


@entry("c7_odd_pages", f"""
SELECT page_id, {_odd(1)} AS tipo_inmueble, replace({_odd(2)}, '{{0}}', 'texto ' || page_id || ' ' || length(url)) AS descripcion,
  {_odd(3)} AS descripcion_fuente, {_odd(4)} AS estado FROM pages""")
def _(spark, d):
    """Pages whose blocks nest, stay unclosed, hold references or are missing, through the parser where patterns cannot read them."""
    html = F.get(F.array(*[F.lit(p[0]) for p in ODD_PAGES]), (F.col("page_id") % len(ODD_PAGES)).cast("int"))
    inner = F.concat(F.lit("texto "), F.col("page_id").cast("string"), F.lit(" "), F.char_length("url").cast("string"))
    pages = V.table(spark, d, "pages").select("page_id", F.replace(html, F.lit("{0}"), inner).alias("html"))
    return page_details(pages, "page_id").select("page_id", "tipo_inmueble", "descripcion", "descripcion_fuente", "estado")


STATE_SQL = """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'sin_url' WHEN page_id % 7 = 0 THEN 'error_red'
  WHEN e IN ('sin_breadcrumb', 'sin_ambos') THEN 'sin_descripcion' ELSE e END AS estado,
  CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 7 = 0 THEN 'Timeout' WHEN e IN ('sin_breadcrumb', 'sin_ambos') THEN e ELSE '' END AS detalle
FROM (SELECT page_id, ['ok', 'sin_breadcrumb', 'sin_ambos', 'sin_descripcion'][(page_id % 4 + 1)::INT] AS e FROM pages)"""


@entry("c8_state_normalised", STATE_SQL)
def _(spark, d):
    states = F.array(*[F.lit(s) for s in ("ok", "sin_breadcrumb", "sin_ambos", "sin_descripcion")])
    k = F.col("page_id")
    state = C.fetch_state(
        F.when(k % 11 != 0, F.col("url")), F.when(k % 7 == 0, "Timeout"), F.get(states, (k % 4).cast("int"))
    )
    return V.table(spark, d, "pages").select("page_id", state.alias("s")).select("page_id", "s.*")


# The pages hold links, and images are put in by key: a gallery of two slides, others outside it.
@entry("c9_gallery_images", r"""
SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || '/f' || page_id || '_' || pos || '.jpg' AS imagen
FROM pages, (SELECT unnest([0, 1])::BIGINT AS pos)""")
def _(spark, d):
    key = F.col("page_id").cast("string")
    block = F.concat(
        F.lit('<img src="/antes.jpg"><div class="x ib-prop-gallery-main y"><img src="/fuera.jpg"><div class="a swiper-slide"><div><img alt="" src="/f'),
        key, F.lit("_0.jpg\"></div></div><div class='swiper-slide'><img src='/f"), key,
        F.lit("_1.jpg'></div></div><div class=\"pie\"><div class=\"swiper-slide\"><img src=\"/logo.png\"></div></div>"),
    )
    images = C.gallery_urls(F.concat(F.col("html"), block), F.col("url"))
    return V.table(spark, d, "pages").select("page_id", F.posexplode(images)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("imagen")
    )


@entry("c9_absolute_links", r"""
SELECT page_id, (i - 1)::BIGINT AS pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || u AS enlace
FROM (SELECT page_id, url, unnest(h) AS u, generate_subscripts(h, 1) AS i
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*?\shref="([^"]+)"', 1) AS h FROM pages))""")
def _(spark, d):
    links = C.absolute_urls(F.col("html"), F.col("url"), r'<a[^>]*?\shref="([^"]+)"')
    return V.table(spark, d, "pages").select("page_id", F.posexplode(links)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("enlace")
    )


@entry("c10_pending_enrichment", """
SELECT doc_id AS listing_id FROM documents WHERE (doc_id % 5 = 0 OR doc_id % 3 = 0 OR text IS NULL OR text = '')
  AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, d):
    k = F.col("doc_id")
    rows = V.table(spark, d, "documents").select(
        k.alias("listing_id"), F.when(k % 5 != 0, F.col("lang")).alias("tipo_inmueble"),
        F.col("text").alias("descripcion"), F.when(k % 3 == 0, "").otherwise("[]").alias("imagenes"),
    )
    done = V.table(spark, d, "labels").select(k.alias("listing_id"))
    return C.pending_enrichment(rows, done).select("listing_id")


def copies(spark, d):
    """Listings captured from several pages: a key is caught again in later files."""
    df = V.listing(spark, d).select(
        (F.col("listing_id") % 1000).alias("listing_id"), "listing_url", "title", "corregimiento_archivo",
        F.col("zona_id").alias("file_rank"), F.col("listing_id").alias("row_no"), F.col("corregimiento").alias("zone"),
    )
    return df


COPIES = """copia AS (SELECT listing_id % 1000 AS listing_id, listing_url, title, corregimiento_archivo, zona_id AS file_rank,
  listing_id AS row_no, corregimiento AS zone FROM listing)"""


def copies_sql(body: str) -> str:
    head = sql("SELECT 1 FROM listing")
    return head[: head.rindex("\n")] + ",\n" + COPIES + "\n" + body


@entry("c11_dedupe_fallback_key", copies_sql("""
SELECT clave, min(row_no) AS row_no, min_by(title, row_no) AS title FROM (
  SELECT *, CASE WHEN listing_id % 3 = 0 THEN listing_url WHEN listing_id % 3 = 1 THEN title ELSE listing_id::VARCHAR END AS clave FROM copia) GROUP BY 1"""))
def _(spark, d):
    k = F.col("listing_id")
    df = copies(spark, d).select(
        F.when(k % 3 == 2, k.cast("string")).otherwise("").alias("listing_id"),
        F.when(k % 3 == 1, None).otherwise(F.col("listing_url")).alias("listing_url"), "title", "row_no",
    )
    kept = C.dedupe_records(df, [F.col("row_no")])
    key = F.coalesce(F.nullif("listing_id", F.lit("")), "listing_url", "title")
    return kept.select(key.alias("clave"), "row_no", "title")


@entry("c12_dedupe_across_files", copies_sql("""
SELECT listing_id, file_rank, row_no, title, zone FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY file_rank, row_no) AS r FROM copia) WHERE r = 1"""))
def _(spark, d):
    return C.dedupe_by_id(copies(spark, d), "file_rank", "row_no").select("listing_id", "file_rank", "row_no", "title", "zone")


@entry("c13_duplicate_diagnosis", copies_sql("""
SELECT combinacion, count(*) AS ids, sum(copias)::BIGINT AS filas, count(*) FILTER (WHERE archivos = 1) AS dentro_de_un_archivo,
  count(*) FILTER (WHERE archivos > 1) AS entre_archivos FROM (
  SELECT listing_id, count(*) AS copias, count(DISTINCT corregimiento_archivo) AS archivos,
    array_to_string(list_sort(list_distinct(list(corregimiento_archivo))), ',') AS combinacion
  FROM copia GROUP BY 1 HAVING count(*) > 1) GROUP BY 1"""))
def _(spark, d):
    return C.duplicate_summary(copies(spark, d))


@entry("c13_duplicate_rows_by_file", copies_sql("""
SELECT corregimiento_archivo, count(*) AS filas_duplicadas FROM copia
WHERE listing_id IN (SELECT listing_id FROM copia GROUP BY 1 HAVING count(*) > 1) GROUP BY 1"""))
def _(spark, d):
    return C.duplicate_rows_by_file(copies(spark, d))


@entry("c14_zone_conflicts", copies_sql("""
SELECT listing_id, count(*) AS copias, count(DISTINCT zone) AS zonas, count(DISTINCT zone) = 1 AS consistente
FROM copia GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    return C.zone_conflicts(copies(spark, d))


@entry("c15_canonical_values", sql("""
SELECT CASE corregimiento WHEN 'NATION_1' THEN 'Nation Uno' WHEN 'NATION_2' THEN 'Nation Dos' ELSE corregimiento END AS corregimiento, count(*) AS n FROM listing GROUP BY 1"""))
def _(spark, d):
    df = C.canonicalise(V.listing(spark, d), "corregimiento", {"NATION_1": "Nation Uno", "NATION_2": "Nation Dos"})
    return df.groupBy("corregimiento").agg(F.count("*").alias("n"))


def unresolved(spark, d):
    """Listings of region AFRICA count as unresolved."""
    source = F.when(F.col("corregimiento_archivo") == "AFRICA", "pagina_scrapeada_no_resuelto").otherwise("zone_raw")
    return V.listing(spark, d).select("listing_id", "title", "corregimiento", source.alias("zone_source"))


@entry("c16_overrides", sql("""
SELECT l.listing_id, coalesce(n_name, CASE WHEN corregimiento_archivo = 'AFRICA' THEN 'zona_no_determinada' ELSE corregimiento END) AS corregimiento
FROM listing l LEFT JOIN (SELECT doc_id, n_name FROM labels JOIN nation ON doc_id % 25 = n_nationkey) o ON l.listing_id = o.doc_id"""))
def _(spark, d):
    labels = V.table(spark, d, "labels").join(V.table(spark, d, "nation"), F.col("doc_id") % 25 == F.col("n_nationkey"))
    overrides = labels.select(F.col("doc_id").alias("listing_id"), F.col("n_name").alias("zona"))
    return C.apply_overrides(unresolved(spark, d), overrides).select("listing_id", "corregimiento")


@entry("c17_ambiguous_zones", sql("""
, t AS (SELECT listing_id, corregimiento, corregimiento_archivo = 'AFRICA' AS u, CASE WHEN corregimiento_archivo = 'AFRICA' THEN replace(title, 'NATION_10', 'N10') ELSE title END AS t FROM listing),
x AS (SELECT *, [z FOR z IN ['NATION_0', 'NATION_5'] IF contains(lower(t), lower(z))] AS zs,
  [b FOR b IN ['4-NOT SPECIFIED AUTOMOBILE NATION_1', 'MACHINERY N'] IF contains(lower(t), lower(b))][1] AS b FROM t),
v AS (SELECT b, min(corregimiento) AS z FROM (SELECT corregimiento, unnest([b FOR b IN ['4-NOT SPECIFIED AUTOMOBILE NATION_1', 'MACHINERY N'] IF contains(lower(t), lower(b))]) AS b FROM x WHERE NOT u) GROUP BY 1 HAVING count(DISTINCT corregimiento) = 1)
SELECT listing_id, CASE WHEN NOT u THEN corregimiento WHEN len(zs) = 1 THEN zs[1] ELSE coalesce(v.z, 'zona_no_determinada') END AS corregimiento,
  CASE WHEN NOT u THEN 'ya_resuelta' WHEN len(zs) = 1 THEN 'titulo_literal' WHEN v.z IS NOT NULL THEN 'edificio' ELSE 'sin_resolver' END AS metodo
FROM x LEFT JOIN v ON x.b = v.b""").replace("\n\n, t AS", ",\nt AS"))
def _(spark, d):
    df = unresolved(spark, d)
    hidden = F.when(
        F.col("zone_source") == "pagina_scrapeada_no_resuelto", F.replace("title", F.lit("NATION_10"), F.lit("N10"))
    ).otherwise(F.col("title"))
    found = C.resolve_ambiguous(
        df.withColumn("title", hidden), ["NATION_0", "NATION_5"],
        ["4-NOT SPECIFIED AUTOMOBILE NATION_1", "MACHINERY N"],
    )
    return found.select("listing_id", "corregimiento", "metodo")


@entry("c18_reattach", sql("""
SELECT l.listing_id, coalesce(e.quality, -1) AS quality FROM listing l LEFT JOIN (
  SELECT doc_id % 100 AS k, min_by(quality, doc_id) AS quality FROM labels GROUP BY 1) e ON l.listing_id = e.k"""))
def _(spark, d):
    earlier = V.table(spark, d, "labels").select((F.col("doc_id") % 100).alias("listing_id"), "quality", "doc_id")
    joined = C.reattach(V.listing(spark, d).select("listing_id"), earlier, ["quality"], [F.col("doc_id")])
    return joined.select("listing_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@entry("c19_null_profile", sql("""
SELECT columna, n - k AS nulos, k AS no_nulos FROM (SELECT count(*) AS n, count(bedrooms) AS b, count(area_m2) AS a, count(price_usd) AS p FROM listing),
  LATERAL (SELECT unnest(['bedrooms', 'area_m2', 'price_usd']) AS columna, unnest([b, a, p]) AS k)"""))
def _(spark, d):
    df = V.listing(spark, d).select("bedrooms", "area_m2", "price_usd")
    return C.null_profile(df).select("columna", "nulos", "no_nulos")


@entry("c20_volume_gap", sql("""
SELECT corregimiento, count(*) AS registros_reales, coalesce(any_value(p), -1) AS proyectado,
  round(coalesce((count(*) - any_value(p)) / any_value(p)::DOUBLE * 100, -999), 6) AS discrepancia_pct
FROM listing LEFT JOIN (SELECT n_name, 100 + n_nationkey::BIGINT * 40 AS p FROM nation WHERE n_nationkey < 20) ON n_name = corregimiento GROUP BY 1"""))
def _(spark, d):
    projected = V.table(spark, d, "nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("corregimiento"), (100 + F.col("n_nationkey").cast("bigint") * 40).alias("proyectado")
    )
    return C.volume_gap(V.listing(spark, d), projected, "corregimiento").select(
        "corregimiento", "registros_reales", F.coalesce("proyectado", F.lit(-1)).alias("proyectado"),
        F.round(F.coalesce("discrepancia_pct", F.lit(-999.0)), 6).alias("discrepancia_pct"),
    )


@entry("c21_contamination", sql("""
SELECT corregimiento_archivo, count(*) AS n, count(*) FILTER (WHERE h) AS excluidas, round(avg(h::INT) * 100, 6) AS pct_contaminacion
FROM (SELECT corregimiento_archivo, contains(lower(title), 'machinery') OR contains(lower(title), '1-urgent') AS h FROM listing) GROUP BY 1"""))
def _(spark, d):
    return C.contamination(V.listing(spark, d), "corregimiento_archivo", V.EXCLUDED_WORDS).withColumn(
        "pct_contaminacion", F.round("pct_contaminacion", 6)
    )


@entry("c22_null_cleanup", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN '?' ELSE event_type END AS event_type,
  CASE WHEN event_id % 6 = 0 THEN -1 ELSE 2 END::INT AS n_fotos FROM events""")
def _(spark, d):
    k = F.col("event_id")
    raw = V.table(spark, d, "events").select(
        "event_id", F.when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(k % 4 == 0, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 6 == 0, "[broken").otherwise(F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).alias("imagenes"),
    )
    clean = C.clean_nulls(raw).withColumn("fotos", C.json_texts("imagenes"))
    return clean.select(
        "event_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("event_type", F.lit("?")).alias("event_type"),
        F.coalesce(F.size("fotos"), F.lit(-1)).alias("n_fotos"),
    )


def _shown(column: str) -> str:
    return f"coalesce('=' || {column}, '-')"


_ORDER_TEXT = " || chr(31) || ".join(_shown(c) for c in (
    "o_custkey::VARCHAR", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderkey::VARCHAR", "o_orderpriority", "o_orderstatus",
    "o_totalprice::DECIMAL(38,6)::VARCHAR"))
_QUARTERS = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(4))


@entry("c23_fingerprint", f"""
SELECT count(*) AS filas, md5(concat_ws(':', count(*)::VARCHAR, {_QUARTERS})) AS huella FROM (SELECT md5({_ORDER_TEXT}) AS h FROM orders)""")
def _(spark, d):
    return C.fingerprint(V.table(spark, d, "orders"))


@entry("c24_pagination_summary", """
SELECT l_returnflag || '_' || l_linestatus AS archivo, count(*) AS paginas, count(*) FILTER (WHERE l_quantity > 5) AS ok,
  count(*) FILTER (WHERE l_quantity <= 5) AS fallos, sum(l_quantity::BIGINT)::BIGINT AS tarjetas FROM lineitem GROUP BY 1""")
def _(spark, d):
    log = V.table(spark, d, "lineitem").select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("archivo"),
        F.when(F.col("l_quantity") > 5, "OK").otherwise("FALLO").alias("resultado"),
        F.col("l_quantity").cast("bigint").alias("tarjetas"),
    )
    return C.pagination_summary(log)


@entry("c25_class_profile", r"""
SELECT clase, veces, largo_muestra FROM (SELECT trim(c) AS clase, count(*) AS veces, min_by(length(trim(t))::BIGINT, (page_id, i)) AS largo_muestra FROM (
  SELECT page_id, unnest(cs) AS c, unnest(ts) AS t, generate_subscripts(cs, 1) AS i FROM (SELECT page_id,
    regexp_extract_all(html, '<([a-z0-9]+)\b[^>]*>([^<]*)', 1) AS cs, regexp_extract_all(html, '<([a-z0-9]+)\b[^>]*>([^<]*)', 2) AS ts FROM pages))
  WHERE trim(c) <> '' GROUP BY 1 ORDER BY veces DESC, clase LIMIT 25) WHERE veces BETWEEN 5 AND 2600""")
def _(spark, d):
    # These pages have one class only, so tag names are profiled the same way.
    return C.class_profile(V.table(spark, d, "pages"), attribute=r"<([a-z0-9]+)\b[^>]*>([^<]*)", high=2600)


@entry("c26_pii_audit", r"""
SELECT patron, count(*) FILTER (WHERE h > 0) AS filas, sum(h)::BIGINT AS hits, count(DISTINCT CASE WHEN h > 0 THEN doc_id END) AS ids FROM (
  SELECT doc_id, 'telefono' AS patron, len(regexp_extract_all(text, '(\+?\s?507[\s.-]?)?6\d{3}[\s.-]?\d{4}\b')) AS h FROM documents
  UNION ALL SELECT doc_id, 'correo', len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) FROM documents) GROUP BY 1""")
def _(spark, d):
    return C.pii_audit(V.table(spark, d, "documents"), "doc_id", "text")


@entry("c27_defect_counts", """
SELECT columna, n AS filas FROM (SELECT count(*) FILTER (WHERE contains(text, '!!')) AS a, count(*) FILTER (WHERE contains(source, '1')) AS b,
  count(*) FILTER (WHERE contains(text, '!!') OR contains(source, '1')) AS c FROM documents),
  LATERAL (SELECT unnest(['text', 'source', 'cualquiera']) AS columna, unnest([a, b, c]) AS n)""")
def _(spark, d):
    # Documents hold no control characters; a mark is put where '!!' or '1' stands.
    docs = V.table(spark, d, "documents").select(
        F.replace("text", F.lit("!!"), F.lit("\u0092")).alias("text"), F.replace("source", F.lit("1"), F.lit("\u0096")).alias("source")
    )
    return C.defect_counts(docs, ["text", "source"])


@entry("c28_carry_labels_down", """
SELECT hoja, fila, coalesce(last_value(etiqueta IGNORE NULLS) OVER (PARTITION BY hoja ORDER BY fila), '-') AS etiqueta FROM (
  SELECT user_id % 3 AS hoja, event_id AS fila, CASE WHEN event_id % 17 = 0 THEN event_type || '_' || event_id END AS etiqueta FROM events)""")
def _(spark, d):
    from predia.operators.scale import carry_forward

    k = F.col("event_id")
    sheet = V.table(spark, d, "events").select(
        (F.col("user_id") % 3).alias("hoja"), k.alias("fila"),
        F.when(k % 17 == 0, F.concat_ws("_", "event_type", k.cast("string"))).alias("etiqueta"),
    )
    filled = carry_forward(sheet, ["hoja"], "fila", ["etiqueta"], block_rows=1000)
    return filled.select("hoja", "fila", F.coalesce("etiqueta", F.lit("-")).alias("etiqueta"))
