"""Raw listing tables to one clean, deduplicated catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.functions.pricing import price_problem
from predia.functions.text import (
    count_matches, has_c1, is_excluded_type, listing_id_from_url, number_in_text, operation_of,
    strip_tags,
)
from predia.operators.scale import keep_first

STATES = ["ok", "sin_descripcion", "error_red"]


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def resolve_zone(
    zone_raw: Column,
    title: Column,
    page_label: Column,
    neighbourhoods: dict[str, str] | None = None,
    official: list[str] | None = None,
    buildings: dict[str, str] | None = None,
) -> Column:
    """Struct (zone, zone_source): neighbourhood map, official list, building name, page label."""
    neighbourhoods = K.NEIGHBOURHOOD_ZONE if neighbourhoods is None else neighbourhoods
    official = K.SCOPE_ZONES if official is None else official
    buildings = K.BUILDING_ZONE if buildings is None else buildings
    trimmed = F.trim(F.coalesce(zone_raw, F.lit("")))
    key = F.lower(trimmed)
    by_neighbourhood = _mapping(neighbourhoods)[key] if neighbourhoods else F.lit(None)
    lowered = F.lower(F.coalesce(title, F.lit("")))
    by_building = F.lit(None).cast("string")
    for name, zone in reversed(list(buildings.items())):
        by_building = F.when(F.contains(lowered, F.lit(name)), zone).otherwise(by_building)

    def found(zone: Column, source: str) -> Column:
        return F.struct(zone.alias("zone"), F.lit(source).alias("zone_source"))

    return (
        F.when(by_neighbourhood.isNotNull(), found(by_neighbourhood, "zone_raw_barrio_mapeado"))
        .when(key.isin([z.lower() for z in official]), found(trimmed, "zone_raw"))
        .when(by_building.isNotNull(), found(by_building, "titulo_ph_mapeado"))
        .otherwise(found(page_label, "pagina_scrapeada_no_resuelto"))
    )


def parse_cards(cards: DataFrame, rent_words: list[str] | None = None, **zone_rules) -> DataFrame:
    """Raw card fields (texts) to typed listing records, one select."""
    typed = cards.select(
        "listing_url",
        listing_id_from_url("listing_url").alias("listing_id"),
        "title",
        "zone_raw",
        resolve_zone(F.col("zone_raw"), F.col("title"), F.col("zone_label"), **zone_rules)
        .alias("_zone"),
        "price_raw",
        number_in_text("price_raw").alias("price_usd"),
        number_in_text("bedrooms_raw").alias("bedrooms"),
        number_in_text("bathrooms_raw").alias("bathrooms"),
        number_in_text("area_raw").alias("area_m2"),
        operation_of("title", rent_words).alias("operation"),
        "source",
        "scraped_at",
    )
    problem = price_problem("price_usd", "area_m2", "operation")
    return typed.select(
        "listing_url", "listing_id", "title", "zone_raw", "_zone.zone", "_zone.zone_source",
        "price_raw", "price_usd",
        (problem != "").alias("precio_no_evaluable"),
        problem.alias("precio_no_evaluable_motivo"),
        "bedrooms", "bathrooms", "area_m2", "operation", "source", "scraped_at",
    )


# --- Fixed values: where a detail page keeps its parts ---
CRUMB_LIST = r'(?s)<ol[^>]*class="[^"]*nb-breadcrumb-list[^"]*"[^>]*>(.*?)</ol>'
CRUMB_ITEM = r"(?s)<li[^>]*>(.*?)</li>"
FULL_TEXT = r'(?s)<(\w+)[^>]*class="[^"]*nb-desc-full-content[^"]*"[^>]*>(.*?)</\1>'
PREVIEW_TEXT = r'(?s)<(\w+)[^>]*class="[^"]*nb-desc-preview[^"]*"[^>]*>(.*?)</\1>'
GALLERY = r'(?s)<div\b[^>]*\bib-prop-gallery-main\b.*'
SLIDE = r'(?i)\bclass\s*=\s*["\'][^"\']*\bswiper-slide\b'
IMAGE_SOURCE = r'(?i)\ssrc\s*=\s*["\']([^"\']+)'
CRUMB_MARKS = ["", "›", ">", "&rsaquo;", "&gt;"]


def detail_fields(
    html: Column,
    crumb_list: str = CRUMB_LIST,
    crumb_item: str = CRUMB_ITEM,
    full_text: str = FULL_TEXT,
    full_group: int = 2,
    preview_text: str = PREVIEW_TEXT,
    preview_group: int = 2,
) -> Column:
    """Struct (tipo_inmueble, descripcion, descripcion_fuente, estado) of a detail page.

    The type is the third breadcrumb that is not a separator; the description is the full block,
    else the preview.
    """
    crumbs = F.transform(
        F.regexp_extract_all(F.regexp_extract(html, crumb_list, 1), F.lit(crumb_item), 1),
        lambda c: strip_tags(c, ""),
    )
    crumbs = F.filter(crumbs, lambda c: ~c.isin(CRUMB_MARKS))
    kind = F.coalesce(F.get(crumbs, F.lit(2)), F.lit(""))
    full = strip_tags(F.regexp_extract(html, full_text, full_group))
    preview = strip_tags(F.regexp_extract(html, preview_text, preview_group))
    text = F.when(full != "", full).otherwise(preview)
    source = (
        F.when(full != "", "completa").when(preview != "", "preview").otherwise("ninguna")
    )
    state = (
        F.when((kind != "") & (text != ""), "ok")
        .when((kind == "") & (text == ""), "sin_ambos")
        .when(kind == "", "sin_breadcrumb")
        .otherwise("sin_descripcion")
    )
    return F.struct(
        kind.alias("tipo_inmueble"), text.alias("descripcion"),
        source.alias("descripcion_fuente"), state.alias("estado"),
    )


def normalise_state(state: Column) -> Column:
    """Struct (estado, detalle) within the closed set of states."""
    partial = state.isin("sin_breadcrumb", "sin_ambos")
    return F.struct(
        F.when(partial, "sin_descripcion").otherwise(state).alias("estado"),
        F.when(partial, state).otherwise("").alias("detalle"),
    )


def fetch_state(url: Column, error: Column, parsed: Column) -> Column:
    """State of a whole attempt: no address, network error, or what the page gave."""
    seen = normalise_state(parsed)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.struct(F.lit("sin_url").alias("estado"), F.lit("").alias("detalle")))
        .when(error.isNotNull(), F.struct(F.lit("error_red").alias("estado"), error.alias("detalle")))
        .otherwise(seen)
    )


def _absolute(base: Column):
    """Make an address absolute against the page's."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain.rlike(r"://[^/]+$"), F.concat(plain, F.lit("/"))).otherwise(
        F.regexp_replace(plain, r"[^/]*$", "")
    )

    def join(u):
        return (
            F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), u)
            .when(u.startswith("//"), F.concat(scheme, u))
            .when(u.startswith("/"), F.concat(origin, u))
            .otherwise(F.concat(folder, u))
        )

    return join


def absolute_urls(html: Column, base: Column, pattern: str) -> Column:
    """Addresses matched on a page, in page order, made absolute against the page."""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), _absolute(base))


def gallery_urls(html: Column, base: Column) -> Column:
    """Images of the gallery's slides, in page order, made absolute against the page.

    Opening and closing blocks are counted from the gallery's own tag on, so images after its end or
    outside its slides are left out; a gallery that is never closed ends with the page.
    """
    tags = F.regexp_extract_all(F.regexp_extract(html, GALLERY, 0), F.lit(r"(?i)</?div\b[^>]*>|<img\b[^>]*>"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("slide"), F.lit(False).alias("over"),
                     F.array().cast("array<string>").alias("found"))

    def step(s: Column, tag: Column) -> Column:
        image = tag.rlike("(?i)^<img")
        closing = tag.startswith("</")
        depth = s["depth"] + F.when(image, 0).when(closing, -1).otherwise(1)
        slide = F.when(closing & (depth < s["slide"]), 0).when(
            ~image & ~closing & (s["slide"] == 0) & tag.rlike(SLIDE), depth).otherwise(s["slide"])
        source = F.when(image & ~s["over"] & (s["slide"] > 0), F.nullif(F.regexp_extract(tag, IMAGE_SOURCE, 1), F.lit("")))
        return F.struct(depth.alias("depth"), slide.alias("slide"), (s["over"] | (depth <= 0)).alias("over"),
                        F.concat(s["found"], F.array_compact(F.array(source))).alias("found"))

    return F.transform(F.aggregate(tags, start, step, lambda s: s["found"]), _absolute(base))


def pending_enrichment(rows: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rows lacking a type, a description or images; rows in `done` are left out."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""
    pending = rows.filter(blank("tipo_inmueble") | blank("descripcion") | blank("imagenes"))
    return pending if done is None else pending.join(done, "listing_id", "left_anti")


def dedupe_records(df: DataFrame, order: list[Column]) -> DataFrame:
    """First record per id, else per address, else per title; rows without any are dropped."""
    def filled(c):
        return F.nullif(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(filled("listing_id"), filled("listing_url"), filled("title"))
    keyed = df.withColumn("_key", key).filter(F.col("_key").isNotNull())
    return keep_first(keyed, ["_key"], order).drop("_key")


def dedupe_by_id(df: DataFrame, file_rank: str, row_no: str, key: str = "listing_id") -> DataFrame:
    """Across files: keep the copy of the earliest file, then of the earliest row."""
    return keep_first(df, [key], [F.col(file_rank), F.col(row_no)])


def duplicate_ids(df: DataFrame, key: str = "listing_id", file: str = "corregimiento_archivo") -> DataFrame:
    """Ids with more than one copy: copies, distinct files, and the files as one label."""
    # Distinct (id, file) pairs come first, so the label never grows with the copies.
    per_file = df.groupBy(key, file).agg(F.count("*").alias("_n"))
    return (
        per_file.groupBy(key)
        .agg(
            F.sum("_n").alias("copias"),
            F.count("*").alias("archivos"),
            F.array_join(F.sort_array(F.collect_set(file)), ",").alias("combinacion"),
        )
        .filter("copias > 1")
    )


def duplicate_summary(df: DataFrame, **names) -> DataFrame:
    """Duplicate ids and rows per combination of files, with the within-file flag."""
    return (
        duplicate_ids(df, **names)
        .groupBy("combinacion")
        .agg(
            F.count("*").alias("ids"),
            F.sum("copias").alias("filas"),
            F.count_if(F.col("archivos") == 1).alias("dentro_de_un_archivo"),
            F.count_if(F.col("archivos") > 1).alias("entre_archivos"),
        )
    )


def duplicate_rows_by_file(
    df: DataFrame, key: str = "listing_id", file: str = "corregimiento_archivo"
) -> DataFrame:
    per_file = df.groupBy(key, file).agg(F.count("*").alias("_n"))
    copies = per_file.groupBy(key).agg(F.sum("_n").alias("_copies")).filter("_copies > 1")
    return per_file.join(copies, key).groupBy(file).agg(F.sum("_n").alias("filas_duplicadas"))


def zone_conflicts(df: DataFrame, key: str = "listing_id", zone: str = "zone") -> DataFrame:
    """Duplicated ids with the number of zones their copies name and whether they agree."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("copias"), F.count_distinct(zone).alias("zonas"))
        .filter("copias > 1")
        .withColumn("consistente", F.col("zonas") == 1)
    )


def canonicalise(df: DataFrame, column: str, spelling: dict[str, str]) -> DataFrame:
    return df.replace(spelling, subset=[column])


def apply_overrides(
    df: DataFrame, overrides: DataFrame, key: str = "listing_id", default: str = K.UNKNOWN_ZONE
) -> DataFrame:
    """Overrides (key, zona) win; rows left unresolved by the zone rules get the default."""
    unresolved = F.col("zone_source") == "pagina_scrapeada_no_resuelto"
    joined = df.join(overrides.select(key, F.col("zona").alias("_zona")), key, "left")
    zone = F.coalesce(
        F.col("_zona"), F.when(unresolved, F.lit(default)).otherwise(F.col("corregimiento"))
    )
    return joined.withColumn("corregimiento", zone).drop("_zona")


def resolve_ambiguous(
    df: DataFrame, zones: list[str], buildings: list[str], default: str = K.UNKNOWN_ZONE
) -> DataFrame:
    """Zone of unresolved rows: literal in the title, else by a building other rows place surely.

    Building names are a configured list; each resolved row votes for the buildings its title
    names, and a building counts only if all its votes agree. Adds `metodo`.
    """
    lowered = F.lower(F.coalesce(F.col("title"), F.lit("")))

    def named(values: list[str]) -> Column:
        return F.filter(
            F.array(*[F.lit(v) for v in values]), lambda v: F.contains(lowered, F.lower(v))
        )

    unresolved = F.col("zone_source") == "pagina_scrapeada_no_resuelto"
    tagged = df.withColumn("_zones", named(zones)).withColumn("_buildings", named(buildings))
    votes = (
        tagged.filter(~unresolved)
        .select(F.explode("_buildings").alias("_building"), "corregimiento")
        .groupBy("_building")
        .agg(F.count_distinct("corregimiento").alias("n"), F.min("corregimiento").alias("_voted"))
        .filter("n = 1")
        .select("_building", "_voted")
    )
    # Votes are at most one row per configured building, so they are broadcast; most rows name no
    # building and would otherwise meet in one task. The first building of the list is the row's.
    joined = tagged.withColumn("_building", F.get("_buildings", F.lit(0))).join(
        F.broadcast(votes), "_building", "left"
    )
    literal = F.when(F.size("_zones") == 1, F.col("_zones")[0])
    zone = (
        F.when(~unresolved, F.col("corregimiento"))
        .when(literal.isNotNull(), literal)
        .otherwise(F.coalesce(F.col("_voted"), F.lit(default)))
    )
    method = (
        F.when(~unresolved, "ya_resuelta")
        .when(literal.isNotNull(), "titulo_literal")
        .when(F.col("_voted").isNotNull(), "edificio")
        .otherwise("sin_resolver")
    )
    return (
        joined.withColumn("metodo", method)
        .withColumn("corregimiento", zone)
        .drop("_zones", "_buildings", "_building", "_voted")
    )


def reattach(df: DataFrame, earlier: DataFrame, columns: list[str], order: list[Column], key: str = "listing_id") -> DataFrame:
    """Bring columns of an earlier run back by key, first earlier row per key."""
    lookup = keep_first(earlier.select(key, *columns, *order), [key], order).select(key, *columns)
    return df.join(lookup, key, "left")


def null_profile(df: DataFrame) -> DataFrame:
    """Type, nulls and non-nulls of every column, from one pass."""
    counts = df.agg(
        F.count("*").alias("_all"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    rows = [
        F.struct(
            F.lit(name).alias("columna"), F.lit(kind).alias("tipo"),
            (F.col("_all") - F.col(name)).alias("nulos"), F.col(name).alias("no_nulos"),
        )
        for name, kind in df.dtypes
    ]
    return counts.select(F.inline(F.array(*rows)))


def volume_gap(actual: DataFrame, projected: DataFrame, by: str) -> DataFrame:
    """Percent gap of row counts against a projection; no projection gives null."""
    counted = actual.groupBy(by).agg(F.count("*").alias("registros_reales"))
    gap = (F.col("registros_reales") - F.col("proyectado")) / F.col("proyectado") * 100
    return counted.join(projected, by, "left").withColumn("discrepancia_pct", gap)


def contamination(df: DataFrame, by: str, words: list[str] | None = None) -> DataFrame:
    """Share of raw rows per group whose title names an excluded type."""
    hit = is_excluded_type("title", words).cast("int")
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(hit).alias("excluidas"),
        (F.avg(hit) * 100).alias("pct_contaminacion"),
    )


def clean_nulls(df: DataFrame) -> DataFrame:
    """NaN and blank texts become null in every column."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(name))
    return df.select(*out)


def json_texts(column: str) -> Column:
    """JSON text to array of strings; malformed text gives null."""
    return F.from_json(F.col(column), "array<string>")


def row_text(df: DataFrame, digits: int = 6) -> Column:
    """A row as text that another engine can write too: columns by name, fractions with `digits` decimals,
    times to the microsecond, nested values as JSON; nulls differ from every text."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) >= 1e30), c.cast("string")).otherwise(c.cast(f"decimal(38,{digits})").cast("string"))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))

    kinds = dict(df.dtypes)
    return F.concat_ws("\x1f", *[shown(name, kinds[name]) for name in sorted(df.columns)])


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """(filas, huella) of a table in any order: a digest of its multiset of rows.

    Every row is hashed where it lies; the quarters of the hashes are summed with the row count and
    the sums digested, so copies count, no row is moved and SQL can repeat it.
    """
    h = df.select(F.md5(row_text(df, digits)).alias("h"))
    quarter = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = h.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(quarter(i)), F.lit(0).cast("decimal(30,0)")).alias(f"s{i}") for i in range(4)])
    parts = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")])
    return sums.select(F.col("n").alias("filas"), F.md5(parts).alias("huella"))


def pagination_summary(log: DataFrame, by: str = "archivo") -> DataFrame:
    return log.groupBy(by).agg(
        F.count("*").alias("paginas"),
        F.count_if(F.col("resultado") == "OK").alias("ok"),
        F.count_if(F.col("resultado") != "OK").alias("fallos"),
        F.sum("tarjetas").alias("tarjetas"),
    )


def class_profile(
    pages: DataFrame,
    html: str = "html",
    key: str = "page_id",
    attribute: str = r'<(?:div|article|li)\b[^>]*?class="([^"]+)"[^>]*>([^<]*)',
    top: int = 25,
    low: int = 5,
    high: int = 60,
) -> DataFrame:
    """Most frequent class strings over pages with the length of a sample text.

    Only classes among the `top` most frequent with low..high hits are kept. The sample is the
    text right after the first element of the class on the lowest page.
    """
    names = F.regexp_extract_all(html, F.lit(attribute), 1)
    texts = F.regexp_extract_all(html, F.lit(attribute), 2)
    hits = pages.select(key, F.posexplode(F.arrays_zip(names.alias("c"), texts.alias("t"))))
    return (
        hits.select(
            key, "pos", F.trim("col.c").alias("clase"), F.char_length(F.trim("col.t")).alias("n")
        )
        .filter("clase <> ''")
        .groupBy("clase")
        .agg(
            F.count("*").alias("veces"),
            F.min_by(F.col("n").cast("bigint"), F.struct(key, "pos")).alias("largo_muestra"),
        )
        .orderBy(F.desc("veces"), "clase")
        .limit(top)
        .filter(F.col("veces").between(low, high))
    )


def pii_audit(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per pattern: rows hit, total hits and distinct ids affected."""
    patterns = patterns or {"telefono": K.PHONE_PATTERN, "correo": K.EMAIL_PATTERN}
    # Both default patterns need one literal character; texts without it skip the expression.
    literal = {K.PHONE_PATTERN: "6", K.EMAIL_PATTERN: "@"}

    def hits(pattern: str) -> Column:
        counted = count_matches(text, pattern)
        if pattern not in literal:
            return counted
        return F.when(F.contains(F.col(text), F.lit(literal[pattern])), counted).otherwise(0)

    rows = [F.struct(F.lit(n).alias("patron"), hits(p).alias("hits")) for n, p in patterns.items()]
    return (
        df.select(key, F.inline(F.array(*rows)))
        .groupBy("patron")
        .agg(
            F.count_if(F.col("hits") > 0).alias("filas"),
            F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("hits"),
            F.count_distinct(F.when(F.col("hits") > 0, F.col(key))).alias("ids"),
        )
    )


def defect_counts(df: DataFrame, columns: list[str], test=has_c1) -> DataFrame:
    """Rows with the defect per column, and rows with it in any column."""
    flags = {c: test(c) for c in columns}
    sums = df.agg(
        *[F.count_if(f).alias(c) for c, f in flags.items()],
        F.count_if(reduce(lambda a, b: a | b, flags.values())).alias("cualquiera"),
    )
    rows = [
        F.struct(F.lit(c).alias("columna"), F.col(c).alias("filas"))
        for c in [*columns, "cualquiera"]
    ]
    return sums.select(F.inline(F.array(*rows)))


def copies_filter(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    repeated = df.groupBy(key).count().filter("count > 1").select(key)
    return df.join(repeated, key, "left_semi")


