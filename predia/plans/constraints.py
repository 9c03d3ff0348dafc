"""The tables' own rules: closed sets, ranges, required columns, keys and references, as one report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from predia import constants as K
from predia.operators import gates as G


@dataclass(frozen=True)
class Rules:
    """What the rows of a table must meet. `references` maps a column to (table, its key)."""

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    sets: dict[str, tuple] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    one_of: tuple[str, ...] = ()


SCORES = ("completitud_informativa", "calidad_presentacion", "diferenciadores_amenidades", "transparencia_precio")
# The closed sets, ranges and references of the stored tables.
TABLES: dict[str, Rules] = {
    "propiedades": Rules(
        key=("listing_id",), unique=(("listing_url",),),
        required=("listing_url", "title", "zone_raw", "corregimiento", "zone_source", "price_raw", "price_usd", "precio_no_evaluable", "operation",
                  "source", "scraped_at", "corregimiento_archivo", "tipo_inmueble", "descripcion_fuente", "enriquecimiento_estado"),
        sets={
            "zone_source": ("zone_raw", "zone_raw_barrio_mapeado", "titulo_ph_mapeado", "pagina_scrapeada_no_resuelto"),
            "operation": ("venta", "alquiler"),
            "tipo_inmueble": ("Apartamentos", "Casas", "Edificios", "Locales", "Terrenos"),
            "descripcion_fuente": ("completa", "preview", "ninguna"),
            "enriquecimiento_estado": ("ok", "sin_descripcion", "error_red", "sin_url"),
            "corregimiento": (*K.SCOPE_ZONES, K.UNKNOWN_ZONE),
        },
    ),
    "corregimientos": Rules(
        key=("nombre",), required=("es_oficial", "estado_zone_health", "no_visualizado"),
        sets={"estado_zone_health": ("calculado", "sin_score_datos_insuficientes")}, references={"hereda_de": ("corregimientos", "nombre")},
    ),
    "perfiles_lifestyle": Rules(
        key=("perfil",),
        required=("reglas_estructurales", "criterio_cualitativo", "n_solo_estructural", "n_ground_truth", "hash_catalogo_fuente", "fecha_materializacion"),
    ),
    "conjunto_referencia_m1": Rules(
        key=("perfil", "listing_id"), required=("flag_sintetico",), sets={"flag_sintetico": (True,)},
        references={"perfil": ("perfiles_lifestyle", "perfil"), "listing_id": ("propiedades", "listing_id")},
    ),
    "amenidades": Rules(
        key=("id",), required=("categoria", "geom", "geom_tipo_origen", "fuente", "zona_etiquetada_origen", "propiedades_raw"),
        sets={
            "categoria": ("supermercado", "farmacia", "hospital", "clinica", "parque", "colegio"),
            "geom_tipo_origen": ("point", "polygon_centroid"), "fuente": ("google_places", "osm_overpass"),
        },
        references={"corregimiento_asignado": ("corregimientos", "nombre")},
    ),
    "valuacion_quality_scores": Rules(
        key=("listing_id",), required=("modelo", *SCORES), ranges=dict.fromkeys(SCORES, (1, 5)), references={"listing_id": ("propiedades", "listing_id")},
    ),
    "valuacion_semaforo_knn": Rules(
        key=("listing_id",), required=("precio_predicho", "categoria_semaforo", "mae_referencia", "multiplo_mae"),
        sets={"categoria_semaforo": ("verde", "amarillo", "rojo")}, references={"listing_id": ("propiedades", "listing_id")},
    ),
    "valuacion_segmento_kmeans": Rules(
        key=("listing_id",), required=("cluster_id",), sets={"cluster_id": (0, 1)}, references={"listing_id": ("propiedades", "listing_id")},
    ),
    "sesiones_consulta": Rules(
        key=("id",), required=("consulta_texto", "extraccion", "categoria_resultado", "confianza"),
        sets={"categoria_resultado": ("exito", "fallback_fuera_tema", "fallback_cobertura", "fallback_ambiguedad")},
    ),
    "scores_compatibilidad": Rules(
        key=("id",), required=("listing_id", "score_final", "score_estructurado", "score_semantico", "peso_estructurado", "peso_semantico"),
        references={"listing_id": ("propiedades", "listing_id"), "perfil_lifestyle": ("perfiles_lifestyle", "perfil"), "sesion_id": ("sesiones_consulta", "id")},
        one_of=("perfil_lifestyle", "sesion_id"),
    ),
}


def table_report(df: DataFrame, rules: Rules, parents: dict[str, DataFrame]) -> DataFrame:
    """(regla, violaciones) of every rule; a null breaks only rules that require a value.

    Row rules take one pass over the table; keys and references are an aggregate and an anti-join each.
    References to tables that are not given are left out.
    """
    row_rules: dict[str, Column] = {f"requerido:{c}": G.not_null(c) for c in dict.fromkeys((*rules.key, *rules.required))}
    row_rules |= {f"conjunto:{c}": G.in_set(c, list(values)) for c, values in rules.sets.items()}
    row_rules |= {f"rango:{c}": F.col(c).between(*bounds) for c, bounds in rules.ranges.items()}
    if rules.one_of:
        row_rules["uno_de:" + ",".join(rules.one_of)] = G.exactly_one(*rules.one_of)
    reports = [G.check_rules(df, row_rules)]
    reports += [G.unique_key(df.dropna(subset=list(keys)), list(keys)) for keys in (rules.key, *rules.unique)]
    reports += [G.foreign_key(df, c, parents[t], k) for c, (t, k) in rules.references.items() if t in parents]
    return reduce(DataFrame.unionByName, reports)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, regla, violaciones) over all given tables."""
    return reduce(DataFrame.unionByName, [
        table_report(df, TABLES[name], tables).select(F.lit(name).alias("tabla"), "regla", F.col("violaciones").cast("bigint").alias("violaciones"))
        for name, df in tables.items()
    ])
