from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from predia import constants as K
from predia.functions import geo as G, intent as I, pricing as P, quality as Q, text as T
from predia.plans import orchestration as O, zone_health as Z


def one(spark, column, **values):
    """Value of a column over one literal row."""
    row = spark.range(1).select(*[v if not isinstance(v, (str, int, float)) else F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,number", [
    ("$250,000", 250000), ("1.5", 15), ("$1,000.50", 100050), ("120 m2", 120), ("sin precio", None), ("", None),
])
def test_number_in_text(spark, text, number):
    assert one(spark, T.number_in_text("t"), t=text) == number


def test_listing_id(spark):
    assert one(spark, T.listing_id_from_url("u"), u="https://x/ph-uno_p-139532.htm") == "139532"
    assert one(spark, T.listing_id_from_url("u"), u="https://x/otro") == ""


def test_operation_and_excluded(spark):
    assert one(spark, T.operation_of("t"), t="Apartamento en ALQUILER") == "alquiler"
    assert one(spark, T.operation_of("t"), t="Apartamento en venta") == "venta"
    assert one(spark, T.is_excluded_type("t"), t="Gran Local Comercial") is True
    assert one(spark, T.is_excluded_type("t"), t="Apartamento amplio") is False


@pytest.mark.parametrize("price,area,operation,reason", [
    (None, 100, "venta", K.REASON_FLOOR), (19999, 100, "venta", K.REASON_FLOOR), (20000, 100, "venta", ""),
    (399, 50, "alquiler", K.REASON_FLOOR), (400, 50, "alquiler", ""), (1500001, 100, "venta", K.REASON_M2),
    (1500000, 100, "venta", ""), (9999999, 100, "alquiler", ""), (9999999, 0, "venta", ""), (9999999, None, "venta", ""),
])
def test_price_validity(spark, price, area, operation, reason):
    df = spark.createDataFrame([(price, area, operation)], "p int, a int, o string")
    assert df.select(P.price_problem("p", "a", "o")).first()[0] == reason


@pytest.mark.parametrize("residual,light", [(150.0, "amarillo"), (150.1, "rojo"), (-150.0, "amarillo"), (-150.1, "verde"), (None, None)])
def test_light_by_mae_is_strict(spark, residual, light):
    df = spark.createDataFrame([(residual,)], "r double")
    assert df.select(P.light_by_mae("r", 1.5, 100.0)).first()[0] == light


@pytest.mark.parametrize("gap,light", [(0.1, "rojo"), (-0.1, "verde"), (0.0999, "amarillo"), (-0.0999, "amarillo")])
def test_light_by_share_is_inclusive(spark, gap, light):
    assert one(spark, P.light_by_share("d"), d=gap) == light


@pytest.mark.parametrize("phone", ["6205-7577", "+507 6205-7577", "+ 507 6205-7577", "+50762057577"])
def test_redaction(spark, phone):
    clean = one(spark, T.redact_contacts("t"), t=f"Llame {phone} o a.b@c.com hoy")
    assert clean == f"Llame {K.REDACTION_MARK} o {K.REDACTION_MARK} hoy"


def test_redaction_keeps_null_and_prices(spark):
    df = spark.createDataFrame([(None,), ("Area 620 m2, precio 250000",)], "t string")
    got = [r[0] for r in df.select(T.redact_contacts("t")).collect()]
    assert got == [None, "Area 620 m2, precio 250000"]


def test_c1_repair(spark):
    assert one(spark, T.repair_c1("t"), t="\u0093hola\u0094 d\u0092or \u0096 x \u0097 y") == "\"hola\" d'or – x — y"


def test_keyword_rule_is_substring(spark):
    rule = T.keyword_rule("t", "s", ["bar"], ["airbnb"])
    assert one(spark, rule, t="Barrio tranquilo", s="completa") is True
    assert one(spark, rule, t="bar y airbnb", s="completa") is False
    assert one(spark, rule, t="bar", s="ninguna") is False
    df = spark.createDataFrame([(None, "completa")], "t string, s string")
    assert df.select(rule).first()[0] is False


def test_quality_json(spark):
    good = '{"completitud_informativa": 5, "calidad_presentacion": 4, "diferenciadores_amenidades": 3, "transparencia_precio": 1}'
    cases = [(f"```json\n{good}\n```", True), (f"Claro: {good}.", True), (good.replace("5", "6"), False), ("{roto", False), ("nada", False), (None, False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in df.select(T.quality_json("t").isNotNull()).collect()]
    assert got == [ok for _, ok in cases]


def test_cluster_label(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "c int")
    assert [r[0] for r in df.select(P.cluster_label("c")).collect()] == [
        "Compacto / económico", "Grande / premium", "Segmento desconocido (cluster_id=7)", K.NO_CLUSTER,
    ]


def test_model_coverage(spark):
    df = spark.createDataFrame([("Betania", "Apartamento"), ("Pedregal", "Casa"), (None, "Casa")], "z string, t string")
    got = [r[0] for r in df.select(P.model_coverage("z", "t")).collect()]
    assert got[0]["cubierto"] is True and got[0]["motivo"] is None
    assert got[1]["cubierto"] is False and got[1]["motivo"].count(";") == 1
    assert got[2]["cubierto"] is None


def test_haversine_one_degree(spark):
    assert one(spark, G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), a=1) == pytest.approx(111194.9266, abs=1e-3)


def shape(*parts):
    return F.array(*[F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r]) for r in p]) for p in parts])


OUTER = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3)]


def test_centroid_area_and_largest_part(spark):
    far = [(10, 10), (11, 10), (11, 11), (10, 11)]
    s = shape([OUTER, HOLE], [far])
    assert one(spark, G.polygon_area(s[0]), a=1) == 12.0
    c = one(spark, G.multipolygon_centroid(shape([OUTER, HOLE])), a=1)
    assert (c["x"], c["y"]) == (2.0, 2.0)
    best = one(spark, G.largest_part(s), a=1)
    assert best["pct_area"] == pytest.approx(100 * 12 / 13) and best["partes_descartadas"] == 1
    b = one(spark, G.bounds(s), a=1)
    assert tuple(b) == (0.0, 0.0, 11.0, 11.0)


@pytest.mark.parametrize("x,y,inside", [(0.5, 0.5, True), (2, 2, False), (4, 2, True), (0, 0, True), (1, 2, True), (5, 2, False), (2, 4.0001, False)])
def test_containment(spark, x, y, inside):
    test = G.edges_contain(G.shape_edges(shape([OUTER, HOLE])), F.lit(float(x)), F.lit(float(y)))
    assert one(spark, test, a=1) is inside


def test_tags_and_provenance(spark):
    tags = F.create_map(F.lit("amenity"), F.lit("clinic"), F.lit("leisure"), F.lit("park"))
    assert one(spark, Z.tag_category(tags), a=1) == "parque"
    clinic = F.create_map(F.lit("amenity"), F.lit("clinic"))
    assert one(spark, Z.tag_category(clinic), a=1) == "clinica"
    assert one(spark, Z.tag_category(clinic, merged=True), a=1) == "salud"
    p = one(spark, Z.provenance(F.lit(""), F.lit("google_places/abc")), a=1)
    assert tuple(p) == ("google_places", "abc")
    assert one(spark, Z.provenance(F.lit(None).cast("string"), F.lit("way/1")), a=1)["fuente"] == "osm_overpass"


def test_rubric_bounds(spark):
    df = spark.createDataFrame([("",), ("Vista, piscina, gimnasio, terraza y parque. 2 baños, 90 m2, $200,000.",), (None,)], "t string")
    got = [r[0] for r in df.select(Q.rubric_scores("t")).collect()]
    assert got[2] is None
    assert all(1 <= v <= 5 for r in got[:2] for v in r)
    assert got[1]["diferenciadores_amenidades"] == 5 and got[1]["transparencia_precio"] == 5


# --- Fixed values: the designed queries and the class each must get ---
DESIGNED = {
    "V1": "Apartamento de 1 habitación en El Cangrejo, menos de $150,000",
    "V2": "Casa en Betania con al menos 3 habitaciones y 2 baños",
    "V3": "Apartamento en Marbella entre $250,000 y $450,000",
    "V4": "Busco un edificio en San Francisco como inversión, presupuesto hasta $1,000,000",
    "V5": "Apartamento de 2 habitaciones en Costa del Este, mínimo 2 baños",
    "V6": "Apartamento en Parque Lefevre, menos de $300,000",
    "V7": "Apartamento en Pedregal de 3 habitaciones",
    "V8": "Apartamento en Obarrio, 1 habitación, menos de $200,000",
    "V9": "Apartamento de 3 habitaciones en Bella Vista entre $400,000 y $700,000",
    "V10": "Apartamento en San Francisco con 2 baños, presupuesto máximo $280,000",
    "F1": "Busco un apartamento en Juan Díaz",
    "F2": "Quiero una casa en San Miguelito, 3 habitaciones",
    "F3": "Busco terreno agrícola en Chiriquí para sembrar",
    "F4": "¿Cuál es el mejor taller mecánico cerca de Bella Vista?",
    "F5": "Quiero comprar un lote industrial cerca del puerto de Colón",
    "AM1": "Algo económico para empezar, no sé bien dónde",
    "AM2": "Busco algo espacioso, con buena vista, en una zona tranquila",
    "AM3": "Necesito una propiedad accesible, no importa el tamaño",
    "AM4": "Quiero invertir en algo con potencial, en Bella Vista o San Francisco, lo que rinda más",
    "AM5": "Apartamento moderno con buenos acabados, presupuesto normal",
}


def test_designed_queries(spark):
    df = O.classify(spark.createDataFrame(list(DESIGNED.items()), "id string, consulta string"))
    got = {r["id"]: r for r in df.collect()}
    for key in DESIGNED:
        expected = (
            "fallback_fuera_tema" if key == "F4" else "exito" if key[0] == "V"
            else "fallback_cobertura" if key[0] == "F" else "fallback_ambiguedad"
        )
        assert got[key]["categoria"] == expected, key
    assert (got["V3"]["precio_min"], got["V3"]["precio_max"]) == (250000, 450000)
    assert got["V4"]["precio_max"] == 1000000 and got["V2"]["habitaciones_min"] == 3 and got["V2"]["banos_min"] == 2
    assert got["F5"]["zona_mencion_texto"] == "Colón"
    assert {r["categoria"]: r["n"] for r in O.outcome_mix(df).collect()} == {
        "exito": 10, "fallback_cobertura": 4, "fallback_fuera_tema": 1, "fallback_ambiguedad": 5,
    }


def test_outcome_cut_is_strict(spark):
    df = spark.createDataFrame([(True, "Betania", None, 0.65), (True, "Betania", None, 0.64), (True, None, "Betania o Marbella", 0.9)],
                               "es_consulta_inmobiliaria boolean, zona string, zona_mencion_texto string, confianza double")
    got = [r[0] for r in df.select(I.outcome(F.struct(*df.columns))).collect()]
    assert got == ["exito", "fallback_ambiguedad", "exito"]
