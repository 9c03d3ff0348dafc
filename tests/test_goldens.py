"""Published values, from literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from predia import constants as K
from predia.operators.aggregates import weighted_category_count
from predia.operators.scale import min_max_score
from predia.plans import matching as M, models as L, valuation as V, zone_health as Z

ORDER = ["Bella Vista", "Betania", "Parque Lefevre", "Pedregal", "San Francisco"]


def scores(df, key="nombre", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def zones(spark, names=ORDER):
    return spark.createDataFrame([(z,) for z in names], "nombre string")


def test_safety(spark):
    rates = dict(zip(ORDER, [14.83, 4.74, 21.01, 15.60, 3.26]))
    df = spark.createDataFrame([*rates.items(), ("Obarrio", 99.0), ("Marbella", None)], "nombre string, tasa_por_100k double")
    got = scores(Z.safety_score(df, zones(spark)))
    expected = [0.34816901408450707, 0.9166197183098591, 0.0, 0.3047887323943662, 1.0]
    assert [got[z] for z in ORDER] == pytest.approx(expected, abs=1e-12)
    with pytest.raises(Exception, match="zones without rate"):
        Z.safety_score(df.filter("nombre <> 'Betania'"), zones(spark)).collect()


def test_transport(spark):
    counts, areas = [46, 62, 44, 50, 49], [4.581, 8.235, 7.231, 28.535, 6.655]
    points = spark.createDataFrame([(z,) for z, n in zip(ORDER, counts) for _ in range(n)] + [("Obarrio",), (None,)], "nombre string")
    table = spark.createDataFrame(list(zip(ORDER, areas)), "nombre string, superficie_km2 double")
    got = scores(Z.transport_score(table, [points.filter("nombre <> 'Betania' OR nombre IS NULL"), points.filter("nombre = 'Betania'")]))
    assert [got[z] for z in ORDER] == pytest.approx([1.0, 0.69688, 0.52269, 0.0, 0.67686], abs=1e-5)


def test_weighted_amenities(spark):
    counts = {"colegio": 4, "parque": 3, "supermercado": 2, "farmacia": 1, "salud": 2}
    points = spark.createDataFrame([("Pedregal", c) for c, n in counts.items() for _ in range(n)], "nombre string, categoria string")
    weights = spark.createDataFrame(list(K.AMENITY_WEIGHTS.items()), "categoria string, peso double")
    got = scores(weighted_category_count(zones(spark), points, weights, "nombre"), value="conteo_ponderado")
    assert got["Pedregal"] == pytest.approx(2.3527) and got["Betania"] == 0.0
    final = spark.createDataFrame(list(zip(["Betania", "Parque Lefevre", "San Francisco", "Bella Vista", "Pedregal"], [20.0765, 11.4510, 5.1757, 2.5094, 2.3527])), "nombre string, x double")
    assert [round(scores(min_max_score(final, "x"))[z], 4) for z in ["Betania", "Parque Lefevre", "San Francisco", "Bella Vista", "Pedregal"]] == [1.0, 0.5133, 0.1593, 0.0088, 0.0]


def test_walkability_direction(spark):
    df = spark.createDataFrame(list(zip(ORDER, [300.0, 500.0, 1200.0, 1400.0, 250.0])), "nombre string, distancia_promedio_m double")
    got = scores(Z.walkability_score(df))
    assert got["San Francisco"] == 1.0 and got["Pedregal"] == 0.0 and got["Bella Vista"] > got["Betania"]


def test_composite_and_inheritance(spark):
    amenities = dict(zip(ORDER, [0.0088, 1.0, 0.5133, 0.0, 0.1593]))
    safety = dict(zip(ORDER, [0.34816901408450707, 0.9166197183098591, 0.0, 0.3047887323943662, 1.0]))
    transport = dict(zip(ORDER, [1.0, 0.69688, 0.52269, 0.0, 0.67686]))
    walk = dict(zip(ORDER, [1.0, 0.8812, 0.7520, 0.0, 0.7885]))
    named = {"seguridad": safety, "transporte": transport, "amenidades": amenities, "walkability": walk}
    long = spark.createDataFrame([(z, d, v[z]) for d, v in named.items() for z in ORDER], "nombre string, dimension string, score double")
    weights = spark.createDataFrame(list(K.INDEX_WEIGHTS.items()), "dimension string, peso double")
    index = Z.composite(long, weights)
    got = scores(index, value="composite")
    assert [round(got[z], 4) for z in ORDER] == pytest.approx([0.5367, 0.8783, 0.3765, 0.1076, 0.6888], abs=2e-4)
    policy = spark.createDataFrame(
        [(z, z in K.OFFICIAL_ZONES, K.INHERITED_ZONES.get(z), z == K.ZONE_WITHOUT_SCORE, z == K.ZONE_HIDDEN) for z in K.SCOPE_ZONES],
        "nombre string, es_oficial boolean, hereda_de string, sin_score boolean, oculta boolean",
    )
    full = Z.apply_policy(policy, index.join(Z.desglose(long), "nombre"))
    table = {r["nombre"]: r for r in full.withColumn("categoria", Z.status_label(full)).collect()}
    assert len(table) == 9
    for child in K.INHERITED_ZONES:
        assert table[child]["zone_health_score"] == got["Bella Vista"] and table[child]["categoria"] == "Heredado de Bella Vista"
    assert table["Costa del Este"]["zone_health_score"] is None and table["Costa del Este"]["categoria"] == "Sin score"
    assert table["Pedregal"]["categoria"] == "Calculado, no visualizado" and table["Betania"]["categoria"] == "Calculado"
    with pytest.raises(Exception, match="sum to 1"):
        Z.composite(long, weights.filter("dimension <> 'walkability'")).collect()


def test_weights_after_dropping_a_dimension(spark):
    old = {"seguridad": 0.30, "transporte": 0.20, "amenidades": 0.20, "walkability": 0.15, "socioeconomico": 0.15}
    got = scores(Z.drop_dimension(spark.createDataFrame(list(old.items()), "dimension string, peso double"), "socioeconomico"), "dimension", "peso")
    assert got == pytest.approx(K.INDEX_WEIGHTS, abs=1e-8)


def test_transparency_check(spark):
    pairs = spark.createDataFrame([(1, 100.0, 90.0, "A"), (2, 50.0, 80.0, "A")], "propiedad_id int, precio_real double, precio_predicho double, zona string")
    row = V.transparency(pairs, 20.0, 200.0).first()
    assert (row["n_muestras"], row["mae_absoluto"], row["mae_porcentual"]) == (2, 20.0, 10.0)
    with pytest.raises(Exception, match="MAE differs"):
        V.transparency(pairs, 21.0).collect()


def test_precision_divides_by_k(spark):
    scored = spark.createDataFrame([("p", 1, 0.9), ("p", 2, 0.8)], "perfil string, listing_id int, s double")
    truth = spark.createDataFrame([("p", 1), ("p", 2)], "perfil string, listing_id int")
    row = M.precision_at(scored, truth, ["perfil"], "s", [1, 5]).first()
    assert (row["p1"], row["p5"]) == (1.0, 0.4)


def test_profiles_and_structural_score(spark):
    rows = [(1, "Betania", 300000, 3, 150), (2, "Betania", 300000, None, 150), (3, "Obarrio", 100000, 1, 50), (4, "Betania", 700000, 3, 120)]
    df = spark.createDataFrame(rows, "listing_id int, corregimiento string, price_usd int, bedrooms int, area_m2 int")
    got = {(r["perfil"], r["listing_id"]) for r in M.rule_matches(df, M.profile_table(spark)).collect()}
    assert {i for p, i in got if p == "familia_con_ninos"} == {1, 4}
    assert {i for p, i in got if p == "presupuesto_ajustado_sin_auto"} == {3}
    score = {(r["perfil"], r["listing_id"]): r["score_estructurado"] for r in M.structural_scores(df).collect()}
    assert score["familia_con_ninos", 1] == 1.0 and score["familia_con_ninos", 2] == pytest.approx(4 / 5)


def test_explanation_is_three_valued(spark):
    df = spark.createDataFrame(
        [(1, 100, 2, "Betania", 0.6, 120.0, 3, ["Betania"]), (2, 100, None, "Costa del Este", None, None, 1, [])],
        "listing_id int, price_usd int, bedrooms int, corregimiento string, transporte_score double, precio_maximo double, habitaciones_min int, zonas_preferidas array<string>",
    )
    got = {(r["listing_id"], r["dimension"]): r["cumplido"] for r in M.explain(df, 0.5).collect()}
    assert got == {
        (1, "precio"): True, (1, "habitaciones"): False, (1, "zona"): True, (1, "transporte"): True,
        (2, "precio"): None, (2, "habitaciones"): False, (2, "zona"): None, (2, "transporte"): None,
    }
    assert all(r["detalle"] for r in M.explain(df, None).collect())


def test_estimate_without_real_price(spark):
    listing = spark.createDataFrame([(1, "A", None)], "listing_id int, corregimiento string, price_usd double")
    found = spark.createDataFrame([(1, 10.0), (1, 20.0)], "listing_id int, vecino_precio double")
    row = V.priced(V.estimates(found), listing).first()
    assert row["precio_predicho"] == 15.0 and row["cobertura_insuficiente"] and row["diferencia_absoluta"] is None


def test_attempts_keep_success(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 4, 2), (1, None, 3), (2, None, 1)], "listing_id int, score int, intento int")
    assert {r["listing_id"]: (r["score"], r["valido"]) for r in V.merge_attempts(df).collect()} == {1: (4, True), 2: (None, False)}


def test_display_points_are_inside(spark):
    from predia.functions.geo import edges_contain, shape_edges
    from predia.plans import views

    data = "/root/testdata/sf0.001"
    zone, shapes = views.zone(spark, data), views.polygon(spark, data)
    listing = views.listing(spark, data)
    points = Z.display_points(listing, zone, shapes)
    assert points.count() == listing.count()
    drawn = points.filter("lng IS NOT NULL").join(zone.select(F.col("nombre").alias("corregimiento"), F.coalesce("hereda_de", "nombre").alias("nombre")), "corregimiento").join(shapes, "nombre")
    assert drawn.count() > 0
    assert drawn.filter(~edges_contain(shape_edges("geom"), F.col("lng"), F.col("lat"))).count() == 0
    assert points.filter("lng IS NULL AND ubicacion_aproximada IS NOT NULL").count() == 0


def test_models(spark):
    rows = [(i, f"Z{i % 3}", float(1000 * (i % 40) + 50 * (i % 3)), i % 5 + 1, i % 3 + 1, float(i % 40 + 1)) for i in range(240)]
    df = V.with_split(spark.createDataFrame(rows, "listing_id int, corregimiento string, price_usd double, bedrooms int, bathrooms int, area_m2 double"))
    report = L.forest_report(df, folds=2, trees=10, depth=6).first()
    assert 0 < report["mae_train"] < 5000 and report["mae_test"] > 0
    ranked = L.importance_ranking(df, trees=10, depth=6).collect()
    assert ranked[0]["variable"] == "area_m2" and sum(r["importancia"] for r in ranked) == pytest.approx(1.0)
    seg = df.withColumn("precio_por_m2", F.col("price_usd") / F.col("area_m2"))
    sweep = L.kmeans_sweep(seg, range(2, 5)).collect()
    assert sum(r["elegido"] for r in sweep) == 1 and sweep[0]["inercia"] > sweep[-1]["inercia"]
    scaling, centres = L.fit_segments(seg, 2)
    labels = {r[0] for r in seg.select(L.assign_segment(scaling, centres)).distinct().collect()}
    assert labels == {0, 1} and centres[0][0] < centres[1][0]
