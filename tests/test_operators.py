from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predia.operators import aggregates as A, catalogue as C, filters as P, gates as G, nearest as N, scale as X, sets as S, spatial, vector_search as VS
from predia.operators.overlap import overlap
from predia.sources import readers as R, schemas as SC, writers as W


def sample(n, seed, offset=0):
    """A third of all rows is one vector."""
    r = np.random.default_rng(seed)
    hot = r.random(n) < 1 / 3
    return pd.DataFrame({
        "id": np.arange(n) + offset, "a": np.where(hot, 2, r.integers(1, 6, n)).astype(float),
        "b": np.where(hot, 2, r.integers(1, 6, n)).astype(float), "c": np.where(hot, 50, r.integers(1, 400, n)).astype(float),
        "z": np.where(hot, "A", r.choice(list("ABCDE"), n)), "p": r.random(n),
    })


def brute(queries, refs, weights, k):
    out = {}
    for q in queries.itertuples():
        d = sum(w * (getattr(q, f) - refs[f].to_numpy()) * (getattr(q, f) - refs[f].to_numpy()) for f, w in zip("abc", weights))
        d = d + np.where(refs.z.to_numpy() == q.z, 0.0, 2.0)
        order = [i for i in np.lexsort((refs.id.to_numpy(), d)) if refs.id.iloc[i] != q.id][:k]
        out[q.id] = [int(refs.id.iloc[i]) for i in order]
    return out


@pytest.mark.parametrize("weights", [[0.5, 0.5, 1 / 64], [0.5, 0.5, 1 / 4096]])
def test_nearest_join_equals_brute_force(spark, weights):
    refs = sample(500, 1)
    queries = pd.concat([refs.iloc[:120], sample(120, 2, 10_000)])
    got = N.nearest_join(
        spark.createDataFrame(queries), spark.createDataFrame(refs), "id", "id", ["a", "b", "c"], 5,
        weights=weights, category="z", payload=["p"], exclude_self=True,
    ).toPandas()
    found = {q: list(g.sort_values("rank").vecino_id) for q, g in got.groupby("id")}
    assert found == brute(queries, refs, weights, 5)
    assert (got.merge(refs[["id", "p"]], left_on="vecino_id", right_on="id").eval("p_x == p_y")).all()


def two_clusters(n, seed, gap=1e6):
    r = np.random.default_rng(seed)
    far = r.random(n) < 0.5
    return pd.DataFrame({
        "id": np.arange(n), "a": r.random(n) + far * gap, "b": r.random(n) - far * gap, "c": r.random(n) * 1e-6, "z": r.choice(list("AB"), n),
    })


def pairs_of(got):
    return {q: list(g.sort_values("rank").vecino_id) for q, g in got.toPandas().groupby("id")}


def test_nearest_join_of_distant_clusters_equals_brute_force(spark):
    refs = two_clusters(600, 5)
    df = spark.createDataFrame(refs)
    got = pairs_of(N.nearest_join(df, df, "id", "id", ["a", "b", "c"], 4, category="z", exclude_self=True, crowd=40))
    assert got == brute(refs, refs, [1, 1, 1], 4)


@pytest.mark.parametrize("category", [None, "z"])
def test_queries_outside_of_the_clusters_descend_into_them(spark, category):
    """Queries spread over the empty space around two dense clusters: crowded cells are met child by child."""
    refs = two_clusters(800, 6, gap=50.0)
    r = np.random.default_rng(7)
    queries = pd.DataFrame({"id": np.arange(5000, 5060), "a": r.uniform(-80, 130, 60), "b": r.uniform(-130, 80, 60), "c": 0.0, "z": r.choice(list("ABC"), 60)})
    if not category:
        refs, queries = refs.assign(z="A"), queries.assign(z="A")
    got = N.nearest_join(spark.createDataFrame(queries), spark.createDataFrame(refs), "id", "id", ["a", "b", "c"], 3, category=category, crowd=30)
    assert pairs_of(got) == brute(queries, refs, [1, 1, 1], 3)


def test_grids_follow_the_population(spark):
    """The clusters are cut until their cells hold few references, and empty space costs no depth."""
    df = spark.createDataFrame(two_clusters(600, 5)).select(F.lit("").alias("cat"), *[F.floor(F.col(x) / F.lit(2e6 / 2**N.DEPTH) + 2**(N.DEPTH - 1)).alias(f"c{i}") for i, x in enumerate("ab")],
        F.col("a").alias("s0"), F.col("b").alias("s1"), F.array(F.lit(1)).alias("members"))
    grids = N._Grids(df, [], 2, 6, 1.0)
    crowded = grids.cells.filter((F.col("space") == N.ANY) & (F.col("level") == grids.lowest) & (F.col("n") >= 6) & (F.col("v") > N.LEAF))
    assert crowded.isEmpty() and 0 < grids.lowest < 30
    assert grids.cells.filter((F.col("space") == N.ANY) & (F.col("level") == N.DEPTH - 1)).agg(F.sum("n")).first()[0] == 600


def test_nearest_join_with_fewer_references_than_k(spark):
    refs = spark.createDataFrame(sample(3, 3))
    got = N.nearest_join(refs, refs, "id", "id", ["a", "b", "c"], 5, category="z", exclude_self=True)
    assert got.groupBy("id").count().filter("count <> 2").count() == 0


def test_nearest_on_earth(spark):
    r = np.random.default_rng(4)
    points = pd.DataFrame({"id": np.arange(300), "lat": r.uniform(8.9, 9.1, 300), "lng": r.uniform(-79.6, -79.4, 300)})
    anchors = pd.DataFrame({"zona": list("ABCD"), "lat": r.uniform(8.8, 9.2, 4), "lng": r.uniform(-79.7, -79.3, 4)})
    got = N.nearest_on_earth(spark.createDataFrame(anchors), spark.createDataFrame(points), "zona", "id").toPandas().set_index("zona")
    for a in anchors.itertuples():
        la, lo = np.radians(points.lat), np.radians(points.lng)
        h = np.sin((la - np.radians(a.lat)) / 2) ** 2 + np.cos(la) * np.cos(np.radians(a.lat)) * np.sin((lo - np.radians(a.lng)) / 2) ** 2
        assert got.loc[a.zona, "distancia_m"] == pytest.approx(2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)).min(), abs=1e-6)


@pytest.mark.parametrize("blocked", [False, True])
def test_vector_topk_equals_brute_force(spark, monkeypatch, blocked):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 8))
    vectors = pd.DataFrame({"listing_id": np.arange(180), "embedding": [base[i % 60].tolist() for i in range(180)], "zona": ["A" if i % 3 else "B" for i in range(180)], "precio": np.arange(180.0)})
    queries = pd.DataFrame({"query_id": np.arange(7), "vector": [r.normal(size=8).tolist() for _ in range(7)], "pide": [None, "A", "B", None, "A", "B", "A"], "tope": [100.0, None, 90.0, None, 50.0, None, 2.0]})
    if blocked:
        monkeypatch.setattr(VS, "MAX_QUERY_CELLS", 20)
    got = VS.vector_topk(
        spark.createDataFrame(queries, "query_id long, vector array<double>, pide string, tope double"), spark.createDataFrame(vectors), 5,
        criteria=[("pide", "eq", "zona"), ("tope", "le", "precio")],
    ).toPandas()
    m = np.vstack(vectors.embedding.map(np.asarray)).astype("float32").astype("float64")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in queries.itertuples():
        v = np.asarray(q.vector)
        d = np.round(1 - m @ (v / np.linalg.norm(v)), 9)
        ok = np.ones(180, bool)
        if isinstance(q.pide, str):
            ok &= vectors.zona.to_numpy() == q.pide
        if q.tope == q.tope:
            ok &= vectors.precio.to_numpy() <= q.tope
        ids = np.flatnonzero(ok)
        expected = ids[np.lexsort((ids, d[ids]))][:5].tolist()
        assert got[got.query_id == q.query_id].sort_values("rank").listing_id.tolist() == expected


def test_hashed_search_finds_itself(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "listing_id long, embedding array<double>")
    assert VS.vector_topk_hashed(df, rows[7][1], 3).orderBy("distancia").first()["listing_id"] == 7


def test_rank_all_and_quantiles_with_a_hot_group(spark):
    r = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": np.where(r.random(900) < 0.6, "hot", r.choice(["x", "y"], 900)), "v": r.integers(0, 40, 900), "id": np.arange(900)})
    df = spark.createDataFrame(pdf)
    got = X.rank_all(df, ["g"], [F.desc("v"), F.col("id")]).toPandas().sort_values("id")
    expected = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    expected["rank"] = expected.groupby("g").cumcount() + 1
    assert got["rank"].tolist() == expected.sort_values("id")["rank"].tolist()
    q = X.exact_quantiles(df, ["g"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert q.loc[g].tolist() == pytest.approx([part.v.quantile(p) for p in (0.25, 0.5, 0.9)])


def test_carry_forward_crosses_blocks(spark):
    df = spark.createDataFrame([(1, i, "a" if i == 0 else "b" if i == 7 else None) for i in range(12)] + [(2, i, None) for i in range(3)], "hoja int, fila int, x string")
    got = X.carry_forward(df, ["hoja"], "fila", ["x"], block_rows=3).orderBy("hoja", "fila").collect()
    assert [r["x"] for r in got] == ["a"] * 7 + ["b"] * 5 + [None] * 3


@pytest.mark.parametrize("flat,value", [("zero", 0.0), ("null", None)])
def test_min_max_flat_group(spark, flat, value):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert X.min_max_score(df, "v", flat=flat).first()["score"] == value
    with pytest.raises(Exception, match="flat group"):
        X.min_max_score(df, "v", flat="error").collect()


SQUARE = "array(array(array(named_struct('x', {0}D, 'y', {1}D), named_struct('x', {2}D, 'y', {1}D), named_struct('x', {2}D, 'y', {3}D), named_struct('x', {0}D, 'y', {3}D))))"


@pytest.mark.parametrize("most", [64, 1])
def test_assign_zone_first_shape_wins(spark, most):
    shapes = spark.sql(f"SELECT 'uno' nombre, 1 orden, {SQUARE.format(0, 0, 2, 2)} geom UNION ALL SELECT 'dos', 2, {SQUARE.format(1, 1, 5, 5)}")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, 9.0, 9.0), (5, 0.0, 1.0), (6, 5.0, 5.0)], "id int, lat double, lng double")
    got = {r["id"]: r["corregimiento_asignado"] for r in spatial.assign_zone(points, shapes, most_edges=most).collect()}
    assert got == {1: "uno", 2: "uno", 3: "dos", 4: None, 5: "uno", 6: "dos"}


def test_zone_cascade(spark):
    rows = [("El Carmen ", "x", "pag"), ("OBARRIO", "x", "pag"), ("otro", "PH Rivage 12", "pag"), ("otro", "nada", "pag"), (None, None, "pag")]
    df = spark.createDataFrame(rows, "z string, t string, p string")
    got = [tuple(r[0]) for r in df.select(C.resolve_zone(F.col("z"), F.col("t"), F.col("p"))).collect()]
    assert got == [
        ("Bella Vista", "zone_raw_barrio_mapeado"), ("OBARRIO", "zone_raw"), ("Bella Vista", "titulo_ph_mapeado"),
        ("pag", "pagina_scrapeada_no_resuelto"), ("pag", "pagina_scrapeada_no_resuelto"),
    ]


def test_detail_page(spark):
    page = """<ol class="x nb-breadcrumb-list"><li>Inicio</li><li>›</li><li>Venta</li><li><a>Apartamentos</a></li><li>Zona</li></ol>
      <div class="nb-desc-preview">corta</div><div class="nb-desc-full-content">Linda <b>vista</b> al mar</div>
      <div class="ib-prop-gallery-main"><div class="swiper-slide"><img src="/files/a.jpg"><img alt="x" src='b.jpg'></div>
      <img src="/outside.jpg"><div class="swiper-slide"><div><img src="https://o.com/c.jpg"></div></div></div><footer><img src="/logo.png"></footer>"""
    df = spark.createDataFrame([(page,), (page.replace("nb-desc-full-content", "z"),), ("<p>nada</p>",)], "h string")
    got = [r[0] for r in df.select(C.detail_fields(F.col("h"))).collect()]
    assert tuple(got[0]) == ("Apartamentos", "Linda vista al mar", "completa", "ok")
    assert tuple(got[1]) == ("Apartamentos", "corta", "preview", "ok")
    assert tuple(got[2]) == ("", "", "ninguna", "sin_ambos")
    urls = df.limit(1).select(C.gallery_urls(F.col("h"), F.lit("https://s.com/p/uno.htm?x=1"))).first()[0]
    assert urls == ["https://s.com/files/a.jpg", "https://s.com/p/b.jpg", "https://o.com/c.jpg"]


def test_fingerprint_ignores_order_but_counts_copies(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "a int, b string")
    mark = C.fingerprint(a).first()["huella"]
    assert len(mark) == 64
    assert C.fingerprint(a.orderBy(F.desc("a")).repartition(3)).first()["huella"] == mark
    assert C.fingerprint(a.union(a.limit(1))).first()["huella"] != mark
    assert C.fingerprint(a.withColumn("b", F.when(F.col("a") != 3, F.col("b")))).first()["huella"] != mark


def test_overrides_and_ambiguous(spark):
    un = "pagina_scrapeada_no_resuelto"
    df = spark.createDataFrame([(1, "x", "bella-vista", un), (2, "x", "Betania", "zone_raw"), (3, "x", "pag", un)], "listing_id int, title string, corregimiento string, zone_source string")
    fixed = C.apply_overrides(df, spark.createDataFrame([(1, "Bella Vista")], "listing_id int, zona string"))
    assert {r["listing_id"]: r["corregimiento"] for r in fixed.collect()} == {1: "Bella Vista", 2: "Betania", 3: "zona_no_determinada"}
    rows = [(1, "Torre Sol 3", "Betania", "zone_raw"), (2, "Torre Sol 9", "pag", un), (3, "Ático en Marbella", "pag", un), (4, "Torre Luna", "Betania", "zone_raw"), (5, "Torre Luna", "Obarrio", "zone_raw"), (6, "Torre Luna 2", "pag", un)]
    got = C.resolve_ambiguous(spark.createDataFrame(rows, df.schema), ["Marbella", "Betania"], ["Torre Sol", "Torre Luna"])
    assert {r["listing_id"]: (r["corregimiento"], r["metodo"]) for r in got.collect() if r["listing_id"] in (2, 3, 6)} == {
        2: ("Betania", "edificio"), 3: ("Marbella", "titulo_literal"), 6: ("zona_no_determinada", "sin_resolver"),
    }


def test_page_limits(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "listing_id int, price_usd double")
    got = P.page(df, 4, 2).collect()
    assert [r["listing_id"] for r in got] == [6, 9, 1, 4] and {r["total"] for r in got} == {10}
    for bad in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            P.page(df, *bad)


def test_zero_is_a_bound(spark):
    assert len(P.structured_conditions(precio_min=0, habitaciones_min=0)) == 2
    assert P.structured_conditions() == []


def test_gates(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (1, "x", 9), (2, None, None)], "k int, c string, v int")
    assert rows(G.check_rules(df, {"set": G.in_set("c", ["a"]), "range": F.col("v").between(1, 5), "nn": G.not_null("v")})) == [("nn", 1), ("range", 1), ("set", 1)]
    assert G.unique_key(df, ["k"]).first()["violaciones"] == 1
    with pytest.raises(G.GateError):
        G.require(G.row_count(df, 4), "filas")
    G.require(G.row_count(df), "no vacía")
    with pytest.raises(G.GateError):
        G.require(G.weights_sum(spark.createDataFrame([(0.5,), (0.4,)], "peso double")), "pesos")
    declared = spark.createDataFrame([("p", 2), ("q", 1)], "perfil string, n_ground_truth int")
    report = {r["perfil"]: r["violaciones"] for r in G.declared_counts(declared, spark.createDataFrame([("p",), ("p",), ("r",)], "perfil string"), "perfil").collect()}
    assert report == {"p": 0, "q": 1, "r": 1}


def test_atomic_load_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1,), (2,)], "k int")
    W.load_checked(good, path, [lambda t: G.require(G.row_count(t, 2), "n")])
    with pytest.raises(G.GateError):
        W.load_checked(good.limit(1), path, [lambda t: G.require(G.row_count(t, 2), "n")])
    assert spark.read.parquet(path).count() == 2
    assert W.load_checked(good.union(good), path, []).count() == 4 == spark.read.parquet(path).count()


def test_update_column(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None)], "k int, v string")
    assert rows(W.update_column(base, new, "k", "v")) == [(1, "a"), (2, None)]
    with pytest.raises(G.GateError):
        W.check_update(base, spark.createDataFrame([(9, "z")], "k int, v string"), "k")
    W.check_update(base, new, "k")


def test_readers(spark, tmp_path):
    csv = tmp_path / "betania_listings.csv"
    csv.write_text('listing_url,listing_id,title,zone_raw,zone,zone_source,price_raw,price_usd,precio_no_evaluable,precio_no_evaluable_motivo,bedrooms,bathrooms,area_m2,operation,source,scraped_at\n'
                   'u,7,"Casa, ""linda""",Betania,Betania,zone_raw,$1,100,False,,2,,90,venta,s,2026-07-01 10:00:00\n')
    row = R.read_listing_csv(spark, str(csv)).first()
    assert (row["listing_id"], row["title"], row["corregimiento_archivo"], row["bathrooms"], row["precio_no_evaluable"]) == (7, 'Casa, "linda"', "betania", None, False)
    (tmp_path / "p.jsonl").write_text('{"nombre": "a", "lat": 9.0}\n\n{"nombre": "b"}\n')
    assert R.read_json_lines(spark, str(tmp_path / "p.jsonl"), SC.POI_LINES).count() == 2
    (tmp_path / "a.json").write_text('[{"listing_id": 1},\n {"listing_id": 2}]')
    assert R.read_json_array(spark, str(tmp_path / "a.json"), SC.LISTING_CSV).count() == 2
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"shop":"supermarket","n":3},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}},{"properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    features = R.read_geojson(spark, str(tmp_path / "g.geojson")).orderBy("orden").collect()
    assert features[0]["propiedades"]["shop"] == "supermarket" and features[0]["tipo_geometria"] == "Polygon"
    empty = tmp_path / "pares.csv"
    empty.write_text("propiedad_id,precio_real,precio_predicho,zona\n")
    with pytest.raises(Exception, match="empty"):
        R.read_pairs(spark, str(empty)).collect()


def test_overlap_and_split(spark, rows):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)], "perfil string, listing_id int")
    assert rows(overlap(members, ["a", "b", "c"])) == [("a", "b", 2, 66.7, 100.0), ("a", "c", 0, 0.0, 0.0), ("b", "c", 0, 0.0, 0.0)]
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "k int")
    assert tuple(S.split_report(ids(1, 2, 3), ids(1, 2), ids(2, 4), "k").first()) == (1, 1, 1)


def test_mean_gap_needs_two_groups(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 1)], "m string, s int")
    assert A.mean_gap(df, "m", ["s"]).count() == 0
    assert tuple(A.mean_gap(df.filter("m <> 'c'"), "m", ["s"]).first()) == ("s", 1.0, True)


def test_neighbour_join_is_not_widened_by_one_far_value(spark):
    import random

    from predia.operators import nearest

    draw = random.Random(9)
    rows = [(i, draw.uniform(0, 1000), draw.uniform(0, 1000)) for i in range(400)]
    rows.append((400, 1e9, 5.0))
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(r["id"], r["rank"]): r["vecino"] for r in nearest.nearest_join(
        df, df.withColumnRenamed("id", "vecino"), "id", "vecino", ["x", "y"], 3, exclude_self=True).collect()}
    for i, x, y in rows:
        near = sorted((j for j, *_ in rows if j != i), key=lambda j: ((rows[j][1] - x) ** 2 + (rows[j][2] - y) ** 2, j))[:3]
        assert [got[i, r] for r in (1, 2, 3)] == near


def test_crowded_cells_give_the_same_zones(spark):
    from predia.functions.geo import MULTIPOLYGON
    from predia.operators import spatial

    def square(x, y, w):
        ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        return [[ring]]

    shapes = [(f"s{i:02}", i, square(0.001 * i, 0.0, 0.004)) for i in range(12)]
    table = spark.createDataFrame(shapes, f"nombre string, orden int, geom {MULTIPOLYGON}")
    points = [(1, 0.0005 + 0.001 * i, 0.002) for i in range(15)] + [(None, 0.0015, 0.002)]
    df = spark.createDataFrame(points, "id long, lng double, lat double")
    one = spatial.assign_zone(df, table)
    expected = one.collect()
    several = spatial.assign_zone(df, table, most_edges=1)
    assert several.columns == one.columns and sorted(map(repr, several.collect())) == sorted(map(repr, expected))
    assert {r["lng"]: r["corregimiento_asignado"] for r in expected}[0.0005] == "s00"
    assert expected[0]["corregimiento_asignado"] is not None and len(expected) == len(points)


def wavy(x, y, radius, corners, seed):
    r = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, corners, endpoint=False)
    far = radius * (0.7 + 0.3 * r.random(corners))
    return list(zip((x + far * np.cos(turn)).tolist(), (y + far * np.sin(turn)).tolist()))


def by_scan(shapes, x, y):
    """First shape by rank that holds the place, by rays through all edges."""
    for name, _, parts in sorted(shapes, key=lambda s: (s[1], s[0])):
        inside = touches = False
        for ring in (ring for polygon in parts for ring in polygon):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    inside = not inside
                on_line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
                touches |= on_line and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
        if inside or touches:
            return name
    return None


@pytest.mark.parametrize("most", [16, 3])
def test_country_and_streets_in_one_table_equal_a_scan(spark, most):
    from predia.functions.geo import MULTIPOLYGON

    country, hole = wavy(-80, 8, 3.0, 700, 1), wavy(-80.3, 8.2, 0.4, 90, 2)
    shapes = [("pais", 9, [[country, hole], [wavy(-75, 8, 0.5, 40, 3)]])]
    shapes += [(f"calle{i}", i % 3, [[[(-80 + i * 0.01, 8.0), (-80 + i * 0.01 + 0.004, 8.0), (-80 + i * 0.01 + 0.004, 8.0003), (-80 + i * 0.01, 8.0003)]]]) for i in range(6)]
    table = spark.createDataFrame(shapes, f"nombre string, orden int, geom {MULTIPOLYGON}")
    r = np.random.default_rng(5)
    places = [*zip(r.uniform(-83.5, -74, 500).tolist(), r.uniform(4.5, 11.5, 500).tolist()), *zip(r.uniform(-80.01, -79.93, 300).tolist(), r.uniform(7.9995, 8.0005, 300).tolist())]
    places += country[:60] + hole[:30] + [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(country[:40], country[1:41])]
    places += [(-80.0, 8.0), (-79.998, 8.0), (-79.996, 8.0003), (-80.0, 8.0001)] + places[:50]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(-1, None, 8.0)], "id long, lng double, lat double")
    got = spatial.assign_zone(df, table, most_edges=most).collect()
    assert len(got) == len(places) + 1
    assert {g.id: g.corregimiento_asignado for g in got} == {**{i: by_scan(shapes, x, y) for i, (x, y) in enumerate(places)}, -1: None}
    cover = spatial.shape_cover(table, most_edges=most)
    assert cover.filter(F.size("edges") > most).filter(F.col("k") > spatial.LEAST_SIZE).count() == 0
    inner = cover.filter("nombre = 'pais' AND size(edges) = 0").agg(F.max("k"), F.min("k")).first()
    assert inner[0] > inner[1]  # large cells within, small ones along the border


def test_points_of_a_thin_shape_are_spread(spark):
    from predia.functions.geo import MULTIPOLYGON
    from predia.plans.zone_health import display_points

    thin = [[[(0.0, 0.0), (1.0, 1.0), (1.0, 1.001), (0.0, 0.001)]]]
    shapes = spark.createDataFrame([("Z", thin)], f"nombre string, geom {MULTIPOLYGON}")
    zones = spark.createDataFrame([("Z", None)], "nombre string, hereda_de string")
    listings = spark.range(500).selectExpr("id AS listing_id", "'Z' AS corregimiento")
    got = display_points(listings, zones, shapes).collect()
    assert len({(r["lng"], r["lat"]) for r in got}) == 500
    assert all(0 <= r["lat"] - r["lng"] <= 0.001 + 1e-12 for r in got)
    assert 0.4 < sum(r["lng"] for r in got) / 500 < 0.6


def test_unknown_category_fails_the_drift_gate(spark):
    from predia.operators.gates import drift

    df = spark.createDataFrame([("a",)] * 8 + [("new",)] * 2, "luz string")
    got = {r["luz"]: (r["n"], round(r["delta"], 6), r["violaciones"]) for r in drift(df, "luz", {"a": 0.8, "b": 0.03}, 5).collect()}
    assert got == {"a": (8, 0.0, 0), "b": (0, -3.0, 0), "new": (2, 20.0, 1)}


def test_crosstab_counts_values_off_the_list(spark):
    from predia.operators.aggregates import crosstab_share

    df = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "other"), ("r", "other")], "f string, c string")
    assert {r["c"]: r["share"] for r in crosstab_share(df, "f", "c", ["a", "b"]).collect()} == {"a": 0.25, "b": 0.25}


def test_centres_by_list_and_by_join_agree(spark, monkeypatch):
    from predia.plans import models

    centres = spark.createDataFrame([(i, float(i * 10 % 70), float(i)) for i in range(20)], "cluster_id long, x double, y double")
    rows = spark.createDataFrame([(i, float(i % 83), float(i % 11)) for i in range(200)] + [(999, None, 1.0)], "listing_id long, x double, y double")
    one = {r["listing_id"]: r["cluster_id"] for r in models.nearest_centre(rows, centres, ["x", "y"]).collect()}
    monkeypatch.setattr(models, "MAX_LISTED_CENTRES", 5)
    assert {r["listing_id"]: r["cluster_id"] for r in models.nearest_centre(rows, centres, ["x", "y"]).collect()} == one
    assert one[999] is None


def test_vectors_without_direction_are_left_out(spark):
    from predia.operators.vector_search import vector_topk

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "listing_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [0.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["query_id"], r["listing_id"]) for r in vector_topk(queries, vectors, 5).orderBy("rank").collect()] == [(7, 1), (7, 4)]


def test_profiles_are_scored_in_blocks(spark, monkeypatch):
    from predia.plans import matching

    profiles = [{"perfil": f"p{i}", "corregimientos": ["z"], "bedrooms_min": i} for i in range(3)]
    vectors = spark.createDataFrame([("p0", [1.0, 0.0]), ("p1", [1.0, 1.0]), ("p2", None)], "perfil string, vector array<double>")
    rows = spark.createDataFrame([(1, "z", 1.0, 2.0, 3.0, [1.0, 0.5]), (2, "z", 1.0, 0.0, 3.0, None), (3, "y", 1.0, 1.0, 3.0, [0.0, 1.0])],
                                 "listing_id long, corregimiento string, price_usd double, bedrooms double, area_m2 double, embedding array<double>")
    one = sorted(map(repr, matching.profile_scores(rows, vectors, profiles).collect()))
    monkeypatch.setattr(matching, "MAX_QUERY_CELLS", 2)
    assert sorted(map(repr, matching.profile_scores(rows, vectors, profiles).collect())) == one and len(one) == 9


def test_search_takes_singular_type_names(spark):
    from predia.plans.orchestration import enriched_search

    listings = spark.createDataFrame([(1, [1.0, 0.0], "Z", "Apartamentos", 5.0, 1.0, 1.0, 9.0), (2, [1.0, 0.0], "Z", "Casas", 5.0, 1.0, 1.0, 9.0)],
                                     "listing_id long, embedding array<double>, corregimiento string, tipo_inmueble string, price_usd double, bedrooms double, bathrooms double, area_m2 double")
    request = spark.createDataFrame([(4, [1.0, 0.0], None, "Apartamento", None, None, None, None)],
                                    "consulta_id long, vector array<double>, zona string, tipo_pedido string, precio_min double, precio_max double, habitaciones_min double, banos_min double")
    got = enriched_search(request, listings, lambda found: found.selectExpr(
        "listing_id", "'verde' AS categoria_semaforo", "1.0 AS precio_predicho", "5 AS n_comparables"), F.lit(None).cast("string")).collect()
    assert [(r["listing_id"], r["categoria_semaforo"]) for r in got] == [(1, "verde")]


def test_listed_and_joined_anchors_agree(spark, monkeypatch):
    import random

    draw = random.Random(3)
    anchors = spark.createDataFrame([(i, "ab"[i % 2], draw.uniform(8, 9), draw.uniform(-80, -79)) for i in range(20)], "zona long, t string, lat double, lng double")
    points = spark.createDataFrame([(i, "ab"[i % 2], draw.uniform(8, 9), draw.uniform(-80, -79)) for i in range(300)], "id long, t string, lat double, lng double")

    def found():
        return {(r["t"], r["zona"]): (r["id"], round(r["distancia_m"], 6)) for r in N.nearest_on_earth(anchors, points, "zona", "id", by=["t"]).collect()}

    listed = found()
    monkeypatch.setattr(N, "MAX_LISTED_ANCHORS", 5)
    assert found() == listed and len(listed) == 20


def test_profiles_can_be_a_table(spark):
    from predia.plans import matching

    profiles = [{"perfil": f"p{i}", "corregimientos": ["z", "y"][: 1 + i % 2], "bedrooms_min": i % 3,
                 "incluye": [["sol"], []][i % 2], "excluye": [[], ["ruido"]][i % 2]} for i in range(30)]
    listings = spark.createDataFrame(
        [(1, "z", 1.0, 2.0, 3.0, "con SOL", "completa"), (2, "y", 1.0, 1.0, 3.0, "con ruido", "preview"), (3, "z", 1.0, 1.0, 3.0, None, "ninguna")],
        "listing_id long, corregimiento string, price_usd double, bedrooms double, area_m2 double, descripcion string, descripcion_fuente string")
    table = matching.profile_table(spark, profiles)
    by_list = sorted(map(repr, matching.ground_truth(listings, profiles).collect()))
    assert sorted(map(repr, matching.ground_truth(listings, table).collect())) == by_list and by_list
    kept = {(r["perfil"], r["listing_id"]) for r in matching.ground_truth(listings, profiles).collect() if r["cualitativo"]}
    expected = set()
    for p in profiles:
        for r in listings.collect():
            text = (r["descripcion"] or "").lower()
            words = not p["incluye"] or any(w in text for w in p["incluye"])
            if r["corregimiento"] in p["corregimientos"] and r["bedrooms"] >= p["bedrooms_min"] and words and not any(
                    w in text for w in p["excluye"]) and r["descripcion_fuente"] != "ninguna":
                expected.add((p["perfil"], r["listing_id"]))
    assert kept == expected
