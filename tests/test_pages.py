from __future__ import annotations

from predia.operators.pages import page_details

CRUMBS = '<ol class="nb-breadcrumb-list"><li>Inicio</li><li>›</li><li>Venta</li><li><a>Casas</a></li></ol>'
PAGES = {
    1: (CRUMBS + '<div class="nb-desc-full-content">Linda <b>vista</b></div>', ("Casas", "Linda vista", "completa", "ok")),
    2: (CRUMBS + '<div class="nb-desc-full-content"><div>Uno</div><div>Dos &amp; tres</div></div><p>fuera</p>', ("Casas", "Uno Dos & tres", "completa", "ok")),
    3: (CRUMBS + '<div class="nb-desc-preview"><p>corta', ("Casas", "corta", "preview", "ok")),
    4: ('<ol class="nb-breadcrumb-list"><li>Inicio<li>Venta', ("", "", "ninguna", "sin_ambos")),
    5: (CRUMBS + '<div class="nb-desc-full-content"><script>x()</script></div>', ("Casas", "", "ninguna", "sin_descripcion")),
    6: ("", ("", "", "ninguna", "sin_ambos")),
}


def test_plain_nested_and_broken_pages(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _) in PAGES.items()], "listing_id long, html string")
    got = {r["listing_id"]: tuple(r)[1:] for r in page_details(df).collect()}
    assert got == {k: expected for k, (_, expected) in PAGES.items()}
