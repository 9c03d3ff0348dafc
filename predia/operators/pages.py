"""Detail pages as a table job: patterns for plain pages, a parser for nested or unclosed markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from predia.operators import catalogue as C

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Region of a page -> class that opens it; the first element with the class counts.
REGIONS = {"crumbs": "nb-breadcrumb-list", "full": "nb-desc-full-content", "preview": "nb-desc-preview"}


class _Regions(HTMLParser):
    """Texts inside the first element of each region, and per list item of the breadcrumb."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: dict[str, int] = {}
        self.texts: dict[str, list[str]] = {}
        self.items: list[list[str]] = []
        self.open_items: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.stack.append(tag)
        classes = (dict(attrs).get("class") or "").split()
        for region, name in REGIONS.items():
            if name in classes and region not in self.texts:
                self.open[region], self.texts[region] = len(self.stack), []
        if tag == "li" and "crumbs" in self.open:
            self.items.append([])
            self.open_items.append((len(self.stack), self.items[-1]))

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        depth = len(self.stack)
        self.open = {r: d for r, d in self.open.items() if d <= depth}
        self.open_items = [(d, i) for d, i in self.open_items if d <= depth]

    def handle_data(self, data):
        text = data.strip()
        if not text or (self.stack and self.stack[-1] in ("script", "style")):
            return
        for region in self.open:
            self.texts[region].append(text)
        for _, item in self.open_items:
            item.append(text)


def _read(html: str | None) -> tuple[str, str, str]:
    page = _Regions()
    page.feed(html or "")
    page.close()
    crumbs = [c for c in ("".join(i) for i in page.items) if c not in ("", "›", ">")]
    return (
        crumbs[2] if len(crumbs) >= 3 else "",
        " ".join(page.texts.get("full", [])), " ".join(page.texts.get("preview", [])),
    )


def needs_parser(html: Column) -> Column:
    """Pages whose blocks nest their own tag, stay unclosed, or hold character references."""
    inner = r"(?i)<(div|p|span|section|article|script|style)\b"
    full = F.regexp_extract(html, C.FULL_TEXT, 2)
    preview = F.regexp_extract(html, C.PREVIEW_TEXT, 2)
    crumbs = F.regexp_extract(html, C.CRUMB_LIST, 1)

    def unclosed(region: str, block: Column) -> Column:
        return F.contains(html, F.lit(REGIONS[region])) & (block == "")

    return F.coalesce(
        full.rlike(inner) | preview.rlike(inner) | html.rlike("&[#a-zA-Z0-9]+;")
        | unclosed("full", full) | unclosed("preview", preview) | unclosed("crumbs", crumbs),
        F.lit(False),
    )


def page_details(pages: DataFrame, key: str = "listing_id", html: str = "html") -> DataFrame:
    """(key, tipo_inmueble, descripcion, descripcion_fuente, estado) of every page.

    Plain pages stay in the JVM; only the others go to Python, in Arrow batches.
    """
    plain = pages.filter(~needs_parser(F.col(html))).select(key, C.detail_fields(F.col(html)).alias("x")).select(key, "x.*")
    kind = dict(pages.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [_read(h) for h in batch[html]]
            yield pd.DataFrame({
                key: batch[key], "tipo_inmueble": [p[0] for p in parts],
                "full": [p[1] for p in parts], "preview": [p[2] for p in parts],
            })

    parsed = pages.filter(needs_parser(F.col(html))).select(key, html).mapInPandas(
        read, f"{key} {kind}, tipo_inmueble string, full string, preview string"
    )
    text = F.when(F.col("full") != "", F.col("full")).otherwise(F.col("preview"))
    source = F.when(F.col("full") != "", "completa").when(F.col("preview") != "", "preview").otherwise("ninguna")
    no_kind = F.col("tipo_inmueble") == ""
    state = (
        F.when(~no_kind & (text != ""), "ok").when(no_kind & (text == ""), "sin_ambos")
        .when(no_kind, "sin_breadcrumb").otherwise("sin_descripcion")
    )
    read_rows = parsed.select(
        key, "tipo_inmueble", text.alias("descripcion"), source.alias("descripcion_fuente"), state.alias("estado")
    )
    return plain.unionByName(read_rows)
