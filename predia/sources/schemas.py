"""Schemas of the input files and tables."""

from __future__ import annotations

LISTING_CSV = (
    "listing_url string, listing_id bigint, title string, zone_raw string, zone string, "
    "zone_source string, price_raw string, price_usd double, precio_no_evaluable boolean, "
    "precio_no_evaluable_motivo string, bedrooms bigint, bathrooms bigint, area_m2 double, "
    "operation string, source string, scraped_at timestamp"
)
PAGINATION_LOG = "pagina bigint, resultado string, tarjetas bigint"
PREDICTION_PAIRS = "propiedad_id bigint, precio_real double, precio_predicho double, zona string"
POI_LINES = (
    "nombre string, categoria string, lat double, lng double, direccion string, place_id string, "
    "telefono string, rating double, nota_auditoria string"
)
SAFETY_LINES = (
    "corregimiento string, tasa_por_100k double, superficie_km2 double, poblacion_2023 bigint, hereda_de string"
)
STATION_LINES = "nombre string, tipo string, lat double, lng double, corregimiento_id string"
FEATURE = "properties map<string, string>, geometry struct<type: string, coordinates: string>"
GEOJSON = f"features array<struct<{FEATURE}>>"
