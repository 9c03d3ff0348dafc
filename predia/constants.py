"""Fixed values the results depend on. All are defaults of parameters elsewhere."""

from __future__ import annotations

# --- Fixed values: zones -------------------------------------------------------------
OFFICIAL_ZONES = ["Bella Vista", "Betania", "Parque Lefevre", "Pedregal", "San Francisco"]
SCOPE_ZONES = [
    "San Francisco", "Bella Vista", "Parque Lefevre", "Betania", "Pedregal",
    "El Cangrejo", "Marbella", "Obarrio", "Costa del Este",
]
INHERITED_ZONES = {
    "El Cangrejo": "Bella Vista",
    "Marbella": "Bella Vista",
    "Obarrio": "Bella Vista",
}
ZONE_WITHOUT_SCORE = "Costa del Este"
ZONE_HIDDEN = "Pedregal"
MODEL_ZONES = [
    "Bella Vista", "Betania", "Costa del Este", "El Cangrejo",
    "Marbella", "Obarrio", "San Francisco",
]
EXCLUDED_MODEL_ZONES = ["Pedregal", "Parque Lefevre"]
UNKNOWN_ZONE = "zona_no_determinada"
ZONE_SOURCES = [
    "zone_raw_barrio_mapeado", "zone_raw", "titulo_ph_mapeado", "pagina_scrapeada_no_resuelto",
]

# --- Fixed values: neighbourhood and building names to zones -------------------------
NEIGHBOURHOOD_ZONE = {
    "el carmen": "Bella Vista",
    "punta paitilla": "San Francisco",
    "punta pacifica": "San Francisco",
    "coco del mar": "San Francisco",
    "carrasquilla": "Parque Lefevre",
    "panama viejo": "Parque Lefevre",
    "tumba muerto": "Betania",
    "villa de las fuentes": "Betania",
    "edison park": "Betania",
}
BUILDING_ZONE = {
    "condesa del mar": "Bella Vista",
    "rivage": "Bella Vista",
    "mirador del golf": "San Francisco",
}

# --- Fixed values: property types ----------------------------------------------------
TYPE_PLURAL = {
    "Apartamento": "Apartamentos",
    "Casa": "Casas",
    "Edificio": "Edificios",
    "Local": "Locales",
    "Terreno": "Terrenos",
}
MODEL_TYPE = "Apartamentos"
EXCLUDED_TITLE_WORDS = [
    "bodega", "local comercial", "oficina", "terreno", "finca",
    "galera", "nave industrial", "lote",
]
RENT_WORDS = ["alquiler", "renta"]

# --- Fixed values: price rules -------------------------------------------------------
SALE_FLOOR = 20000
RENT_FLOOR = 400
PRICE_M2_RANGE = (100, 15000)
REASON_FLOOR = "precio_bajo_umbral"
REASON_M2 = "precio_m2_fuera_de_rango"

# --- Fixed values: index weights -----------------------------------------------------
DIMENSIONS = ["seguridad", "transporte", "amenidades", "walkability"]
INDEX_WEIGHTS = {
    "seguridad": 0.352941176,
    "transporte": 0.235294118,
    "amenidades": 0.235294118,
    "walkability": 0.176470588,
}
AMENITY_CATEGORIES = ["supermercado", "farmacia", "salud", "parque", "colegio"]
AMENITY_WEIGHTS = {  # they sum to 0.9999 and are used as they are
    "supermercado": 0.3137,
    "parque": 0.2549,
    "salud": 0.2353,
    "colegio": 0.0980,
    "farmacia": 0.0980,
}
RAW_CATEGORIES = ["supermercado", "farmacia", "hospital", "clinica", "parque", "colegio"]
MERGED_CATEGORY = {
    "supermercado": "supermercado",
    "farmacia": "farmacia",
    "clinica": "salud",
    "hospital": "salud",
    "parque": "parque",
    "colegio": "colegio",
}
TAG_ORDER = ["shop", "leisure", "amenity"]
TAG_CATEGORY = {
    "shop": {"supermarket": "supermercado"},
    "leisure": {"park": "parque"},
    "amenity": {
        "pharmacy": "farmacia", "school": "colegio", "clinic": "clinica", "hospital": "hospital",
    },
}
EARTH_RADIUS_M = 6_371_000.0

# --- Fixed values: matching ----------------------------------------------------------
WEIGHT_STRUCTURAL = 0.6
WEIGHT_SEMANTIC = 0.4
WEIGHT_SWEEP = [(1.0, 0.0), (0.8, 0.2), (0.7, 0.3), (0.6, 0.4), (0.5, 0.5)]
PRECISION_KS = [3, 5, 10]

# --- Fixed values: valuation ---------------------------------------------------------
SEED = 42
NEIGHBOURS = 5
MAE_MULTIPLE = 1.5
MAE_REFERENCE = 187543.4765550239
MEAN_PRICE_REFERENCE = 561494.7715930903
CATALOGUE_ROWS_REFERENCE = 1042
MAE_CV_REFERENCE = 165707
LIGHT_SHARES_REFERENCE = {"verde": 0.091, "amarillo": 0.823, "rojo": 0.086}
DRIFT_POINTS = 5.0
CLUSTER_LABELS = {0: "Compacto / económico", 1: "Grande / premium"}
NO_CLUSTER = "Sin segmentación disponible"
QUALITY_DIMENSIONS = [
    "completitud_informativa", "calidad_presentacion",
    "diferenciadores_amenidades", "transparencia_precio",
]
QUALITY_REFERENCE = {
    "completitud_informativa": (4.66, 0.67),
    "calidad_presentacion": (4.73, 0.61),
    "diferenciadores_amenidades": (4.51, 0.84),
    "transparencia_precio": (3.68, 1.81),
}

# --- Fixed values: query outcomes ----------------------------------------------------
CONFIDENCE_CUT = 0.65
WATCH_BAND = (0.55, 0.75)
OUTCOMES = ["exito", "fallback_cobertura", "fallback_fuera_tema", "fallback_ambiguedad"]

# --- Fixed values: lifestyle profiles ------------------------------------------------
# The zone list of pareja_presupuesto_medio is every zone whose index is at least 0.5.
PROFILES = [
    {"perfil": "familia_con_ninos", "corregimientos": ["Betania", "San Francisco"],
     "price_usd_min": 150000, "price_usd_max": 700000, "bedrooms_min": 3, "area_m2_min": 120,
     "incluye": ["familiar", "colegio", "escuela"]},
    {"perfil": "profesional_joven",
     "corregimientos": ["Bella Vista", "El Cangrejo", "Marbella", "Obarrio"],
     "price_usd_max": 450000, "bedrooms_min": 1, "bedrooms_max": 2,
     "incluye": ["restaurante", "bar", "vida nocturna", "caminable"],
     "excluye": ["renta corta", "airbnb"]},
    {"perfil": "pareja_presupuesto_medio",
     "corregimientos": ["Bella Vista", "Betania", "San Francisco", "El Cangrejo", "Marbella",
                        "Obarrio"],
     "price_usd_min": 236325, "price_usd_max": 650000, "bedrooms_min": 2, "bedrooms_max": 2,
     "incluye": ["tranquil", "céntric"], "excluye": ["vida nocturna"]},
    {"perfil": "inversionista_renta_corta",
     "corregimientos": ["San Francisco", "Bella Vista", "El Cangrejo", "Marbella", "Obarrio"],
     "price_usd_min": 150000, "bedrooms_min": 1, "bedrooms_max": 2, "area_m2_max": 100,
     "incluye": ["renta corta", "airbnb", "piscina", "gimnasio", "amoblado"]},
    {"perfil": "retirado_tranquilidad", "corregimientos": ["Betania"],
     "bedrooms_min": 2, "bedrooms_max": 3,
     "incluye": ["tranquil", "residencial"], "excluye": ["vía principal", "avenida"]},
    {"perfil": "presupuesto_ajustado_sin_auto",
     "corregimientos": ["Bella Vista", "El Cangrejo", "Marbella", "Obarrio", "Betania",
                        "San Francisco"],
     "price_usd_max": 200000, "incluye": ["metro", "parada", "transporte"]},
]

# --- Fixed values: text clean-up -----------------------------------------------------
PHONE_PATTERN = r"(\+?\s?507[\s.-]?)?6\d{3}[\s.-]?\d{4}\b"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
REDACTION_MARK = "[contacto de terceros removido]"
C1_FROM = "\u0091\u0092\u0093\u0094\u0096\u0097"
C1_TO = "''\"\"–—"
LISTING_ID_PATTERN = r"_p-(\d+)\.htm"
