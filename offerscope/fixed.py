"""Values that results depend on: enumerations, word lists, ranks, alias maps.

Everything below is a fixed value, stated once. Retailer-specific behaviour keys on
normalized retailer names; the base retailer is a parameter of every operator that
needs one and only its default lives here.
"""

# --- fixed values: base retailer default (deployments pass their own) ---
DEFAULT_BASE = "Home Store"

# --- fixed values: modalities ---
MODALITY_LABELS = {
    "renting_no_insurance": "Renting SIN Seguro",
    "renting_with_insurance": "Renting CON Seguro",
    "financing_max_term": "Financiacion",
    "cash": "Al contado",
}
MODALITY_ORDER = {
    "renting_no_insurance": 0,
    "renting_with_insurance": 1,
    "financing_max_term": 2,
    "cash": 3,
}
UNKNOWN_MODALITY_ORDER = 99
MONTHLY_MODALITIES = ("renting_no_insurance", "renting_with_insurance", "financing_max_term")
RENTING_MODALITIES = ("renting_no_insurance", "renting_with_insurance")
VALIDATION_PRIORITY = {
    "financing_max_term": 0,
    "renting_no_insurance": 1,
    "renting_with_insurance": 2,
    "cash": 3,
}
FINANCING_DEFAULT_TERM = 36
OFFER_KEYWORDS = {
    "renting_no_insurance": ("renting sin seguro", "sin seguro"),
    "renting_with_insurance": ("renting con seguro", "con seguro"),
    "financing_max_term": ("financiación", "financiacion", "financiar", "cuotas"),
    "cash": ("al contado", "contado", "pago único", "pago unico"),
}

# --- fixed values: canonical table ---
CANONICAL_COLUMNS = (
    "country", "retailer", "retailer_slug", "product_family", "brand", "device_type", "model",
    "capacity_gb", "product_code", "offer_type", "price_value", "price_text", "price_unit",
    "term_months", "in_stock", "data_quality_tier", "price_capture_kind", "extracted_at",
    "source_url", "source_title", "source_snapshot", "source_snapshots",
)
OPTIONAL_COLUMNS = ("product_code", "price_capture_kind")
EXPORT_COLUMNS = (
    "timestamp_extraccion", "competidor", "url_producto", "marca", "modelo", "capacidad",
    "modalidad", "modalidad_label", "precio_texto", "precio_valor", "moneda", "disponibilidad",
    "device_type", "term_months", "quality_tier", "source_title", "retailer_slug",
)

# --- fixed values: retailer aliases ---
RETAILER_ALIASES = {
    "MediaMarkt": "Media Markt",
    "Samsung Store": "Samsung Oficial",
    "Apple Store": "Apple Oficial",
    "El Corte Inglés": "El Corte Ingles",
}
SLUG_ALIASES = {
    "mediamarkt": "media_markt",
    "samsung_store": "samsung_oficial",
    "apple_store": "apple_oficial",
}
QUESTION_ALIASES = {
    "amazon": "Amazon",
    "apple oficial": "Apple Oficial",
    "apple store": "Apple Oficial",
    "el corte ingles": "El Corte Ingles",
    "corte ingles": "El Corte Ingles",
    "eci": "El Corte Ingles",
    "grover": "Grover",
    "media markt": "Media Markt",
    "mediamarkt": "Media Markt",
    "movistar": "Movistar",
    "orange": "Orange",
    "rentik": "Rentik",
    "samsung oficial": "Samsung Oficial",
    "samsung store": "Samsung Oficial",
}

# --- fixed values: price capture kinds ---
CAPTURE_KIND_RANK = {"visible_dom": 0, "embedded_json_exact": 1, "api_exact": 2}
CAPTURE_KIND_ALIASES = {
    "visible": "visible_dom",
    "dom_visible": "visible_dom",
    "dom_exact": "visible_dom",
    "embedded_json": "embedded_json_exact",
    "json_exact": "embedded_json_exact",
    "api": "api_exact",
}
RETAILERS_BY_API = ("rentik", "el corte ingles")
RETAILERS_BY_JSON = ("movistar", "grover")
RETAILERS_BY_DOM = ("media markt", "samsung oficial", "orange", "apple oficial")
RETAILERS_BY_DOM_CASH_ONLY = ("amazon",)

# --- fixed values: quality-gate word lists ---
DERIVED_MARKERS = (
    "derived", "calculad", "formula", "interestnominal", "default tin", "tin por defecto",
    "cash /", "price /",
)
CONDITIONAL_MARKERS = (
    "trade in", "trade-in", "recompra", "plan renove", "entrega tu", "entregando tu",
    "con portabilidad", "con tarifa", "ahorrando",
)
ACCESSORY_MARKERS = (
    "funda", "case", "protector", "charger", "cargador", "cable", "cover", "strap", "correa",
    "band", "adapter", "adaptador", "auriculares", "earbuds", "buds",
)
MODEL_STOPWORDS = (
    "samsung", "apple", "galaxy", "iphone", "ipad", "smartphone", "telefono", "movil",
)
VARIANT_MARKERS = ("ultra", "plus", "mini", "max", "fe", "air", "pro")
WIFI_MARKERS = (" wifi", "wi-fi", "wifi ")
CELLULAR_MARKERS = ("cellular", "5g", "4g", "lte")

# --- fixed values: boolean spellings ---
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
PUBLIC_TRUE_WORDS = ("true", "1", "yes", "y", "si", "s")

# --- fixed values: question hints ---
POSITIONING_HINTS = (
    "posicionado", "posicionamiento", "estado", "situacion", "status", "pricing", "priceado",
    "como ve", "como esta", "donde esta",
)
STRATEGY_HINTS = (
    "estrategia", "recomendacion", "recomendaciones", "accion", "acciones", "deberia", "seguir",
    "bundle", "bundles",
)
CHEAPEST_HINTS = ("barato", "mejor precio", "mas economico", "economico")

# --- fixed values: stock wording ---
OUT_OF_STOCK_WORDS = ("agotado", "sin stock", "no disponible", "sale proximamente", "proximamente")
IN_STOCK_WORDS = ("en stock", "disponible", "anadir al carrito", "agregar al carrito")

# --- fixed values: query limits ---
MAX_PAGE_SIZE = 500
TABLE_PAGE_SIZE = 80
TREND_SNAPSHOTS = 24
SNAPSHOTS_KEPT = 90
TOP_MODELS = 12
ALERT_PCT = -5.0
ALERT_CAP = 20
AUDIT_PCT = 30.0
VALIDATION_SAMPLE = 3
PRICE_TOLERANCE = 1.0
