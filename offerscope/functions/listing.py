"""Urls, stock wording, colours, search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.text import any_of, normalize_text

# --- fixed values ---
ITEM_CODE = r"(?i)(?:/dp/|/gp/product/)([A-Z0-9]{10})"
ITEM_URL = "https://www.amazon.es/dp/"
ITEM_HOST = "amazon."
LISTING_PATHS = ("/search", "/buscar", "/buscador", "/result", "/resultados")
LISTING_PARAMS = ("q=", "query=", "search=", "s=", "k=")
LISTING_SEGMENTS = (
    "apple", "samsung", "movil", "moviles", "mobile", "smartphone", "smartphones", "tablet",
    "tablets", "laptop", "laptops",
)
CATEGORY_PATHS = ("/movil", "/moviles", "/mobile", "/smartphone", "/tablet", "/tablets")
COLOURS = (
    "negro", "blanco", "plata", "plateado", "oro", "dorado", "azul", "rojo", "verde", "amarillo",
    "morado", "rosa", "gris", "black", "white", "silver", "gold", "blue", "red", "green",
    "yellow", "purple", "pink", "gray", "grey", "titanium", "natural", "starlight", "midnight",
    "desert", "teal",
)
MODEL_MARKERS = ("ultra", "plus", "fe", "flip", "fold", "edge", "lite")
BLOCKED_TITLES = ("just a moment", "access denied")
BLOCKED_BODY = (
    "cf-browser-verification", "verify you are human", "captcha", "captcha-delivery", "datadome",
    "slide right to secure your access", "we want to make sure it is actually you",
)
BLOCKED_RESPONSE = (
    "api-services-support@amazon.com", "enter the characters you see below", "captcha",
    "robot check", "temporarily unavailable",
)
BLOCKED_STATUS = (429, 503)


def stock_state(text: Column) -> Column:
    n = normalize_text(text)
    return F.when(any_of(n, fixed.OUT_OF_STOCK_WORDS), False).when(
        any_of(n, fixed.IN_STOCK_WORDS), True
    )


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def url_query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def canonical_item_url(url: Column) -> Column:
    code = F.regexp_extract(url, ITEM_CODE, 1)
    return F.when(code != "", F.concat(F.lit(ITEM_URL), F.upper(code))).otherwise(url)


def item_code(url: Column) -> Column:
    code = F.nullif(F.upper(F.regexp_extract(url, ITEM_CODE, 1)), F.lit(""))
    return F.when(normalize_text(url_host(url)).contains(ITEM_HOST), code)


def model_code_param(url: Column) -> Column:
    return F.nullif(F.upper(F.trim(F.regexp_extract(url_query(url), r"(?:^|&)model[Cc]ode=([^&]+)", 1))), F.lit(""))


def with_model_code(url: Column, code: Column) -> Column:
    """Buy pages are addressed by model code alone; other urls stay."""
    root = F.regexp_extract(url, r"^([^?#]*)", 1)
    usable = (F.coalesce(url, F.lit("")) != "") & (F.coalesce(code, F.lit("")) != "")
    return F.when(usable & url_path(url).contains("/buy/"),
                  F.concat(root, F.lit("?modelCode="), code)).otherwise(url)


def is_listing_url(url: Column) -> Column:
    """Search and category pages, as opposed to product pages."""
    path, query = normalize_text(url_path(url)), normalize_text(url_query(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    shallow = (F.size(segments) <= 3) & any_of(path, CATEGORY_PATHS) & ~path.rlike(r"\d")
    return (
        any_of(path, LISTING_PATHS)
        | ((query != "") & any_of(query, LISTING_PARAMS))
        | last.isin(*LISTING_SEGMENTS)
        | shallow
    )


def page_blocked(title: Column, text: Column) -> Column:
    """Anti-bot page. The whole text is examined, not only its start."""
    t, body = normalize_text(title), normalize_text(text)
    return any_of(t, BLOCKED_TITLES) | t.startswith("un momento") | any_of(body, BLOCKED_BODY)


def response_blocked(status: Column, body: Column) -> Column:
    return F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False)) | any_of(F.lower(body), BLOCKED_RESPONSE)


def colour(text: Column) -> Column:
    """First listed colour found anywhere in the text, capitalised."""
    low = F.lower(text)
    return reduce(
        lambda rest, name: F.when(low.contains(name), name.capitalize()).otherwise(rest),
        reversed(COLOURS), F.lit(""),
    )


def alnum_tokens(text: Column) -> Column:
    """Letter and digit runs apart; plus signs stay."""
    n = F.regexp_replace(normalize_text(text), r"([a-z])(?=\d)", "$1 ")
    n = F.regexp_replace(n, r"(\d)(?=[a-z])", "$1 ")
    return F.filter(F.split(n, r"[^a-z0-9+]+"), lambda t: t != "")


def model_markers(text: Column) -> Column:
    listed = F.array(*[F.lit(m) for m in MODEL_MARKERS])
    found = F.array_intersect(listed, alnum_tokens(text))
    plus = F.lower(text).rlike(r"\b(?:s|a|z)\d{1,3}\+")
    return F.array_union(found, F.when(plus, F.array(F.lit("plus"))).otherwise(F.array().cast("array<string>")))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_queries(brand: Column, model: Column, capacity: Column, device: Column, code: Column) -> Column:
    """Distinct search phrases for a product, in order of preference."""
    b, m = normalize_text(brand), normalize_text(model)
    apple = b == "apple"
    lead = F.lower(F.substring(model, F.lit(1), F.length(brand) + 1)) == F.lower(F.concat(brand, F.lit(" ")))
    short = F.when(lead, F.trim(F.substring(model, F.length(brand) + 2, F.lit(10_000)))).otherwise(model)
    core_model = F.regexp_replace(m, r"\b(wifi|wi fi|5g|lte)\b", " ")
    core_model = F.regexp_replace(core_model, F.concat(F.lit(r"\b\Q"), b, F.lit(r"\E\b")), " ")
    base, core = F.concat_ws(" ", brand, short), _tidy(F.concat_ws(" ", brand, core_model))
    kind = (
        F.when(device == "tablet", F.when(apple, "ipad").otherwise("tablet"))
        .when(device == "laptop", F.when(apple, "mac").otherwise("portatil"))
        .otherwise(F.when(apple, "iphone").otherwise("movil"))
    )
    size = F.when(capacity != 0, F.concat(capacity.cast("string"), F.lit("GB")))
    flat = F.nullif(F.regexp_replace(F.coalesce(code, F.lit("")), r"\s+", ""), F.lit(""))
    sku = F.when(device == "laptop", flat)
    root = F.element_at(F.split(sku, r"[-_/]"), 1)
    root = F.when((root != "") & (root != sku), root)
    phrases = F.array(
        base, core,
        F.concat(base, F.lit(" "), size),
        F.concat(core, F.lit(" "), size),
        F.concat(base, F.lit(" "), kind), F.concat(core, F.lit(" "), kind),
        F.concat(base, F.lit(" "), size, F.lit(" "), kind), F.concat(core, F.lit(" "), size, F.lit(" "), kind),
        sku, F.concat(brand, F.lit(" "), sku), F.concat(base, F.lit(" "), sku),
        root, F.concat(brand, F.lit(" "), root), F.concat(base, F.lit(" "), root),
    )
    tidy = F.transform(F.array_compact(phrases), _tidy)
    return F.array_distinct(F.filter(tidy, lambda q: q != ""))


def spelling_queries(model: Column, capacity: Column, code: Column) -> Column:
    """Search phrases by spelling variant and product code; code phrases come before variants."""
    bare = F.when(model.contains(" 5G"), F.array(model, F.replace(model, F.lit(" 5G"), F.lit("")))).otherwise(
        F.array(model))

    def forms(n: Column) -> Column:
        rules = [("+", [" Plus"]), ("Wi Fi", ["WiFi", "Wi-Fi"]), ("+ Cell", ["Cellular", "Celular", "5G"]),
                 ("Galaxy Book", ["Book"])]
        parts = [F.when(n.contains(has), F.array(*[F.replace(n, F.lit(has), F.lit(o)) for o in out])).otherwise(
            F.array().cast("array<string>")) for has, out in rules]
        return F.concat(*parts)

    names = F.concat(bare, F.flatten(F.transform(bare, forms)))
    size = F.when(capacity >= 1000, F.concat(F.lit(" "), F.floor(capacity / 1024).cast("string"), F.lit("TB"))).when(
        capacity > 0, F.concat(F.lit(" "), capacity.cast("string"), F.lit("GB"))).otherwise("")
    spelled = F.array_distinct(F.transform(names, lambda n: F.concat(n, size)))
    sku = F.trim(F.coalesce(code, F.lit("")))
    under = sku.contains("_")
    codes = F.array_compact(F.array(
        F.when(sku != "", sku),
        F.when(under, F.replace(sku, F.lit("_"), F.lit("/"))),
        F.when(under, F.substring_index(sku, "_", 1)),
    ))
    every = F.array_distinct(F.concat(spelled, F.filter(codes, lambda c: c != "")))
    rest = F.slice(every, F.lit(2), F.size(every))

    def is_code(q: Column) -> Column:
        return ~q.contains(" ") & q.rlike(r"(?i)[a-z]") & q.rlike(r"\d")

    return F.concat(F.slice(every, 1, 1), F.filter(rest, is_code), F.filter(rest, lambda q: ~is_code(q)))
