"""Queries on price, capacity, url and text expressions, over whole tables of derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions import capacity as CAP
from offerscope.functions import listing as LS
from offerscope.functions import numbers as NUM
from offerscope.functions import prices as PR
from offerscope.functions.text import apart, normalize_text, strip_tags
from offerscope.operators.compare import html_text, sheet_link
from offerscope.plans.sqltext import norm, num, r2
from offerscope.sources.tables import MODEL_EXPR, read_table

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
WHOLE = f"substr({AMOUNT}, 1, length({AMOUNT}) - 3)"
CENTS = f"right({AMOUNT}, 2)"
GROUPED = f"""CASE WHEN length({WHOLE}) > 3 THEN substr({WHOLE}, 1, length({WHOLE}) - 3) || '.' ELSE '' END
 || right({WHOLE}, 3)"""
PRICE_TEXT = f"""CASE l_linenumber WHEN 1 THEN {GROUPED} || ',' || {CENTS} || ' €'
 WHEN 2 THEN {WHOLE} || ',' || {CENTS} || ' EUR' WHEN 3 THEN {AMOUNT}
 WHEN 4 THEN {WHOLE} || ',-' WHEN 5 THEN replace({GROUPED}, '.', ',') || '.' || {CENTS} || ' €/mes'
 WHEN 6 THEN CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN 'consultar precio'
 WHEN 3 THEN ' 35 EUR ' ELSE '1.2.3' END ELSE {GROUPED} END"""
PAGE = f"""'Modelo ' || {MODEL_EXPR} || CASE p_size % 4 WHEN 0 THEN ' 128GB' WHEN 1 THEN ' 64 gb y 1 TB' WHEN 2 THEN ' 2tb'
 ELSE '' END || CASE l_linenumber % 3 WHEN 0 THEN '. Al contado por ' || {GROUPED} || ',' || {CENTS} || ' €'
 WHEN 1 THEN '. Desde ' || {WHOLE} || ' € / mes durante 24 meses' ELSE '. Renting sin seguro: 12,5 € mes' END
 || CASE l_suppkey % 4 WHEN 0 THEN ' Financiación en cuotas de 30,99 €/mes x 36 meses' WHEN 1 THEN ' Añadir al carrito'
 WHEN 2 THEN ' Agotado' ELSE ' Próximamente disponible' END"""
PAGES = f"SELECT {', '.join(ID)}, p_type, {PAGE} AS text FROM lineitem JOIN part ON l_partkey = p_partkey"


def price_texts(spark, sf):
    return read_table(spark, sf, "lineitem").select(*ID, F.expr(PRICE_TEXT).alias("text"))


def page_texts(spark, sf):
    li, p = read_table(spark, sf, "lineitem"), read_table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(*ID, "p_type", F.expr(PAGE).alias("text"))


def p_prices(spark, sf):
    t = F.col("text")
    return price_texts(spark, sf).select(
        *ID, "text", NUM.parse_public_float(t).alias("public"), NUM.parse_table_float(t).alias("grid"),
        PR.parse_audit_price(t).alias("audit"), PR.parse_spanish_euro(t).alias("spanish"),
        PR.parse_loose_euro(t).alias("loose"), PR.parse_rival_price(t).alias("rival"),
        PR.parse_catalogue_price(t).alias("catalogue"), PR.parse_upfront_price(t).alias("upfront"),
        PR.fix_price_fragment(t).alias("fragment"))


def p_pages(spark, sf):
    t, folded = F.col("text"), F.col("folded")  # folded once, read by every keyword
    found = {
        "first_text": PR.first_price_text(t), "first": PR.first_price(t),
        "cash": PR.price_after(t, fixed.OFFER_KEYWORDS["cash"], folded=folded),
        "financed": PR.price_after(t, fixed.OFFER_KEYWORDS["financing_max_term"], folded=folded),
        "uninsured": PR.price_after(t, fixed.OFFER_KEYWORDS["renting_no_insurance"], folded=folded),
        "euro_value": PR.first_euro_value(t)}
    pages = apart(page_texts(spark, sf), {"folded": normalize_text(t)}, "text")
    return apart(pages, found, ID[0]).select(*ID, *found)


def p_monthly(spark, sf):
    t = F.col("text")
    return page_texts(spark, sf).select(*ID, PR.monthly_price(t).alias("monthly"), PR.monthly_term(t).alias("term"))


def p_capacity(spark, sf):
    t = F.col("text")
    return page_texts(spark, sf).select(
        *ID, CAP.smallest_mention(t).alias("smallest"), CAP.largest_mention(t).alias("largest"),
        CAP.last_mention(t).alias("last"), F.array_max(CAP.standard_sizes(t)).alias("standard"),
        CAP.for_device(t, F.when(F.col("p_type") == "LARGE", "Laptop").otherwise("mobile")).alias("for_device"),
        CAP.storage_text(t).alias("storage"))


def p_stock(spark, sf):
    return page_texts(spark, sf).select(*ID, LS.stock_state(F.col("text")).alias("in_stock"))


def p_tags(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


def p_tokens(spark, sf):
    t = F.col("model")
    models = read_table(spark, sf, "part").select(
        "p_partkey", F.expr(f"{MODEL_EXPR} || CASE p_size % 3 WHEN 0 THEN ' Galaxy S24+' WHEN 1 THEN ' Z Flip6' ELSE ' FE' END").alias("model"))
    return models.select("p_partkey", F.array_join(LS.alnum_tokens(t), " ").alias("tokens"),
                         F.array_join(F.array_sort(LS.model_markers(t)), ",").alias("markers"))


FLAG = """CASE l_linenumber WHEN 1 THEN 'True' WHEN 2 THEN ' yes ' WHEN 3 THEN 'Sí' WHEN 4 THEN 'NO' WHEN 5 THEN '0'
 WHEN 6 THEN 'n' ELSE 'tal vez' END"""
INTS = """CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS STRING) WHEN 2 THEN CAST(l_quantity AS STRING)
 WHEN 3 THEN ' 36.9 ' WHEN 4 THEN '-7.5' WHEN 5 THEN '1_000' WHEN 6 THEN '' ELSE '2e2' END"""


def p_flags(spark, sf):
    li = read_table(spark, sf, "lineitem").select(*ID, F.expr(FLAG).alias("flag"), F.expr(INTS).alias("number"))
    b, n = F.col("flag"), F.col("number")
    return li.select(*ID, NUM.parse_bool(b).alias("grid_bool"), NUM.parse_public_bool(b).alias("public_bool"),
                     NUM.parse_grid_bool(b).alias("page_bool"), NUM.parse_int(n).alias("whole"),
                     NUM.parse_grid_number(n).alias("number"))


URL = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'https://www.amazon.es/Titulo/dp/B0' || right('0000000' || page_id, 8) || '?k=1#top'
 WHEN 2 THEN 'https://www.amazon.es/gp/product/b0' || right('0000000' || page_id, 8) WHEN 3 THEN 'https://shop.example/search?q=galaxy'
 WHEN 4 THEN 'https://shop.example/es/moviles' WHEN 5 THEN 'https://shop.example/es/moviles/galaxy-s24-' || page_id
 WHEN 6 THEN 'https://shop.example/es/buy/?modelCode=sm-s' || page_id || '#x' ELSE 'https://shop.example/tablets/sin-cifra' END"""


def p_urls(spark, sf):
    u = F.col("u")
    return read_table(spark, sf, "pages").select("page_id", F.expr(URL.replace("|| page_id", "|| CAST(page_id AS STRING)")).alias("u")).select(
        "page_id", LS.canonical_item_url(u).alias("canonical"), LS.item_code(u).alias("code"),
        LS.without_fragment(u).alias("bare"), LS.is_listing_url(u).alias("listing"),
        LS.model_code_param(u).alias("model_code"), LS.with_model_code(u, F.lit("SM-X1")).alias("addressed"))


def p_colours(spark, sf):
    p = read_table(spark, sf, "part")
    name = F.concat(F.initcap("p_name"), F.lit(" Titanium "), F.col("p_size"), F.lit("gb"))
    return p.select("p_partkey", LS.colour(name).alias("colour"), CAP.storage_text(name).alias("storage"))


def p_queries(spark, sf):
    p = read_table(spark, sf, "part")
    q = LS.search_queries(F.col("p_brand"), F.expr("p_brand || ' ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' 5G' ELSE ' pro' END"),
                          F.expr("CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 8 END"),
                          F.expr("CASE p_type WHEN 'LARGE' THEN 'laptop' WHEN 'SMALL' THEN 'tablet' ELSE 'mobile' END"),
                          F.expr("'NP-' || CAST(p_partkey AS STRING)"))
    return p.select("p_partkey", F.posexplode(q).alias("place", "query"))


def p_spellings(spark, sf):
    p = read_table(spark, sf, "part")
    q = LS.spelling_queries(F.expr("p_name || CASE p_partkey % 4 WHEN 0 THEN ' 5G' WHEN 1 THEN '+' WHEN 2 THEN ' Wi Fi' ELSE '' END"),
                            F.expr("CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 2048 ELSE 256 END"),
                            F.expr("CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'SM' || CAST(p_partkey AS STRING) || '_EU' END"))
    return p.select("p_partkey", F.posexplode(q).alias("place", "query"))


def p_split_price(spark, sf):
    li = read_table(spark, sf, "lineitem")
    whole = F.when(F.col("l_linenumber") < 5, F.concat(F.expr(GROUPED), F.lit(",")))
    frac = F.when(F.col("l_linenumber") < 3, F.expr(CENTS))
    return li.select(*ID, PR.split_price(whole, frac, F.expr(f"{GROUPED} || ',' || {CENTS} || ' €'")).alias("price"))


def p_links(spark, sf):
    d = read_table(spark, sf, "documents")
    quoted = F.concat(F.lit('<a href="x">'), F.substring_index("text", ".", 1), F.lit("</a> & 'co'"))
    return d.select("doc_id", sheet_link(quoted, "Abrir").alias("link"), html_text(quoted).alias("safe"))


def l9_blocked(spark, sf):
    """Anti-bot pages among fetched pages; whole text."""
    p = read_table(spark, sf, "pages")
    title = F.expr("CASE page_id % 9 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'Un momento…' ELSE 'Tienda' END")
    body = F.concat("html", F.expr("CASE page_id % 7 WHEN 0 THEN ' Please verify you are human' ELSE '' END"))
    return p.select("page_id", LS.page_blocked(title, body).alias("blocked"),
                    LS.response_blocked(F.expr("CASE page_id % 5 WHEN 0 THEN 429 ELSE 200 END"), body).alias("refused"))


QUERIES = {
    "p1_to_p8_price_parsers": p_prices,
    "p9_first_and_keyword_price": p_pages,
    "p10_monthly_offer": p_monthly,
    "p11_capacity": p_capacity,
    "p12_stock_state": p_stock,
    "p13_strip_tags": p_tags,
    "p13_model_tokens": p_tokens,
    "p14_flags_numbers": p_flags,
    "p16_search_queries": p_queries,
    "p17_urls": p_urls,
    "p18_colour_storage": p_colours,
    "p19_links_escaping": p_links,
    "p20_spelling_queries": p_spellings,
    "p21_split_price": p_split_price,
    "l9_blocked_pages": l9_blocked,
    "l10_listing_urls": lambda spark, sf: read_table(spark, sf, "pages").select(
        "page_id", "url", LS.is_listing_url(F.col("url")).alias("listing")),
}


def _placed(phrases: str, source: str, order: str = "first") -> str:
    """Phrases of a list without nulls and repeats, numbered in order."""
    return f"""WITH s AS ({source}), u AS (SELECT p_partkey, unnest({phrases}) AS query, generate_subscripts({phrases}, 1) AS nr FROM s),
 d AS (SELECT p_partkey, query, min(nr) AS first FROM u WHERE query IS NOT NULL AND query <> '' GROUP BY ALL)
 SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY {order}) - 1 AS INT) AS place, query FROM d"""


def _squeezed(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


# Brands stand at the beginning of the model; codes are 'NP-<number>', for laptops only.
_SEARCH = _placed(f"list_transform([base, core, base || ' ' || size, core || ' ' || size, base || ' ' || kind, core || ' ' || kind, base || ' ' || size || ' ' || kind, core || ' ' || size || ' ' || kind, sku, p_brand || ' ' || sku,"
                  f" base || ' ' || sku, root, p_brand || ' ' || root, base || ' ' || root], lambda q: {_squeezed('q')})",
                  f"""SELECT p_partkey, p_brand, p_brand || ' ' || tail AS base, {_squeezed("p_brand || ' ' || regexp_replace(lower(tail), '\\b(wifi|wi fi|5g|lte)\\b', ' ', 'g')")} AS core,
  CASE WHEN p_size % 3 <> 0 THEN CAST(p_size * 8 AS VARCHAR) || 'GB' END AS size, CASE p_type WHEN 'LARGE' THEN 'portatil' WHEN 'SMALL' THEN 'tablet' ELSE 'movil' END AS kind,
  CASE WHEN p_type = 'LARGE' THEN 'NP-' || p_partkey END AS sku, CASE WHEN p_type = 'LARGE' THEN 'NP' END AS root
  FROM (SELECT *, p_name || CASE p_partkey % 3 WHEN 0 THEN ' 5G' ELSE ' pro' END AS tail FROM part)""")
# the first phrase, then codes (no blank, a letter and a digit), then the rest
_SPELLING = _placed("list_concat(list_transform(CASE p_partkey % 4 WHEN 0 THEN [p_name || ' 5G', p_name] WHEN 1 THEN [p_name || '+', p_name || ' Plus'] WHEN 2 THEN [p_name || ' Wi Fi', p_name || ' WiFi', p_name || ' Wi-Fi'] ELSE [p_name] END, lambda n: n || size),"
                    " CASE WHEN p_partkey % 5 = 0 THEN [] ELSE ['SM' || p_partkey || '_EU', 'SM' || p_partkey || '/EU', 'SM' || p_partkey] END)",
                    "SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' 2TB' ELSE ' 256GB' END AS size FROM part",
                    "first <> 1, NOT (NOT contains(query, ' ') AND regexp_matches(query, '(?i)[a-z]') AND regexp_matches(query, '\\d')), first")


def _both(t):
    return f"(contains({t}, ',') AND contains({t}, '.'))"


def _dot(t):
    return f"replace({t}, ',', '.')"


def _nodots(t):
    return f"replace({t}, '.', '')"


def _lastsep(t):
    return (f"CASE WHEN strpos(reverse({t}), ',') < strpos(reverse({t}), '.') THEN {_dot(_nodots(t))} "
            f"ELSE replace({t}, ',', '') END")


def _rival(x):
    return (f"CASE WHEN regexp_matches({x}, '\\d\\.\\d{{3}},\\d') THEN {_dot(_nodots(x))} WHEN contains({x}, ',') AND NOT contains({x}, '.') "
            f"THEN {_dot(x)} WHEN {_both(x)} THEN replace({x}, ',', '') ELSE {x} END")


def spanish(x):
    return num(f"replace(replace(replace({x}, ' ', ''), '.', ''), ',', '.')")


AMT = PR.EURO_AMOUNT
_LETTERS = "'(?i)[€$£\\s/meso]+'"
_NAMED = f"""WITH t AS (SELECT {', '.join(ID)}, {PRICE_TEXT} AS text FROM lineitem), u AS (SELECT *,
 replace(replace(replace(replace(trim(text), '€', ''), 'EUR', ''), ' ', ''), 'x', 'x') AS a, replace(trim(text), ' ', '') AS l,
 regexp_replace(trim(text), {_LETTERS}, '', 'g') AS rv, regexp_replace(text, '[^\\d,.]', '', 'g') AS c,
 regexp_replace(CASE WHEN regexp_matches(trim(text), '\\b\\d{{1,3}}(?:\\.\\d{{3}})+(?:,\\d{{1,2}})?\\b')
  THEN replace(trim(text), '.', '') ELSE trim(text) END, {_LETTERS}, '', 'g') AS up FROM t)"""


def _after(words):
    segs = [f"CASE WHEN contains({norm('text')}, '{w}') THEN {spanish('nullif(regexp_extract(substr(text, strpos(' + norm('text') + ', ' + chr(39) + w + chr(39) + '), 500), ' + chr(39) + AMT + '\\s*€' + chr(39) + ', 1), ' + chr(39) + chr(39) + ')')} END"
            for w in words]
    return "coalesce(" + ", ".join(segs) + ")"


def _x(pattern, group=1, src="text"):
    return f"nullif(regexp_extract({src}, '{pattern}', {group}), '')"


MONTH = "(?i)" + AMT + "\\s*(?:€|eur)\\s*/?\\s*mes"
_GBS = "list_transform(regexp_extract_all({t}, '{p}', 1), lambda h: CAST(regexp_extract(h, '^(\\d+)', 1) AS INT) * CASE WHEN lower(h) LIKE '%tb' THEN 1024 ELSE 1 END)"


def _gb(pattern, t="text"):
    return _GBS.replace("{t}", t).replace("{p}", pattern)


_SMALL = _gb("(?i)(\\d{2,4}\\s*(?:gb|tb))\\b")
_ANYCAP = _gb("(?i)(\\d+\\s*(?:gb|tb))")
_STD = f"list_concat(list_transform(regexp_extract_all({norm('text')}, '\\b(64|128|256|512|1024|2048)\\s*gb\\b', 1), lambda v: CAST(v AS INT)), list_transform(regexp_extract_all({norm('text')}, '\\b(1|2|4)\\s*tb\\b', 1), lambda v: CAST(v AS INT) * 1024))"
_TYPED = f"WITH pg AS MATERIALIZED ({PAGES}) "
_PATH = "lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
_QRY = "lower(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1))"
LISTED = f"""(regexp_matches({_PATH}, '/search|/buscar|/buscador|/result|/resultados') OR ({_QRY} <> '' AND
 regexp_matches({_QRY}, 'q=|query=|search=|s=|k=')) OR coalesce(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1], '') IN
 ('apple', 'samsung', 'movil', 'moviles', 'mobile', 'smartphone', 'smartphones', 'tablet', 'tablets', 'laptop', 'laptops')
 OR (len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) <= 3 AND regexp_matches({_PATH},
 '/movil|/moviles|/mobile|/smartphone|/tablet|/tablets') AND NOT regexp_matches({_PATH}, '\\d')))"""
_COL = "CASE " + " ".join(f"WHEN contains(nm, '{c}') THEN '{c.capitalize()}'" for c in LS.COLOURS) + " ELSE '' END"

ORACLE = {
    "p16_search_queries": _SEARCH,
    "p20_spelling_queries": _SPELLING,
    "p1_to_p8_price_parsers": _NAMED + f""" SELECT {', '.join(ID)}, text,
 {num("replace(replace(replace(translate(text, ' €', ''), 'EUR', ''), 'eur', ''), ',', '.')")} AS public,
 {num(_dot('text'))} AS grid, {num(f"CASE WHEN {_both('a')} THEN {_lastsep('a')} ELSE {_dot('a')} END")} AS audit,
 {spanish('text')} AS spanish, {num(f"CASE WHEN {_both('l')} THEN {_lastsep('l')} WHEN contains(l, ',') THEN {_dot(_nodots('l'))} WHEN regexp_full_match(l, chr(92) || 'd+(' || chr(92) || '.' || chr(92) || 'd' || '{{1,2}})?') THEN l ELSE {_nodots('l')} END")} AS loose,
 {r2(num("regexp_replace(" + _rival('rv') + ", '[^\\d.]', '', 'g')"))} AS rival,
 {num(f"CASE WHEN {_both('c')} THEN {_dot(_nodots('c'))} ELSE {_dot('c')} END")} AS catalogue,
 {r2(num("regexp_replace(" + _rival('up') + ", '[^\\d.]', '', 'g')"))} AS upfront,
 replace(regexp_replace(trim(text), ',\\s*[–-]+', ',00', 'g'), '–', '00') AS fragment FROM u""",
    "p9_first_and_keyword_price": _TYPED + f"""SELECT {', '.join(ID)}, {_x(AMT + '\\s*€', 0)} AS first_text, {spanish(_x(AMT + '\\s*€'))} AS first,
 {_after(['al contado', 'contado', 'pago unico'])} AS cash, {_after(['financiacion', 'financiar', 'cuotas'])} AS financed,
 {_after(['renting sin seguro', 'sin seguro'])} AS uninsured, {spanish(_x('(?i)' + AMT + '\\s*(?:€|eur)'))} AS euro_value FROM pg""",
    "p10_monthly_offer": _TYPED + f"""SELECT {', '.join(ID)}, {spanish(_x(MONTH))} AS monthly, CAST(CASE WHEN {_x(MONTH, 0)} IS NOT NULL
 THEN nullif(regexp_extract(substr(text, greatest(strpos(text, {_x(MONTH, 0)}) - 80, 1), strpos(text, {_x(MONTH, 0)}) + length({_x(MONTH, 0)}) + 80
 - greatest(strpos(text, {_x(MONTH, 0)}) - 80, 1)), '(?i)(\\d{{1,2}})\\s*mes(?:es)?', 1), '') END AS INT) AS term FROM pg""",
    "p11_capacity": _TYPED + f"""SELECT {', '.join(ID)}, list_min({_SMALL}) AS smallest, list_max({_ANYCAP}) AS largest, ({_ANYCAP})[-1] AS last,
 list_max({_STD}) AS standard, CASE WHEN p_type = 'LARGE' THEN list_max({_STD}) WHEN list_min({_SMALL}) >= 64 THEN list_min({_SMALL}) END AS for_device,
 regexp_extract(text, '(?i)(\\d+)\\s*(GB|TB)', 1) || upper(regexp_extract(text, '(?i)(\\d+)\\s*(GB|TB)', 2)) AS storage FROM pg""",
    "p12_stock_state": _TYPED + f"""SELECT {', '.join(ID)}, CASE WHEN regexp_matches({norm('text')}, 'agotado|sin stock|no disponible|proximamente') THEN false
 WHEN regexp_matches({norm('text')}, 'en stock|disponible|anadir al carrito|agregar al carrito') THEN true END AS in_stock FROM pg""",
    "p13_strip_tags": "SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM pages",
    "p13_model_tokens": f"""WITH m AS (SELECT p_partkey, {MODEL_EXPR} || CASE p_size % 3 WHEN 0 THEN ' Galaxy S24+' WHEN 1 THEN ' Z Flip6' ELSE ' FE' END AS model FROM part),
 k AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(model), '([a-z])(\\d)', '\\1 \\2', 'g'), '(\\d)([a-z])', '\\1 \\2', 'g'),
 '[^a-z0-9+]+'), lambda t: t <> '') AS tk FROM m) SELECT p_partkey, array_to_string(tk, ' ') AS tokens, array_to_string(list_sort(list_distinct(list_concat(
 list_filter(['ultra', 'plus', 'fe', 'flip', 'fold', 'edge', 'lite'], lambda v: list_contains(tk, v)),
 CASE WHEN regexp_matches(lower(model), '\\b(?:s|a|z)\\d{{1,3}}\\+') THEN ['plus'] ELSE [] END))), ',') AS markers FROM k""",
    "p14_flags_numbers": f"""WITH t AS (SELECT {', '.join(ID)}, {FLAG} AS f, {INTS} AS n FROM lineitem) SELECT {', '.join(ID)},
 CASE WHEN lower(trim(f)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(f)) IN ('false', '0', 'no', 'n') THEN false END AS grid_bool,
 CASE WHEN {norm('f')} IN ('true', '1', 'yes', 'y', 'si', 's') THEN true WHEN {norm('f')} IN ('false', '0', 'no', 'n') THEN false END AS public_bool,
 CASE WHEN lower(f) IN ('true', '1', 'yes', 'si') THEN true WHEN lower(f) IN ('false', '0', 'no') THEN false END AS page_bool,
 CAST(trunc({num('n')}) AS INT) AS whole, {num('n')} AS number FROM t""",
    "p17_urls": f"""WITH w AS (SELECT page_id, {URL} AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '(?i)(?:/dp/|/gp/product/)[A-Z0-9]{{10}}')
 THEN 'https://www.amazon.es/dp/' || upper(regexp_extract(u, '(?i)(?:/dp/|/gp/product/)([A-Z0-9]{{10}})', 1)) ELSE u END AS canonical,
 CASE WHEN contains(u, 'amazon.') THEN nullif(upper(regexp_extract(u, '(?i)(?:/dp/|/gp/product/)([A-Z0-9]{{10}})', 1)), '') END AS code,
 string_split(u, '#')[1] AS bare, {LISTED} AS listing, nullif(upper(regexp_extract(u, 'model[Cc]ode=([^&#]+)', 1)), '') AS model_code,
 CASE WHEN contains({_PATH}, '/buy/') THEN regexp_extract(u, '^([^?#]*)', 1) || '?modelCode=SM-X1' ELSE u END AS addressed FROM w""",
    "p18_colour_storage": f"""WITH t AS (SELECT p_partkey, lower(p_name || ' Titanium ') AS nm, p_size FROM part) SELECT p_partkey, {_COL} AS colour,
 p_size || 'GB' AS storage FROM t""",
    "p19_links_escaping": """WITH t AS (SELECT doc_id, '<a href="x">' || string_split(text, '.')[1] || '</a> & ''co''' AS q FROM documents)
 SELECT doc_id, '=HYPERLINK("' || replace(q, '"', '""') || '","Abrir")' AS link, replace(replace(replace(replace(replace(q, '&', '&amp;'),
 '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM t""",
    "p21_split_price": f"""SELECT {', '.join(ID)}, CASE WHEN l_linenumber < 3 THEN l_extendedprice WHEN l_linenumber < 5
 THEN floor(l_extendedprice) ELSE l_extendedprice END AS price FROM lineitem""",
    "l9_blocked_pages": f"""SELECT page_id, page_id % 9 < 2 OR page_id % 7 = 0 OR regexp_matches({norm('html')}, 'cf-browser-verification|captcha|datadome')
 AS blocked, page_id % 5 = 0 OR regexp_matches(lower(html), 'captcha|robot check|temporarily unavailable') AS refused FROM pages""",
    "l10_listing_urls": f"WITH w AS (SELECT page_id, url, url AS u FROM pages) SELECT page_id, url, {LISTED} AS listing FROM w",
}
