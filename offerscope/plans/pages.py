"""Queries that extract offers from page texts and payloads derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import to_double
from offerscope.functions.text import normalize_text
from offerscope.operators import extract as E
from offerscope.operators import payloads as J
from offerscope.plans.sqltext import norm, num, r2
from offerscope.plans.texts import AMT, CENTS, GROUPED, WHOLE, spanish
from offerscope.sources.tables import CAPACITY_EXPR, DEVICE_EXPR, MODEL_EXPR, read_table, spread

K = "CAST(p_partkey AS STRING)"
S = "CAST({} AS STRING)"
SIZE = "CAST((p_size + {}) AS STRING)"

GROUP_JSON = f"""'{{"code":"SM-A' || {K} || '","stock":{{"stockLevelStatus":"' || CASE p_partkey % 3 WHEN 0 THEN 'outOfStock'
 ELSE 'inStock' END || '"}},"priceGroups":[{{"groupId":"renting","prices":[{{"value":' || {SIZE.format(30)} || '.5,"installments":36,
"paymentMode":"Renting","insuranceTypeData":{{"title":"Con Seguro"}}}},{{"value":' || {SIZE.format(20)} || '.25,"installments":24,
"paymentMode":"renting"}},{{"value":999,"installments":12,"paymentMode":"renting"}}]}},{{"groupId":"creditCard","prices":[{{"value":'
 || CAST(p_retailprice AS STRING) || ',"installments":0,"paymentMode":"creditCard"}},{{"value":' || {SIZE.format(40)} ||
 ',"installments":20,"paymentMode":"credit card"}}]}}]}}'""".replace("\n", " ")
RENT_JSON = f"""CASE p_partkey % 4 WHEN 0 THEN '{{"rentalPlans":[],"cheapestRentalPlan":{{"priceInCents":1999,"durationMonths":0}}}}'
 ELSE '{{"rentalPlans":[{{"priceInCents":' || {S.format('(p_size * 100 + 99)')} || ',"durationMonths":12}},{{"priceInCents":0,
 "durationMonths":6}}]}}' END"""
PLAN_JSON = f"""'{{"data":{{"installmentCalculations":{{"installments":[{{"duration":12,"monthlyRate":' || {SIZE.format(1)} ||
 '.5}},{{"duration":12,"monthlyRate":' || {SIZE.format(1)} || '.5}},{{"duration":0,"monthlyRate":1}},{{"duration":24,"monthlyRate":'
 || {SIZE.format(2)} || '.25}}]}}}}}}'"""
LD_HTML = """html || '<script type="application/ld+json">{"name":"Galaxy","hasVariant":[{"sku":"SM-S' || CAST(page_id AS STRING) ||
 '","name":"Galaxy 128GB","offers":{"price":"1.299,50","url":"/a","availability":"https://schema.org/InStock"}},{"sku":"SM-T1",
 "name":"Galaxy","additionalProperty":[{"value":"1TB"}],"offers":{"price":"' || CAST(page_id + 100 AS STRING) || '","url":"/b",
 "availability":"OutOfStock"}}]}</script><script type="application/ld+json">{"name":"Funda","sku":"F1","offers":{"price":""}}</script>'""".replace("\n", " ")
CARD_JSON = f"""'{{"offers":{{"256 GB":{{"negro":{{"name":"sin tarjetas"}},"azul":{{"name":"Galaxy ' || {K} || '","cards":{{"cardFree":
[{{"name":"Galaxy","currentPrice":' || CAST(p_retailprice AS STRING) || ',"stock":1}}],"cardR2R":[{{"pvp_fusion_mv":0,"pvp_fusion_av":'
 || {SIZE.format(10)} || '.5,"monthlyPayment36":' || CASE p_partkey % 2 WHEN 0 THEN '-1' ELSE '20' END || ',"quotaMonths":18}}]}}}}}},
"1TB":{{"rojo":{{"name":"vacio"}}}}}}}}'""".replace("\n", " ")
OPTION_JSON = f"""'{{"code":"sm-a' || {K} || '","baseOptions":[{{"options":[{{"code":"SM-A' || {K} || '","name":"x",
"variantOptionQualifiers":[{{"qualifier":"color","value":"azul"}},{{"qualifier":"storage","value":"' || CASE p_partkey % 3 WHEN 0
 THEN '128 GB' ELSE '512GB' END || '"}}]}},{{"code":"ZZ' || {K} || '","name":"Galaxy 1 TB","variantOptionQualifiers":[]}},{{"code":"YY",
"name":"x","variantOptionQualifiers":[{{"qualifier":"storage","value":"128 GB"}}]}}]}}]}}'""".replace("\n", " ")
SELECT_JSON = f"""'{{"products":[{{"familyType":"iphone17promax","dimensionCapacity":"256gb","fullPrice":"a"}},{{"familyType":
"iphone17promax","dimensionCapacity":"256GB","fullPrice":"b"}},{{"familyType":"iphoneair","dimensionCapacity":"1tb","fullPrice":"c"}},
{{"familyType":"","dimensionCapacity":"1tb","fullPrice":"c"}}],"displayValues":{{"prices":{{"a":{{"currentPrice":{{"raw_amount":"'
 || CAST(p_retailprice AS STRING) || '"}}}},"b":{{"amountBeforeTradeIn":"' || {SIZE.format(880)} || '"}},"c":{{"currentPrice":
{{"raw_amount":"1500.5"}}}}}}}}}}'""".replace("\n", " ")
# the same inside a page, after a note whose string holds braces and quotes
SELECT_HTML = f"""'<html><script>var other = {{"a":1}}; window.BOOTSTRAP = {{ productSelectionData: {{"note":"a }} brace, {{ and \\\\"quotes\\\\"",' || substr({SELECT_JSON}, 2)
 || ', done: 1 }};</script>' || CASE WHEN p_partkey % 2 = 0 THEN '<script>productSelectionData: {{"products":[]}}</script>' ELSE '' END""".replace("\n", " ")
LIST_JSON = f"""CASE p_partkey % 3 WHEN 0 THEN '{{"products":[],"a":[{{"id":1}}],"b":{{"c":{{"d":{{"e":{{"f":{{"data":{{"list":[{{"name":"A","price":"'
 || CAST(p_retailprice AS STRING) || '"}}]}}}}}}}}}}}}}}'
 WHEN 1 THEN '{{"data":{{"results":{{"items":[{{"modelName":"B","modelCode":"M1","price":"10,5"}},{{"name":"C","price":"20"}}]}}}}}}'
 ELSE '{{"empty":true}}' END"""

RETAILER = """CASE l_suppkey % 7 WHEN 0 THEN 'Media Markt' WHEN 1 THEN 'Rentik' WHEN 2 THEN 'Grover' WHEN 3 THEN 'PcComponentes'
 WHEN 4 THEN 'Movistar' WHEN 5 THEN 'Fnac' ELSE 'Samsung Oficial' END"""
TEXT = f"""'Ficha del producto. ' || CASE l_linenumber
 WHEN 1 THEN 'Precio ' || {GROUPED} || ',' || {CENTS} || ' €. En 12 cuotas de 45,50 € mensual'
 WHEN 2 THEN 'Tu Rentik desde 29,99 €/mes x 24 meses. Sin seguro 19,9 €'
 WHEN 3 THEN 'Compra libre por 12,50 €/mes x 36 meses ' || {WHOLE} || ' € comprar. Añádelo a tu pack 12,5 €/mes x 36 meses'
 WHEN 4 THEN '60 € hoy y 30,25 €/mes en 18 plazos. Financiado desde 9,99 €/mes'
 WHEN 5 THEN 'Financiación Cetelem en 10 meses por 55 €/mes. PVP recomendado ' || {GROUPED} || ' €'
 WHEN 6 THEN '64 GB desde ' || {WHOLE} || ' €/mes durante 24 meses o ' || {GROUPED} || ' €. 256GB ' || {WHOLE} || ',99 €'
 ELSE 'Sin Grover Care 15 €, al contado ' || {GROUPED} || ',' || {CENTS} || ' eur' END"""
PAGE_ID = """CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
 || CAST(l_suppkey AS STRING) || '-' || CAST(l_extendedprice AS STRING)"""
# Pages are identified by retailer and text here: identical pages hold identical offers.


def parts(spark, sf, payload):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.expr(payload).alias("payload"))


def texts(spark, sf):
    li = spread(read_table(spark, sf, "lineitem"))
    rows = li.select(F.expr(RETAILER).alias("retailer"), F.expr(TEXT).alias("text"))
    return rows.distinct().withColumn("page_id", F.md5(F.concat_ws("|", "retailer", "text")))


TEXTS = f"WITH p AS MATERIALIZED (SELECT DISTINCT {RETAILER} AS retailer, {TEXT} AS text FROM lineitem), pg AS MATERIALIZED (SELECT *, md5(retailer || '|' || text) AS page_id, {norm('text')} AS f FROM p)"


def _x(pattern, group, src):
    return f"nullif(regexp_extract({src}, '{pattern}', {group}), '')"


def _loose(x):
    """Only plain, comma or two-digit-dot amounts occur in these patterns."""
    return num(f"replace({x}, ',', '.')")


_EUR = "\\s*(?:€|eur)"
_ANY = "(?i)(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)"
_MONTHLY = _ANY + "\\s*/?\\s*mes"
_SOLID = "(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*€"
_MONTHS = "(?i)(\\d{1,2})\\s*mes(?:es)?"
_PART = "(\\d{1,4}(?:[.,]\\d{1,2})?)"


def _behind(word, size):
    return f"CASE WHEN contains(f, '{word}') THEN substr(text, strpos(f, '{word}'), {size}) END"


def _around(word):
    at = f"strpos(f, '{word}')"
    return _x(_MONTHS, 1, f"CASE WHEN {at} > 0 THEN substr(text, greatest({at} - 80, 1), {at} + 180 - greatest({at} - 80, 1)) END")


def e2_sql() -> str:
    """Every retailer's wordings written out; within a slot the first that gives a price counts."""
    pack = lambda word: (_x("(?i)(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)\\s*/\\s*mes", 1, _behind(word, 420)),
                         f"coalesce({_x('(?i)x\\s*(\\d{1,2})\\s*mes(?:es)?', 1, _behind(word, 420))}, {_x(_MONTHS, 1, _behind(word, 420))})")
    months = _x(_MONTHS, 1, "text")
    rentik = f"coalesce({_around('renting')}, {_around('meses')})"
    plan, cash, rent, bare = "financing_max_term", "cash", "renting_with_insurance", "renting_no_insurance"
    instalments = "(?i)en\\s*(\\d{1,2})\\s*cuotas[^\\d]{0,40}(\\d{1,5}(?:[.,]\\d{1,2})?)\\s*(?:€|eur)\\s*(?:mensual|mes)"
    financed = "(?i)(?:financi(?:a|acion)|cuotas?)[^\\d]{0,80}(\\d{1,2})\\s*(?:cuotas?|mes(?:es)?)[^\\d]{0,40}(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)"
    bought = "(?i)(?:compr(?:a|alo|arlo)|quedatelo|al contado|precio de compra)[^\\d]{0,120}(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)"
    today, monthly_parts = f"(?i){_PART}\\s*€\\s*hoy\\s*y\\s*{_PART}\\s*€\\s*/\\s*mes\\s*en\\s*(\\d{{1,2}})\\s*plazos", f"(?i){_PART}\\s*€\\s*/\\s*mes\\s*en\\s*(\\d{{1,2}})\\s*plazos"
    cetelem = "(?i)(?:financi(?:a|acion)|cuotas?|cetelem)[^\\d]{0,80}(\\d{1,2})\\s*(?:mes(?:es)?|cuotas?)[^\\d]{0,60}(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)\\s*/?\\s*mes"
    during = "(?i)(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)\\s*/?\\s*mes[^\\d]{0,80}(?:x|durante|en)\\s*(\\d{1,2})\\s*(?:mes(?:es)?|cuotas?)"
    outright = "(?i)(?:\\bo\\b|\\bcontado\\b|\\bal contado\\b)[^\\d]{0,20}(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)"
    listed = "(?i)(?:\\bpvp\\b|\\bpvpr\\b|precio\\s+(?:de\\s+venta\\s+al\\s+publico\\s+)?recomendado)[^\\d]{0,35}(\\d{1,5}(?:[.\\s]\\d{3})*(?:,\\d{1,2})?)\\s*(?:€|eur)"
    # retailer, slot, kind, price as text, term as text, least price, whether a lone dot is a decimal mark
    wordings = [
        ("Media Markt", 1, cash, _x(_ANY, 1, "text"), "NULL", 100, False), ("Media Markt", 2, plan, _x(instalments, 2, "text"), _x(instalments, 1, "text"), 0, False),
        ("Rentik", 1, rent, _x(_MONTHLY, 1, _behind("tu rentik desde", 260)), rentik, 0, False), ("Rentik", 1, rent, _x(_MONTHLY, 1, "text"), rentik, 0, False),
        ("Rentik", 2, bare, _x(_SOLID, 1, _behind("sin seguro", 500)), "NULL", 0, False),
        ("Grover", 1, rent, _x(_MONTHLY, 1, "text"), months, 0, False), ("Grover", 2, plan, _x(financed, 2, "text"), _x(financed, 1, "text"), 0, False), ("Grover", 3, cash, _x(bought, 1, "text"), "NULL", 0, False),
        ("Grover", 4, bare, _x(_SOLID, 1, _behind("sin grover care", 500)), "NULL", 0, False), ("Grover", 4, bare, _x(_SOLID, 1, _behind("sin seguro", 500)), "NULL", 0, False),
        ("PcComponentes", 1, plan, _x(today, 2, "text"), _x(today, 3, "text"), 0, True), ("PcComponentes", 1, plan, _x(monthly_parts, 1, "text"), _x(monthly_parts, 2, "text"), 0, True),
        ("PcComponentes", 1, plan, _x(f"(?i)financiado\\s+desde\\s+{_PART}\\s*€\\s*/\\s*mes", 1, "text"), "NULL", 0, True),
        ("Movistar", 1, plan, *pack("anadelo a tu pack"), 0, False), ("Movistar", 1, plan, *pack("con tu pack desde"), 0, False),
        ("Fnac", 1, plan, _x(cetelem, 2, "text"), _x(cetelem, 1, "text"), 0, False), ("Fnac", 1, plan, _x(during, 1, "text"), _x(during, 2, "text"), 0, False), ("Fnac", 2, cash, _x(_ANY, 1, "text"), "NULL", 0, False),
        ("Samsung Oficial", 1, plan, _x(_MONTHLY, 1, "text"), f"coalesce({months}, '36')", 0, False), ("Samsung Oficial", 2, cash, _x(outright, 1, "text"), "NULL", 0, False), ("Samsung Oficial", 2, cash, _x(listed, 1, "text"), "NULL", 100, False),
    ]
    hits = " UNION ALL ".join(
        f"SELECT page_id, retailer, '{kind}' AS offer_type, {_loose(price) if loose else spanish(price)} AS price, CAST({term} AS INT) AS term_months, {least} AS least, {slot} AS slot, {rank} AS rank FROM pg WHERE retailer = '{shop}'"
        for rank, (shop, slot, kind, price, term, least, loose) in enumerate(wordings))
    return TEXTS + f""", hits AS ({hits}), ok AS (SELECT * FROM hits WHERE price > 0 AND price >= least QUALIFY row_number() OVER (PARTITION BY page_id, slot ORDER BY rank) = 1)
 SELECT DISTINCT page_id, retailer, offer_type, price, term_months, CASE WHEN offer_type = 'cash' THEN 'EUR' ELSE 'EUR/month' END AS price_unit FROM ok"""


TEASER = f"""'Ficha  En 9 cuotas 1 € Mensual ' || CASE l_linenumber WHEN 1 THEN 'Financiación 0% En 12 cuotas ' || {WHOLE} || ',– € Mensual Simula tu financiación' WHEN 2 THEN 'Financiacion En  24
 cuotas de ' || {WHOLE} || ',50 eur mensual Puntos miMediaMarkt' WHEN 3 THEN 'Financiación sin cuotas. Color (por fabricante) negro' WHEN 4 THEN 'En 18 cuotas ' || {WHOLE} || ',-- € Mensual' ELSE 'sin plan' END"""


def e2_teaser(spark, sf):
    rows = spread(read_table(spark, sf, "lineitem")).select(F.expr(TEASER).alias("text")).distinct()
    return E.teaser_offers(rows.withColumn("page_id", F.md5("text")))


def e2_teaser_sql() -> str:
    section = "(?i)Financiaci[oó]n(.*?)(?:Simula tu financiaci[oó]n|Puntos miMediaMarkt|Color \\(por fabricante\\)|Seleccione una oferta)"
    price = "regexp_extract(b, '(?i)(\\d{1,5}(?:[.,][\\d–-]{1,2})?)\\s*(?:€|eur)\\s*Mensual', 1)"
    value = f"replace(regexp_replace({price}, ',\\s*[–-]+', ',00', 'g'), '–', '00')"
    return f"""WITH t AS (SELECT DISTINCT {TEASER} AS text FROM lineitem), p AS (SELECT md5(text) AS page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM t),
 s AS (SELECT page_id, coalesce(nullif(regexp_extract(plain, '{section}', 1), ''), plain) AS b FROM p),
 o AS (SELECT page_id, 'financing_max_term' AS offer_type, {spanish(value)} AS price, CAST(nullif(regexp_extract(b, '(?i)En\\s+(\\d{{1,2}})\\s+cuotas', 1), '') AS INT) AS term_months FROM s)
 SELECT * FROM o WHERE price IS NOT NULL AND term_months IS NOT NULL"""


def _near(word):
    return spanish(_x(AMT + "\\s*€", 1, f"CASE WHEN contains(f, '{word}') THEN substr(text, strpos(f, '{word}'), 500) END"))


def e1_sql() -> str:
    words = {"renting_no_insurance": ["renting sin seguro", "sin seguro"], "renting_with_insurance": ["renting con seguro", "con seguro"],
             "financing_max_term": ["financiacion", "financiar", "cuotas"], "cash": ["al contado", "contado", "pago unico"]}
    cols = ", ".join(f"coalesce({', '.join(_near(w) for w in ws)}) AS {k}" for k, ws in words.items())
    kinds = " UNION ALL ".join(
        f"SELECT page_id, '{k}' AS offer_type, {k} AS price, CAST({36 if k == 'financing_max_term' else 'NULL'} AS INT) AS term_months FROM h WHERE {k} IS NOT NULL"
        for k in words)
    return TEXTS + f""", h AS MATERIALIZED (SELECT page_id, {cols}, {spanish(_x(AMT + chr(92) + 's*€', 1, 'text'))} AS lone FROM pg) {kinds}
 UNION ALL SELECT page_id, 'cash', lone, CAST(NULL AS INT) FROM h WHERE coalesce({', '.join(words)}) IS NULL AND lone IS NOT NULL"""


def e4(spark, sf):
    t = F.col("text")
    return texts(spark, sf).select("page_id", E.largest_price(t).alias("largest"),
                                   E.free_purchase_price(t, normalize_text(t)).alias("outright"))


def seeds(spark, sf):
    """The product that a page was looked up for: the first of those whose page reads the same."""
    li, p = spread(read_table(spark, sf, "lineitem")), read_table(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.md5(F.concat_ws("|", F.expr(RETAILER), F.expr(TEXT))).alias("page_id"), F.struct(
            "p_partkey", F.col("p_brand").alias("brand"), F.expr(DEVICE_EXPR).alias("device_type"), F.expr(MODEL_EXPR).alias("model"), F.expr(f"CAST({CAPACITY_EXPR} AS INT)").alias("capacity_gb")).alias("s"))
    return rows.groupBy("page_id").agg(F.min("s").alias("s")).select("page_id", "s.brand", "s.device_type", "s.model", "s.capacity_gb")


def e11(spark, sf):
    found = E.extract_offers(texts(spark, sf)).drop("price_unit").withColumns(
        {"tier": F.when(F.col("retailer") == "Fnac", "json_live").otherwise("dom"), "capture_kind": F.lit("")})
    return E.to_records(found, seeds(spark, sf)).withColumn("price_value", F.col("price_value").cast("double"))


def e11_sql() -> str:
    return f"""SELECT 'ES' AS country, o.retailer, s.p_brand AS product_family, s.p_brand AS brand, s.device AS device_type, s.model, s.capacity_gb, o.offer_type, o.price AS price_value,
 printf('%.2f', o.price) || ' EUR' AS price_text, o.price_unit, o.term_months, CASE WHEN o.retailer = 'Fnac' THEN 'json_live' ELSE 'dom' END AS data_quality_tier,
 CASE WHEN o.retailer IN ('Movistar', 'Fnac') THEN 'embedded_json_exact' WHEN o.retailer = 'Media Markt' AND o.offer_type = 'financing_max_term' THEN 'api_exact' ELSE 'visible_dom' END AS price_capture_kind
 FROM ({e2_sql()}) o JOIN (SELECT md5({RETAILER} || '|' || {TEXT}) AS page_id, p_brand, {DEVICE_EXPR} AS device, {MODEL_EXPR} AS model, CAST({CAPACITY_EXPR} AS INT) AS capacity_gb
  FROM lineitem JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY md5({RETAILER} || '|' || {TEXT}) ORDER BY p_partkey) = 1) s USING (page_id)"""


def e4_sql() -> str:
    value = "(?i)" + E.EURO_AMOUNT + "\\s*(?:€|eur)"
    amounts = lambda x: f"list_transform(regexp_extract_all({x}, '{value}', 1), lambda a: {spanish('a')})"
    blocks = []
    for word in ("compralo libre", "compra libre", "libre"):
        block = f"regexp_replace(CASE WHEN contains(f, '{word}') THEN substr(text, strpos(f, '{word}'), 520) END, '(?is)(?:\\bcomprar\\b|\\beres cliente\\b|caracter[ií]sticas principales).*$', '')"
        once = f"regexp_replace({block}, '{E.MONTHLY_SUFFIX}', ' ', 'g')"
        found = amounts(once)
        blocks.append(f"CASE WHEN list_extract({found}, -1) >= 100 THEN list_extract({found}, -1) ELSE coalesce(list_extract(list_filter({found}, lambda v: v >= 100), -1), list_extract({found}, -1)) END")
    return TEXTS + f""" SELECT page_id, CASE WHEN list_max({amounts('text')}) >= 100 THEN list_max({amounts('text')}) END AS largest, coalesce({', '.join(blocks)}) AS outright FROM pg"""


def e6(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", F.expr(LD_HTML).alias("html"))
    return J.linked_data(pages)


def f13(spark, sf):
    targets = read_table(spark, sf, "pages").select(
        "page_id", F.expr("CASE page_id % 2 WHEN 0 THEN 'SM-T1' END").alias("t_code"),
        F.expr("CASE page_id % 3 WHEN 0 THEN 128 WHEN 1 THEN 1024 END").alias("t_capacity"))
    return J.best_variant(e6(spark, sf), targets).select("page_id", "sku", "price", "score")


def e13(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_retailprice").alias("cash_price"),
                                             F.expr("CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_size * 0.5 END").cast("double").alias("rate"))
    return J.financing_schedule(p).select("page_id", "term_months", "price")


def e14(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.lit("cash").alias("offer_type"),
                                             F.col("p_retailprice").alias("price"), F.lit(None).cast("int").alias("term_months"))
    return J.free_financing(p)


def e16(spark, sf):
    p = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.array(F.lit("256"), F.lit("1"), F.lit("256"), F.lit("2 TB")).alias("sizes"),
        F.array(F.concat(F.col("p_size").cast("string"), F.lit(",5 €")), F.lit("1.299,00 €"), F.lit("7 €")).alias("prices"))
    return J.positional_pairs(p)


def e17(spark, sf):
    rows = J.product_lists(parts(spark, sf, LIST_JSON))
    spare = parts(spark, sf, LIST_JSON).select("page_id", F.lit(0).alias("place"), F.lit("fallback").alias("name"),
                                               F.lit(None).cast("string").alias("code"), F.lit(1.0).alias("price"), F.lit(2).alias("strategy"))
    return J.first_strategy(rows.withColumn("strategy", F.lit(1)).unionByName(spare))


def e18(spark, sf):
    p = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.array(F.concat(F.lit("256GB@/content/"), F.expr(K)), F.lit("1 TB@/x/y"), F.lit("sin slug"), F.lit("256 GB@/b/last ")).alias("tags"))
    return J.capacity_slugs(p)


def e8(spark, sf):
    p = read_table(spark, sf, "part")
    titles = F.array(F.expr("'Financiación sin intereses ' || CAST(p_size AS STRING) || ' meses'"), F.lit("financiado sin intereses en 12 meses"), F.lit("Oferta 90 meses"))
    return p.select("p_partkey", J.promo_term(titles).alias("promo"), J.rent_term(F.expr("CASE p_size % 2 WHEN 0 THEN CAST(p_size AS STRING) || ' meses' ELSE '' END")).alias("rent"),
                    J.stock_count(F.expr("CASE p_size % 3 WHEN 0 THEN 'x' ELSE CAST(p_size AS STRING) || '.0' END")).alias("stock"))


def e10(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", E.plausible_uninsured(
        F.expr("CASE p_type WHEN 'LARGE' THEN 'laptop' ELSE 'mobile' END"), F.expr("CASE p_size % 5 WHEN 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END"),
        F.expr("CASE p_size % 3 WHEN 0 THEN NULL ELSE 30.0D END")).alias("accepted"))


QUERIES = {
    "e1_keyword_offers": lambda spark, sf: E.keyword_offers(texts(spark, sf)),
    "e2_rule_offers": lambda spark, sf: E.extract_offers(texts(spark, sf)),
    "e2_teaser": e2_teaser,
    "e2_uninsured": lambda spark, sf: E.extract_offers(texts(spark, sf).withColumn("retailer", F.lit("")), E.BASE_RULES).drop("retailer"),
    "e3_capacity_offers": lambda spark, sf: E.capacity_offers(texts(spark, sf)),
    "e4_full_prices": e4,
    "e5_price_groups": lambda spark, sf: J.price_groups(parts(spark, sf, GROUP_JSON)),
    "e6_linked_data": e6,
    "e7_rental_plans": lambda spark, sf: J.rental_plans(parts(spark, sf, RENT_JSON)),
    "e7_instalments": lambda spark, sf: J.instalment_list(parts(spark, sf, PLAN_JSON)),
    "e8_terms": e8,
    "e9_storage_variants": lambda spark, sf: J.storage_variants(parts(spark, sf, OPTION_JSON)),
    "e9_variant_capacities": lambda spark, sf: J.variant_capacities(parts(spark, sf, OPTION_JSON)).select("page_id", "token", "capacity_gb"),
    "e10_uninsured_plausible": e10,
    "e11_records": e11,
    "e12_selection_prices": lambda spark, sf: J.selection_prices(J.objects_in_html(parts(spark, sf, SELECT_HTML).withColumnRenamed("payload", "html"))).withColumn("name", J.family_name(F.col("family"))),
    "e13_financing_schedule": e13,
    "e14_free_financing": e14,
    "e15_capacity_cards": lambda spark, sf: J.capacity_cards(parts(spark, sf, CARD_JSON)),
    "e16_positional_pairs": e16,
    "e17_first_strategy": e17,
    "e18_capacity_slugs": e18,
    "a28_cheapest_by_mode": lambda spark, sf: J.cheapest_by_mode(parts(spark, sf, GROUP_JSON)),
    "f13_best_variant": f13,
    "h10_capacity_for_code": lambda spark, sf: J.capacity_for_code(J.variant_capacities(parts(spark, sf, OPTION_JSON))),
}


def _union(*rows, table="part"):
    return " UNION ALL ".join(f"SELECT {r} FROM {table}" for r in rows)


_SZ = "CAST(p_size AS DOUBLE)"
_RATE = "CASE WHEN p_partkey % 3 = 0 THEN 18.95::DOUBLE ELSE p_size * 0.5::DOUBLE END"
_E4 = f"list_transform(regexp_extract_all(text, '{E.EURO_VALUE}', 1), lambda v: {spanish('v')})"

ORACLE = {
    "e1_keyword_offers": e1_sql(),
    "e4_full_prices": e4_sql(),
    "e11_records": e11_sql(),
    "e2_teaser": e2_teaser_sql(),
    "e2_rule_offers": e2_sql(),
    "e2_uninsured": TEXTS + f""" SELECT page_id, 'renting_no_insurance' AS offer_type, {spanish(_x(E.UNINSURED, 1, 'text'))} AS price, 36 AS term_months,
 'EUR/month' AS price_unit FROM (SELECT DISTINCT page_id, text FROM pg) WHERE {spanish(_x(E.UNINSURED, 1, 'text'))} > 0""",
    "e3_capacity_offers": f"""WITH w AS (SELECT DISTINCT md5({RETAILER} || '|' || {TEXT}) AS page_id, CAST(CAST({WHOLE} AS BIGINT) % 100000 AS DOUBLE) AS w, CAST(replace({GROUPED}, '.', '') AS DOUBLE) AS g
 FROM lineitem WHERE l_linenumber = 6) SELECT page_id, 64 AS capacity_gb, 'financing_max_term' AS offer_type, w AS price, 36 AS term_months FROM w
 UNION ALL SELECT page_id, 64, 'cash', g, NULL FROM w UNION ALL SELECT page_id, 256, 'cash', w + 0.99, NULL FROM w""",
    "e5_price_groups": _union(
        f"p_partkey AS page_id, 'renting_no_insurance' AS offer_type, {_SZ} + 20.25 AS price, 24 AS term_months, p_partkey % 3 <> 0 AS in_stock",
        f"p_partkey, 'renting_with_insurance', {_SZ} + 30.5, 36, p_partkey % 3 <> 0", "p_partkey, 'cash', p_retailprice, NULL, p_partkey % 3 <> 0",
        f"p_partkey, 'financing_max_term', {_SZ} + 40, 20, p_partkey % 3 <> 0"),
    "e6_linked_data": _union(
        "page_id, 0 AS block, 0 AS place, 'SM-S' || page_id AS sku, 'Galaxy 128GB' AS name, 128 AS capacity_gb, 1299.5::DOUBLE AS price, '/a' AS url, true AS in_stock",
        "page_id, 0, 1, 'SM-T1', 'Galaxy', 1024, CAST(page_id + 100 AS DOUBLE), '/b', false", table="pages"),
    "e7_rental_plans": """SELECT p_partkey AS page_id, 'renting_with_insurance' AS offer_type, CASE WHEN p_partkey % 4 = 0 THEN 19.99 ELSE (p_size * 100 + 99) / 100.0::DOUBLE END
 AS price, CASE WHEN p_partkey % 4 <> 0 THEN 12 END AS term_months FROM part""",
    "e7_instalments": _union(f"p_partkey AS page_id, 'financing_max_term' AS offer_type, {_SZ} + 1.5 AS price, 12 AS term_months",
                             f"p_partkey, 'financing_max_term', {_SZ} + 2.25, 24"),
    "e8_terms": """SELECT p_partkey, greatest(p_size, 12) AS promo, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 24 END AS rent,
 CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS stock FROM part""",
    "e9_storage_variants": """SELECT p_partkey AS page_id, '128 GB' AS storage, CASE WHEN p_partkey % 3 = 0 THEN 'SM-A' || p_partkey ELSE 'YY' END AS code FROM part
 UNION ALL SELECT p_partkey, '512GB', 'SM-A' || p_partkey FROM part WHERE p_partkey % 3 <> 0""",
    "e9_variant_capacities": _union("p_partkey AS page_id, 'SMA' || p_partkey AS token, CASE WHEN p_partkey % 3 = 0 THEN 128 ELSE 512 END AS capacity_gb",
                                    "p_partkey, 'ZZ' || p_partkey, 1024", "p_partkey, 'YY', 128"),
    "e10_uninsured_plausible": """SELECT p_partkey, p_type <> 'LARGE' AND p_size % 5 <> 0 AND (p_size % 3 = 0 OR p_size BETWEEN 18 AND 30) AS accepted FROM part""",
    "e12_selection_prices": _union("p_partkey AS page_id, 'iphone17promax' AS family, 256 AS capacity_gb, least(p_retailprice, p_size + 880.0) AS price, 'iphone 17 pro max' AS name",
                                   "p_partkey, 'iphoneair', 1024, 1500.5, 'iphone air'"),
    "e13_financing_schedule": f"""SELECT p_partkey AS page_id, t AS term_months, {r2(f"p_retailprice * (({_RATE}) / 1200.0::DOUBLE) * pow(1.0::DOUBLE + ({_RATE}) / 1200.0::DOUBLE, t) / (pow(1.0::DOUBLE + ({_RATE}) / 1200.0::DOUBLE, t) - 1.0::DOUBLE)")} AS price
 FROM part CROSS JOIN (SELECT unnest([3, 6, 10, 12, 14, 18, 20, 24, 30]) AS t)""",
    "e14_free_financing": _union("p_partkey AS page_id, 'cash' AS offer_type, p_retailprice AS price, NULL::INT AS term_months",
                                 f"p_partkey, 'financing_max_term', {r2('p_retailprice / 36.0::DOUBLE')}, 36"),
    "e15_capacity_cards": _union("p_partkey AS page_id, 256 AS capacity_gb, 'Galaxy ' || p_partkey AS name, 'cash' AS offer_type, p_retailprice AS price, NULL::INT AS term_months",
                                 f"p_partkey, 256, 'Galaxy ' || p_partkey, 'renting_no_insurance', {_SZ} + 10.5, CASE WHEN p_partkey % 2 = 0 THEN 18 ELSE 36 END"),
    "e16_positional_pairs": _union("p_partkey AS page_id, 256 AS capacity_gb, p_size + 0.5::DOUBLE AS price", "p_partkey, 1024, 1299.0::DOUBLE"),
    "e17_first_strategy": """SELECT p_partkey AS page_id, 0 AS place, 'A' AS name, NULL AS code, p_retailprice AS price, 1 AS strategy FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey, 0, 'B', 'M1', 10.5, 1 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 1, 'C', NULL, 20.0, 1 FROM part WHERE p_partkey % 3 = 1
 UNION ALL SELECT p_partkey, 0, 'fallback', NULL, 1.0, 2 FROM part WHERE p_partkey % 3 = 2""",
    "e18_capacity_slugs": _union("p_partkey AS page_id, 256 AS capacity_gb, 'last' AS slug", "p_partkey, 1024, 'y'"),
    "a28_cheapest_by_mode": _union(f"p_partkey AS page_id, 'renting_with_insurance' AS offer_type, 36 AS term_months, {_SZ} + 30.5 AS price",
                                   f"p_partkey, 'renting_no_insurance', 24, {_SZ} + 20.25", "p_partkey, 'renting_no_insurance', 12, 999.0",
                                   "p_partkey, 'cash', NULL, p_retailprice", f"p_partkey, 'financing_max_term', 20, {_SZ} + 40"),
    "f13_best_variant": """SELECT page_id, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 1 THEN 'SM-T1' ELSE 'SM-S' || page_id END AS sku,
 CASE WHEN page_id % 2 = 0 OR page_id % 3 = 1 THEN CAST(page_id + 100 AS DOUBLE) ELSE 1299.5 END AS price,
 CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN (page_id % 2 = 0 AND page_id % 3 = 1) OR (page_id % 2 = 1 AND page_id % 3 < 2) THEN 1 ELSE 0 END AS score
 FROM pages WHERE page_id % 2 = 0 OR page_id % 3 < 2""",
    "h10_capacity_for_code": "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 128 ELSE 512 END AS capacity_gb FROM part",
}
