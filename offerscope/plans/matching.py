"""Queries on product matching and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope.operators import features as X
from offerscope.operators import grouping as G
from offerscope.operators import matching as M
from offerscope.operators.candidates import accept_candidates
from offerscope.plans import matching_sql as S
from offerscope.plans.sqltext import norm, over_offers, r2
from offerscope.sources.tables import offers, read_table, spread

VARIANT = "CASE p_partkey % 6 WHEN 0 THEN ' Ultra' WHEN 1 THEN '+' WHEN 2 THEN ' FE' WHEN 3 THEN ' Pro Max' ELSE '' END"
TARGET = f"CASE WHEN p_partkey % 4 = 0 THEN 'Apple MacBook Air M' || CAST(p_partkey % 5 + 1 AS STRING) || ' ' || CAST(p_partkey AS STRING) ELSE 'Samsung Galaxy S' || CAST(p_partkey AS STRING) || {VARIANT} END"
TITLE = f"""CASE l_linenumber WHEN 1 THEN 'SAMSUNG Galaxy S' || CAST(p_partkey AS STRING) || {VARIANT} || ' 5G 256GB'
 WHEN 2 THEN 'Funda para Galaxy S' || CAST(p_partkey AS STRING) WHEN 3 THEN 'Galaxy S' || CAST(p_partkey AS STRING) || ' Ultra 512 GB ' || p_name
 WHEN 4 THEN 'Apple Macbook Air ' || CAST(p_partkey AS STRING) || ' chip M' || CAST(p_partkey % 5 + 1 AS STRING) || ' 16GB RAM'
 WHEN 5 THEN 'Galaxy S' || CAST(p_partkey AS STRING) || {VARIANT} || ' Wi-Fi, 6.7 pulgadas' WHEN 6 THEN p_name ELSE 'Galaxy S' || CAST(p_partkey AS STRING) || ' reacondicionado' END"""


def titles(spark, sf):
    li, p = spread(read_table(spark, sf, "lineitem")), read_table(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("title_id"),
                       F.expr(TITLE).alias("name"), F.expr("CASE WHEN l_linenumber = 1 THEN 256 WHEN l_linenumber = 3 THEN 512 END").alias("capacity_gb"))


def targets(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("target_id"), F.expr(TARGET).alias("model"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END").alias("capacity_gb"), F.col("p_partkey").alias("_ord"))


def catalogue(mode):
    def run(spark, sf):
        found = M.match_catalogue(titles(spark, sf), targets(spark, sf), mode)
        return found.groupBy("target_id").agg(F.count("*").alias("n_titles"), F.max("score").alias("best"), F.min("score").alias("worst"))
    return run


def names(spark, sf):
    # the clean name is a column: as an expression it would be worked out anew for most of what reads it
    t = titles(spark, sf).select("name").distinct().withColumn("clean", X.clean_name(F.col("name")))
    c = F.col("clean")
    return t.select("name", "clean", F.array_join(X.model_numbers(c), " ").alias("numbers"), F.array_join(X.tiers(c), " ").alias("tiers"),
                    X.galaxy_series(c).alias("series"), X.chip_signature(F.col("name")).alias("chip"), X.is_accessory(F.col("name")).alias("accessory"),
                    X.is_non_new(F.col("name")).alias("non_new"))


def classes(spark, sf):
    t = titles(spark, sf).select("name").distinct()
    n = F.col("name")
    return t.select("name", X.category(n, F.lit("Samsung")).alias("category"), X.device_type(n).alias("device"), X.model_for_brand(n, F.lit("Samsung")).alias("model"),
                    X.connectivity_signature(n).alias("signature"), X.in_focus(F.lit("mobile"), F.lit("Samsung"), n).alias("focus"))


APPLE_TITLE = """CASE p_partkey % 8 WHEN 0 THEN 'Apple iPhone ' || CAST(p_partkey % 4 + 14 AS STRING) || ' pro max 256 GB ' || p_name
 WHEN 1 THEN '<b>APPLE iphone</b> 17 air, 512GB' WHEN 2 THEN 'iPad ' || element_at(array('Pro', 'air', 'mini', '10th gen'), p_size % 4 + 1) || ' 11" chip M' || CAST(p_partkey % 5 + 1 AS STRING) || ' WiFi + Cellular 1TB'
 WHEN 3 THEN 'Portátil Apple macbook ' || element_at(array('Air', 'PRO'), p_size % 2 + 1) || ' 14" M4 pro 24GB RAM' WHEN 4 THEN 'Apple iMac 24 M' || CAST(p_partkey % 5 + 1 AS STRING) || ' ' || p_name
 WHEN 5 THEN 'Mac mini m4 256GB' WHEN 6 THEN 'Apple Mac Studio M2 Ultra' ELSE 'Apple ' || p_name END"""


def brand_models(spark, sf):
    """The model name in titles of both brands, by the extractor of the brand."""
    galaxy = titles(spark, sf).select(F.expr("CASE WHEN name LIKE 'Apple%' THEN 'Apple' ELSE 'Samsung' END").alias("brand"), "name")
    t = galaxy.union(read_table(spark, sf, "part").select(F.lit("Apple"), F.expr(APPLE_TITLE))).distinct()
    return t.select("brand", "name", X.model_for_brand(F.col("name"), F.col("brand")).alias("model"))


FOCUS_DEVICE = "CASE WHEN length(name) % 5 = 0 THEN 'tablet' ELSE 'mobile' END"
FOCUS_TITLE = """CASE p_partkey % 5 WHEN 0 THEN 'Apple iPhone ' || CAST(15 + p_partkey % 4 AS STRING) || ' 256 GB' WHEN 1 THEN 'iPhone  Air ' || p_name WHEN 2 THEN 'iPhone 17 Pro seminuevo'
 WHEN 3 THEN 'Apple iPhone 17e segunda mano' ELSE 'Apple Watch ' || p_name END"""


def focus(spark, sf):
    """Titles of both brands: whether they are in focus, second hand, or an accessory."""
    galaxy = titles(spark, sf).select(F.lit("Samsung").alias("brand"), F.expr("replace(name, 'Galaxy S2', 'Galaxy S 2')").alias("name"))
    rows = galaxy.union(read_table(spark, sf, "part").select(F.lit("Apple"), F.expr(FOCUS_TITLE))).distinct().withColumn("device", F.expr(FOCUS_DEVICE))
    n = F.col("name")
    return rows.select("brand", "name", "device", X.in_focus(F.col("device"), F.col("brand"), n).alias("focus"), X.is_second_hand(n).alias("second_hand"), X.is_accessory(n).alias("accessory"))


def pairs(spark, sf):
    """Titles beside the target of the same part: candidates a search for the target returned."""
    li, p = spread(read_table(spark, sf, "lineitem")), read_table(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.expr(TARGET).alias("model"), F.expr(TITLE).alias("title"),
                       F.expr("CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END").alias("capacity"))


def f7(spark, sf):
    c = pairs(spark, sf)
    score = M.additive_score(F.lit("Samsung"), F.col("model"), F.col("capacity"), F.col("title"))
    return c.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", score.alias("score"))


def f7_pick(spark, sf):
    c = pairs(spark, sf)
    score = M.additive_score(F.lit("Samsung"), F.col("model"), F.col("capacity"), F.col("title"))
    rows = c.select(F.col("l_partkey").alias("seed_id"), F.concat_ws("/", "l_suppkey", "l_linenumber").alias("href"), "title",
                    score.alias("score"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("_ord"))
    return M.pick_candidate(rows, rows.where("href LIKE '0/%'").select("href")).select("seed_id", "title", "score")


# Wanted products of both brands and all devices, and what nine retailers' searches might return for them.
WANTED = """CASE p_partkey % 8 WHEN 0 THEN 'Apple iPhone ' || CAST(14 + p_partkey % 4 AS STRING) || ' Pro' WHEN 1 THEN 'Apple iPad Air M' || CAST(p_partkey % 4 + 1 AS STRING) || ' 11 WiFi'
 WHEN 2 THEN 'Apple MacBook Air 13 M4' WHEN 3 THEN 'Samsung Galaxy S' || CAST(20 + p_partkey % 6 AS STRING) WHEN 4 THEN 'Samsung Galaxy Tab S' || CAST(p_partkey % 3 + 8 AS STRING) || ' WiFi'
 WHEN 5 THEN 'Samsung Galaxy Book' || CAST(p_partkey % 3 + 3 AS STRING) || ' Pro 16' WHEN 6 THEN 'Samsung Galaxy Z Flip' || CAST(p_partkey % 4 + 4 AS STRING) ELSE 'Samsung Galaxy S25 Ultra 5G' END"""
RESULT = """CASE l_linenumber WHEN 1 THEN wanted || ' 256 GB' WHEN 2 THEN 'Funda para ' || wanted WHEN 3 THEN wanted || ' Ultra 512 GB ' || p_name WHEN 4 THEN replace(replace(wanted, '5', '4'), 'Pro', 'Max')
 WHEN 5 THEN wanted || ' reacondicionado' WHEN 6 THEN 'Movil ' || replace(replace(wanted, 'Apple ', ''), ' WiFi', ' 5G') || ' Tablet' ELSE 'Portatil ' || replace(wanted, 'Samsung Galaxy ', 'Samsung ') || ' ' || p_name END"""
SHOP = """CASE l_suppkey % 10 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Grover' WHEN 2 THEN 'Movistar' WHEN 3 THEN 'Movistar detail' WHEN 4 THEN 'Media Markt' WHEN 5 THEN 'Rentik' WHEN 6 THEN 'Fnac'
 WHEN 7 THEN 'PcComponentes' WHEN 8 THEN 'Apple Oficial' ELSE 'Samsung Oficial' END"""
LINK = """CASE retailer WHEN 'Amazon' THEN 'https://www.amazon.es/x/dp/B0' || CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE 'ABCDEF12' END WHEN 'Grover' THEN 'https://www.grover.com/es-es/' || CASE WHEN l_orderkey % 7 = 0 THEN 'blog/' ELSE 'products/' END || slug
 WHEN 'Media Markt' THEN 'https://www.mediamarkt.es/es/product/' || slug WHEN 'Rentik' THEN 'https://rentik.com/ofertas-alquilar/' || CASE WHEN l_orderkey % 7 = 0 THEN 'gaming/' ELSE CASE WHEN brand = 'Apple' THEN 'iphone/' ELSE 'samsung/' END || slug END
 WHEN 'Fnac' THEN 'https://www.fnac.es/' || slug || CASE WHEN l_orderkey % 7 = 0 THEN '/w' ELSE '/a' END || CAST(l_orderkey AS STRING) WHEN 'PcComponentes' THEN 'https://www.pccomponentes.com/' || CASE WHEN l_orderkey % 7 = 0 THEN 'buscar/' ELSE '' END || slug
 WHEN 'Apple Oficial' THEN 'https://www.apple.com/es/shop/buy-' || CASE device_type WHEN 'mobile' THEN 'iphone/' WHEN 'tablet' THEN 'ipad/' ELSE 'mac/' END || replace(slug, 'apple-', '')
 WHEN 'Samsung Oficial' THEN 'https://www.samsung.com/es/' || CASE device_type WHEN 'mobile' THEN 'smartphones/' WHEN 'tablet' THEN 'tablets/' ELSE 'computers/' END || slug || CASE WHEN l_orderkey % 7 = 0 THEN '/' ELSE '/buy/' END
 ELSE 'https://www.movistar.es/' || CASE WHEN l_orderkey % 7 = 0 THEN 'watch/' WHEN device_type = 'mobile' THEN 'moviles/' WHEN device_type = 'tablet' THEN 'tablets/' ELSE 'portatiles/' END || slug END"""
# one list of columns for both engines: each level may use the one before
SEARCHES = (
    {"brand": "CASE WHEN p_partkey % 8 < 3 THEN 'Apple' ELSE 'Samsung' END", "device_type": "CASE p_partkey % 8 WHEN 1 THEN 'tablet' WHEN 4 THEN 'tablet' WHEN 2 THEN 'laptop' WHEN 5 THEN 'laptop' ELSE 'mobile' END",
     "capacity_gb": "CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END", "wanted": WANTED, "retailer": SHOP,
     "product_code": "CASE WHEN p_partkey % 8 = 5 AND p_size % 2 = 0 THEN 'NP960XHA-KG' || CAST(p_size AS STRING) END"},
    {"model": "wanted", "text": RESULT, "slug": "replace(lower(wanted), ' ', '-')"},
    {"href": LINK, "title": "CASE WHEN l_orderkey % 3 = 0 THEN text END", "body": "p_name || CASE WHEN l_orderkey % 2 = 0 THEN ' ' || wanted ELSE '' END"},
)


def f8(spark, sf):
    """Decisions on distinct search results, nine retailers, both brands, all devices."""
    li, p = spread(read_table(spark, sf, "lineitem")), read_table(spark, sf, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    for level in SEARCHES:
        rows = rows.withColumns({c: F.expr(sql) for c, sql in level.items()})
    seen = rows.select("retailer", "brand", "model", "capacity_gb", "device_type", "product_code", "text", "href", "title", "body").distinct()
    return accept_candidates(seen)


def queries_offers(spark, sf):
    """Requested products beside the offers retrieved for them."""
    o = offers(spark, sf)
    p = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("p_brand"), F.expr("p_name || ' ' || CAST(p_partkey AS STRING)").alias("p_model"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 256 WHEN 1 THEN 128 END").alias("p_capacity"))
    rows = o.select(F.substring_index("product_code", "SM-A", -1).cast("bigint").alias("query_id"), "brand", "model", "retailer", "capacity_gb",
                    F.col("price_value").cast("double").alias("price"), F.col("source_title").alias("title"), F.when(F.col("in_stock"), 0.9).otherwise(0.5).alias("confidence"), "_ord")
    return p.join(rows, "query_id", "left")


def f9(spark, sf):
    return M.suggestions(queries_offers(spark, sf)).select("query_id", "place", "title", "capacity_gb", "retailer", "loose")


def f15(spark, sf):
    c = pairs(spark, sf).select(F.concat_ws("-", "l_partkey", "l_suppkey", "l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("place"), "title",
                                F.concat(F.lit("S"), F.col("l_partkey")).alias("query"), (F.col("l_suppkey") % 2 == 0).alias("code_query"),
                                F.lit("Samsung").alias("brand"), "model", F.col("capacity").alias("target_capacity"), F.col("l_extendedprice").alias("price"))
    return M.search_cards(c)


def products(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
                    F.col("p_partkey").alias("_ord"), F.col("p_partkey").alias("part"))


def f5(spark, sf):
    g = G.group_products(products(spark, sf))
    return g.groupBy("group_key").agg(F.count("*").alias("n_products"), F.count_distinct("model_key").alias("n_keys"))


SOURCE = """CASE l_suppkey % 9 WHEN 0 THEN 'home_store' WHEN 1 THEN 'rentik' WHEN 2 THEN 'grover' WHEN 3 THEN 'movistar' WHEN 4 THEN 'amazon'
 WHEN 5 THEN 'mediamarkt' WHEN 6 THEN 'apple_store' WHEN 7 THEN 'samsung_store' ELSE 'other' END"""
KIND = "CASE l_returnflag WHEN 'R' THEN 'renting' ELSE 'purchase' END"


POINT_URL = "'https://shop.example/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)"


def price_points(spark, sf):
    """Price points grouped by the exact model key; the fuzzy merge is the query above."""
    li, name = spread(read_table(spark, sf, "lineitem")), F.concat_ws(" ", "p_name", "p_partkey")
    # the key is worked out once per product, not for each of its prices
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", name.alias("name"), G.model_key(name).alias("group_key"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("group_key", "name",
                       F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.expr(SOURCE).alias("source"), F.expr(KIND).alias("price_type"),
                       F.col("l_extendedprice").alias("price"), F.expr(POINT_URL).alias("url"), F.expr("CASE WHEN l_linenumber > 1 THEN l_linenumber * 6 END").alias("installments"),
                       F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("_ord"))


def f6(spark, sf):
    """Spelling variants of part names matched to the distinct names."""
    p = read_table(spark, sf, "part")
    wanted = p.select(F.col("p_partkey").alias("id"), G.plain_name(F.concat_ws(" ", F.concat(F.col("p_name"), F.lit("s")), F.lit("the new"))).alias("t")).select(
        "id", M.sorted_words(F.col("t")).alias("text"))
    cands = p.groupBy("p_name").agg(F.min("p_partkey").alias("_ord")).select(F.col("p_name").alias("id"), M.sorted_words(F.col("p_name")).alias("text"), "_ord")
    return M.best_of_candidates(wanted, cands).select(F.col("l_id").alias("part"), F.col("r_id").alias("name"), (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


HREF = f"'https://rentik.example/es/samsung-galaxy-s' || CAST(p_partkey AS STRING) || replace(replace(lower({VARIANT}), ' ', '-'), '+', '-plus') || '-5g256'"


def hrefs(spark, sf):
    return read_table(spark, sf, "part").select(F.expr(HREF).alias("href"), F.col("p_partkey").alias("_ord"))


def l8(spark, sf):
    """Marketplace sellers among the suppliers of each part."""
    li = spread(read_table(spark, sf, "lineitem"))
    per = li.select("l_partkey", F.expr("CASE l_suppkey % 7 WHEN 0 THEN 'MKP' ELSE 'own' END").alias("type")).distinct()
    prov = per.groupBy("l_partkey").agg(F.collect_set(F.struct("type")).alias("providers"))
    return prov.select("l_partkey", X.is_marketplace(F.col("providers")).alias("marketplace"))


# pages with a counterpart, with tiers only, and without either, of both families
PAGE_URL = """'https://www.apple.com/es/shop/buy-' || CASE p_partkey % 2 WHEN 0 THEN 'ipad/ipad-' ELSE 'iphone/iphone-' END || CASE p_partkey % 5 WHEN 0 THEN 'pro-' || CAST(p_partkey AS STRING)
 WHEN 1 THEN 'pro' WHEN 2 THEN CAST(p_partkey AS STRING) WHEN 3 THEN 'pro-max-' || CAST(p_partkey + 100000 AS STRING) ELSE 'comprar' END"""
PAGE_MODEL = """CASE p_partkey % 2 WHEN 0 THEN 'Apple iPad ' ELSE 'Apple iPhone ' END || CASE p_partkey % 3 WHEN 0 THEN 'Pro ' WHEN 1 THEN 'Pro Max ' ELSE '' END || CAST(p_partkey AS STRING)"""


def f4a(spark, sf):
    """Targets per page and rule: how many, the least, the greatest, the sum of their ids."""
    p = read_table(spark, sf, "part")
    pages = p.select(F.col("p_partkey").alias("page_id"), F.expr(PAGE_URL).alias("url"))
    ids = [F.count("*").alias("n"), F.min("target_id").alias("least"), F.max("target_id").alias("greatest"), F.sum("target_id").alias("total")]
    found = M.targets_for_page(pages, p.select(F.col("p_partkey").alias("target_id"), F.expr(PAGE_MODEL).alias("model")), ids)
    return found.groupBy("page_id", "rule").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"))


QUERIES = {
    "f0_f4b_name_features": names,
    "f1_match_catalogue": catalogue("strict"),
    "f2_match_scored": catalogue("scored"),
    "f3_match_chipless": catalogue("chipless"),
    "f4_match_slugs": lambda spark, sf: M.match_slugs(targets(spark, sf), hrefs(spark, sf)),
    "f4a_targets_for_page": f4a,
    "f5_group_products": f5,
    "f6_best_of_candidates": f6,
    "f7_additive_score": f7,
    "f7_pick_candidate": f7_pick,
    "f8_accept_candidate": f8,
    "f9_suggestions": f9,
    "f10_outcome": lambda spark, sf: M.outcome(queries_offers(spark, sf)),
    "f11_f12_classes": classes,
    "f12_brand_models": brand_models,
    "f14_connectivity_clash": lambda spark, sf: pairs(spark, sf).select("model", "title", X.connectivity_clash(F.col("model"), F.col("title")).alias("clash"),
                                                                        X.family_matches(F.col("title"), F.col("model")).alias("family"), X.variant_clash(F.col("title"), F.col("model")).alias("variant")).distinct(),
    "f15_search_cards": f15,
    "l7_focus": focus,
    "l8_marketplace": l8,
    "h8_catalogue_outcome": lambda spark, sf: M.match_catalogue(titles(spark, sf), targets(spark, sf)).select((F.col("score") >= 100).alias("exact")).groupBy("exact").agg(F.count("*").alias("n")),
    "a22_comparison_wide": lambda spark, sf: G.comparison_wide(price_points(spark, sf)),
    "a24_category_summary": lambda spark, sf: G.category_summary(G.comparison_wide(price_points(spark, sf))),
    "a25_source_counts": lambda spark, sf: G.source_counts(price_points(spark, sf)),
}

_PP = f"""WITH pp AS MATERIALIZED (SELECT array_to_string(list_filter(regexp_split_to_array(p_name || ' ' || p_partkey, '\\s+'), lambda w: length(w) > 1
 AND w NOT IN ({', '.join("'" + w + "'" for w in G.STOPWORDS)})), ' ') AS group_key, p_name || ' ' || p_partkey AS name, p_brand AS brand, p_type AS category, {SOURCE} AS source,
 {KIND} AS price_type, l_extendedprice AS price, {POINT_URL} AS url, CASE WHEN l_linenumber > 1 THEN l_linenumber * 6 END AS installments, (l_orderkey, l_linenumber, l_suppkey) AS o FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _pick(col):
    return f"arg_min({col}, (source <> 'home_store', o)) AS {col}"


_PRICES = ", ".join(f"min(price) FILTER (source = '{s}' AND price_type = '{k}') AS {c}" for s, pair in G.SOURCES.items()
                    for k, c in zip(("renting", "purchase"), pair) if c)


def _delta(c, b):
    return r2(f"({c} - nullif({b}, 0)) / nullif({b}, 0) * CAST(100.0 AS DOUBLE)", "10.0") + f" AS {c}_delta"


def _cheapest(col, source, kind):
    return f"arg_min_null({col}, (price, o)) FILTER (source = '{source}' AND price_type = '{kind}' AND price IS NOT NULL)"


_URLS = ", ".join(f"{_cheapest('url', s, 'renting')} AS {s}_url" for s in ("rentik", "grover", "movistar"))
_HOME = f"{_cheapest('url', 'home_store', 'renting')} AS ru, {_cheapest('url', 'home_store', 'purchase')} AS pu, {_cheapest('o', 'home_store', 'renting')} AS ro, {_cheapest('o', 'home_store', 'purchase')} AS po, {_cheapest('installments', 'home_store', 'renting')} AS home_instalments"
_WIDE = _PP + f""", w0 AS (SELECT group_key, {_pick('name')}, {_pick('brand')}, {_pick('category')}, {_PRICES}, {_URLS}, {_HOME} FROM pp GROUP BY group_key),
 w AS (SELECT * EXCLUDE (ru, pu, ro, po), CASE WHEN po IS NULL OR ro > po THEN ru ELSE pu END AS home_url FROM w0),
 wide AS (SELECT *, {_delta('rentik_renting', 'home_renting')}, {_delta('grover_renting', 'home_renting')}, {_delta('movistar_renting', 'home_renting')},
 {_delta('amazon_purchase', 'home_purchase')}, {_delta('mediamarkt_purchase', 'home_purchase')} FROM w)"""
_LOW = "least(amazon_purchase, mediamarkt_purchase, rentik_renting, grover_renting)"


def _share(cond):
    return f"CAST(floor(count(*) FILTER ({cond}) / CAST(count(*) AS DOUBLE) * CAST(100.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT)"


_QO = f""", q AS (SELECT p_partkey AS query_id, p_brand, p_name || ' ' || p_partkey AS p_model, CASE p_partkey % 3 WHEN 0 THEN 256 WHEN 1 THEN 128 END AS p_capacity FROM part),
 j AS (SELECT q.*, o.brand, o.model, o.retailer, o.capacity_gb, CAST(o.price_value AS DOUBLE) AS price, o.source_title AS title,
 CASE WHEN o.in_stock THEN 0.9 ELSE 0.5 END AS confidence, o._ord FROM q LEFT JOIN offers o ON CAST(substr(o.product_code, 5) AS BIGINT) = query_id),
 tk AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace({norm('p_model')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS want,
 list_distinct(list_filter(string_split(regexp_replace({norm("concat_ws(' ', model, title)")}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS have FROM j),
 sc AS (SELECT *, floor(CAST(len(list_intersect(want, have)) AS DOUBLE) / len(want) * 70) + CASE WHEN {norm('p_brand')} = {norm('brand')} THEN 20 ELSE -25 END
 + CASE WHEN price > 0 THEN 5 ELSE 0 END AS raw, CASE WHEN p_capacity IS NULL THEN 0 WHEN capacity_gb IS NOT DISTINCT FROM p_capacity THEN 20 ELSE -35 END AS cap FROM tk),
 s AS (SELECT *, CASE WHEN len(have) = 0 THEN 0 ELSE CAST(least(greatest(raw + greatest(cap, 0), 0), 100) AS INT) END AS loose,
 CASE WHEN len(have) = 0 THEN 0 ELSE CAST(least(greatest(raw + cap, 0), 100) AS INT) END AS tight FROM sc)"""



def _clean_sql(x):
    out = f"lower({x})"
    for pattern, new in X.NAME_REWRITES:
        pat = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{pat}', '{new.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


_TN = f"WITH t AS (SELECT DISTINCT {TITLE} AS name FROM lineitem JOIN part ON l_partkey = p_partkey), c AS MATERIALIZED (SELECT name, {_clean_sql('name')} AS clean FROM t)"
_NUMS = """array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(clean, '\\b[a-z]+(\\d+)\\b', 1),
 regexp_extract_all(clean, '\\b(\\d{2,})\\b', 1)), lambda v: NOT (v = '5' AND regexp_matches(clean, '\\b5g\\b'))))), ' ')"""
_TIERS = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: w IN (" + ", ".join(f"'{w}'" for w in X.TIERS) + ")))), ' ')"


def _any(words):
    return "'" + "|".join(words) + "'"


_PAIRS = f"""WITH p AS MATERIALIZED (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, {TARGET} AS model, {TITLE} AS title,
 CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END AS capacity FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_SIZES = "list_transform(regexp_extract_all(lower(title), '\\b(64|128|256|512|1024|2048)\\s*gb\\b', 1), lambda v: CAST(v AS INT))"
_SIG = """CASE WHEN regexp_matches(lower({x}), '\\bwi[\\s-]?fi\\b') AND regexp_matches(lower({x}), 'cellular|celular|\\b5g\\b') THEN 'wifi_cellular'
 WHEN regexp_matches(lower({x}), 'cellular|celular|\\b5g\\b') THEN 'cellular' WHEN regexp_matches(lower({x}), '\\bwi[\\s-]?fi\\b') THEN 'wifi' END"""

_ADDITIVE = f"""CAST(CAST(contains(lower(title), 'samsung') AS INT)
 + CAST(contains(lower(title), 'galaxy') AS INT) + 2 * len(list_filter(regexp_split_to_array(regexp_replace(lower(model), '\\b(samsung|galaxy|apple)\\b', ' ', 'g'),
 '[^a-z0-9]+'), lambda w: w NOT IN ('', '5g', 'gb') AND contains(lower(title), w))) + CASE WHEN capacity IS NULL THEN 0 ELSE
 CASE WHEN contains(title, CAST(capacity AS VARCHAR)) THEN 3 ELSE 0 END + CASE WHEN len({_SIZES}) = 0 THEN 0 WHEN list_contains({_SIZES}, capacity) THEN 2 ELSE -3 END END AS INT)"""

ORACLE = {
    "f0_f4b_name_features": _TN + f""" SELECT name, clean, {_NUMS} AS numbers, {_TIERS} AS tiers,
 coalesce(nullif(regexp_extract(clean, '\\bgalaxy\\s+([asz])\\s*\\d{{1,2}}\\b', 1), ''), nullif(regexp_extract(clean, '\\b([asz])\\s*\\d{{1,2}}\\b', 1), '')) AS series,
 CASE WHEN contains(lower(name), 'mac') AND regexp_matches(lower(name), '\\bm\\d{{1,2}}\\b') THEN regexp_extract(lower(name), '\\b(m\\d{{1,2}})\\b', 1) || ' '
 || coalesce(nullif(regexp_extract(lower(name), '\\bm\\d{{1,2}}\\s+(pro|max|ultra)\\b', 1), ''), 'base') END AS chip,
 regexp_matches(lower(name), {_any(X.ACCESSORY_WORDS)}) OR regexp_matches(lower(name), '\\b(?:for|para)\\s+(?:iphone|ipad|mac(?:book| mini)?|imac|galaxy|samsung)\\b') AS accessory,
 regexp_matches(lower(name), {_any(X.NON_NEW)}) AS non_new FROM c""",
    "f1_match_catalogue": S.catalogue(TITLE, TARGET, "strict", S.PER_TARGET),
    "f2_match_scored": S.catalogue(TITLE, TARGET, "scored", S.PER_TARGET),
    "f3_match_chipless": S.catalogue(TITLE, TARGET, "chipless", S.PER_TARGET),
    "h8_catalogue_outcome": S.catalogue(TITLE, TARGET, "strict", S.PER_OUTCOME),
    "f4_match_slugs": S.slugs(TARGET, HREF),
    "f5_group_products": S.GROUPS,
    "f6_best_of_candidates": S.BEST,
    "f7_additive_score": _PAIRS + f""" SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, {_ADDITIVE} AS score FROM p""",
    "f7_pick_candidate": _PAIRS.replace("l_linenumber, CASE", "l_linenumber, l_extendedprice, CASE", 1).replace("l_orderkey, l_linenumber,", "l_orderkey, l_linenumber, l_extendedprice,", 1) + f""",
 s AS (SELECT l_partkey AS seed_id, l_suppkey || '/' || l_linenumber AS href, title, {_ADDITIVE} AS score, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS o FROM p)
 SELECT seed_id, title, score FROM s WHERE score > 0 AND href NOT IN (SELECT href FROM s WHERE href LIKE '0/%') QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, o) = 1""",
    "f8_accept_candidate": S.accepted(SEARCHES),
    "f14_connectivity_clash": S.clashes(TARGET, TITLE),
    "f15_search_cards": S.cards(TARGET, TITLE),
    "f11_f12_classes": _TN + f""" SELECT name, CASE WHEN contains(lower(name), 'iphone') THEN 'iPhone' WHEN contains(lower(name), 'ipad') THEN 'iPad'
 WHEN regexp_matches(lower(name), 'macbook|mac mini|imac|mac pro') THEN 'Mac' WHEN contains(lower(name), 'galaxy') AND regexp_matches(lower(name), 's2|s3|z fold|z flip|a5|a7')
 THEN 'Galaxy' WHEN regexp_matches(lower(name), 'galaxy tab|tab s') THEN 'Tablet' WHEN contains(lower(name), 'tab') THEN 'Tablet' ELSE 'Galaxy' END AS category,
 CASE WHEN regexp_matches(lower(name), {_any(X.ACCESSORY_HINTS)}) THEN NULL WHEN regexp_matches(lower(name), 'macbook|galaxy book|portatil|laptop|notebook|imac|mac mini|mac studio')
 THEN 'laptop' WHEN regexp_matches(lower(name), 'ipad|\\btab(?:let|lets)?\\b') THEN 'tablet' WHEN regexp_matches(lower(name), 'movil|smartphone|iphone|samsung|galaxy|apple') THEN 'mobile' END AS device,
 CASE WHEN regexp_matches(name, '(?i)galaxy[\\w\\s+\\-]') THEN 'Samsung ' || regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_extract(name, '(?i)(Galaxy[\\w\\s+\\-]{{1,40}})', 1),
 '\\s+', ' ', 'g')), '(?i)\\b\\d{{2,4}}\\s*GB\\b', '', 'g')), '[\\s\\-_/]+$', '') ELSE 'Samsung Galaxy' END AS model, {_SIG.replace('{x}', 'name')} AS signature,
 regexp_matches(lower(name), '\\bs\\s*25\\b') AS focus FROM c""",
    # model names written out by hand, as they follow from how the titles are made
    "f12_brand_models": f"""WITH t AS (SELECT DISTINCT p_partkey, {TITLE} AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
 made AS (SELECT DISTINCT 'Apple' AS brand, name, 'Apple MacBook Air' || CASE WHEN p_partkey BETWEEN 13 AND 16 THEN ' ' || p_partkey ELSE '' END || ' M' || (p_partkey % 5 + 1) AS model FROM t WHERE name LIKE 'Apple%'
 UNION SELECT DISTINCT 'Samsung', name, CASE WHEN regexp_matches(name, '(?i)galaxy[\\w\\s+\\-]') THEN 'Samsung ' || regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_extract(name, '(?i)(Galaxy[\\w\\s+\\-]{{1,40}})', 1),
  '\\s+', ' ', 'g')), '(?i)\\b\\d{{2,4}}\\s*GB\\b', '', 'g')), '[\\s\\-_/]+$', '') ELSE 'Samsung Galaxy' END FROM t WHERE name NOT LIKE 'Apple%'
 UNION SELECT DISTINCT 'Apple', {APPLE_TITLE.replace('element_at(array(', 'list_extract(list_value(')}, CASE p_partkey % 8 WHEN 0 THEN 'Apple iPhone ' || (p_partkey % 4 + 14) || ' Pro Max' WHEN 1 THEN 'Apple iPhone Air'
  WHEN 2 THEN 'Apple iPad ' || list_extract(['Pro', 'Air', 'Mini', '10th'], p_size % 4 + 1) || ' M' || (p_partkey % 5 + 1) || ' 11 WiFi+Cell' WHEN 3 THEN 'Apple MacBook ' || list_extract(['Air', 'Pro'], p_size % 2 + 1) || ' 14 M4 Pro'
  WHEN 4 THEN 'Apple iMac 24 M' || (p_partkey % 5 + 1) WHEN 5 THEN 'Apple Mac Mini M4' WHEN 6 THEN 'Apple Mac Studio M2 Ultra' ELSE 'Apple' END FROM part) SELECT * FROM made""",
    "f9_suggestions": over_offers(_QO + """, u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, title, capacity_gb, retailer ORDER BY confidence DESC, _ord) = 1)
 SELECT query_id, CAST(place AS INT) AS place, title, capacity_gb, retailer, loose FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY loose DESC, confidence DESC,
 coalesce(price, 0), _ord) AS place FROM u) WHERE place <= 3"""),
    "f10_outcome": over_offers(_QO + """, g AS (SELECT *, CASE WHEN p_capacity IS NOT NULL THEN tight >= 85 AND capacity_gb IS NOT DISTINCT FROM p_capacity ELSE loose >= 85 END AS good FROM s),
 a AS (SELECT query_id, p_capacity, count(*) FILTER (good) AS n_good, count(DISTINCT capacity_gb) FILTER (good) AS n_sizes, min(price) FILTER (good) AS bp, count(title) AS n FROM g GROUP BY ALL),
 t AS (SELECT *, CASE WHEN p_capacity IS NULL AND n_sizes > 1 THEN 'needs_clarification' WHEN n_good > 0 THEN 'completed' WHEN n > 0 THEN 'needs_clarification' ELSE 'not_found' END AS status FROM a)
 SELECT query_id, status, n_good, n_sizes, CASE WHEN status = 'completed' THEN bp END AS best_price FROM t"""),
    "l7_focus": f"""WITH t AS (SELECT DISTINCT 'Samsung' AS brand, replace({TITLE}, 'Galaxy S2', 'Galaxy S 2') AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT 'Apple', {FOCUS_TITLE} FROM part),
 d AS (SELECT *, {FOCUS_DEVICE} AS device FROM t) SELECT brand, name, device, device <> 'tablet' AND CASE brand WHEN 'Apple' THEN regexp_matches(lower(name), '\\biphone\\s*17\\b|\\biphone\\s+air\\b')
 ELSE regexp_matches(lower(name), '\\bs\\s*25\\b') END AS focus, regexp_matches(lower(name), {_any(X.SECOND_HAND)}) AS second_hand,
 regexp_matches(lower(name), {_any(X.ACCESSORY_WORDS)}) OR regexp_matches(lower(name), '\\b(?:for|para)\\s+(?:iphone|ipad|mac(?:book| mini)?|imac|galaxy|samsung)\\b') AS accessory FROM d""",
    "l8_marketplace": "SELECT l_partkey, bool_or(l_suppkey % 7 = 0) AS marketplace FROM lineitem GROUP BY 1",
    "f4a_targets_for_page": S.page_targets(PAGE_URL, PAGE_MODEL),
    "a22_comparison_wide": _WIDE + " SELECT * FROM wide",
    "a24_category_summary": _WIDE + f""", r AS (SELECT category, brand, coalesce(home_renting, home_purchase) AS b, {_LOW} AS lo,
 greatest(amazon_purchase, mediamarkt_purchase, rentik_renting, grover_renting) AS hi FROM wide) SELECT category, brand, count(*) AS n, min(b) AS min_base, max(b) AS max_base,
 min(lo) AS min_market, max(hi) AS max_market, {_share('b < lo')} AS cheaper_pct, {_share('abs(b - lo) / b < CAST(0.05 AS DOUBLE)')} AS same_pct,
 {_share('b > lo * CAST(1.05 AS DOUBLE)')} AS dearer_pct FROM r GROUP BY ALL""",
    "a25_source_counts": _PP + " SELECT source, count(*) AS n, count(DISTINCT name) AS n_products FROM pp GROUP BY 1",
}
