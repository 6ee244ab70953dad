"""Queries on canonical rows, the gate, dedupe, merge and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import pct_from, round_half_up
from offerscope.functions.text import normalize_text
from offerscope.operators import canonical as N
from offerscope.operators import dedupe as D
from offerscope.operators import gate as G
from offerscope.operators import merge as M
from offerscope.operators import validate as V
from offerscope.operators.ordering import validation_sample
from offerscope.plans.sqltext import BASE, cases, dbl, norm, num, over_offers, over_raw, r2
from offerscope.sources.tables import offers, raw_offers, read_table, spread

CUT = "2001-01"


def _q(fn):
    return lambda spark, sf: fn(offers(spark, sf))


def _r(fn):
    return lambda spark, sf: fn(raw_offers(spark, sf))


def _show(df):
    """Canonical columns with the price as a double."""
    return df.select(*[F.col(c).cast("double").alias(c) if c == "price_value" else F.col(c)
                       for c in fixed.CANONICAL_COLUMNS])


# --- SQL for canonical rows ---
_TIER, _RET = norm("data_quality_tier"), norm("retailer")
_WORD = f"translate({norm('price_capture_kind')}, '- ', '__')"
_EXPL = cases(_WORD, fixed.CAPTURE_KIND_ALIASES, _WORD)
_KIND = f"""CASE WHEN {_EXPL} IN ('visible_dom', 'embedded_json_exact', 'api_exact') THEN {_EXPL}
 WHEN contains({_TIER}, 'api') THEN 'api_exact'
 WHEN contains({_TIER}, 'json') OR contains({_TIER}, 'embedded') THEN 'embedded_json_exact'
 WHEN {_RET} IN ('home store', 'rentik', 'el corte ingles') THEN 'api_exact'
 WHEN {_RET} IN ('movistar', 'grover') THEN 'embedded_json_exact'
 WHEN {_RET} IN ('media markt', 'samsung oficial', 'orange', 'apple oficial') THEN 'visible_dom'
 WHEN {_RET} = 'amazon' AND offer_type = 'cash' THEN 'visible_dom'
 WHEN contains({_TIER}, 'adapter_live') THEN 'visible_dom' ELSE '' END"""


def _int(x):
    return f"CAST(trunc({num(x)}) AS INT)"


_DOTTED = "replace(price_value, ',', '.')"
_PRICE = f"CAST({num(_DOTTED)} AS DECIMAL(18,4))"
_STOCK = """CASE WHEN lower(trim(in_stock)) IN ('true', '1', 'yes', 'y') THEN true
 WHEN lower(trim(in_stock)) IN ('false', '0', 'no', 'n') THEN false END"""
CANON = f""", canon AS MATERIALIZED (SELECT CASE WHEN country = '' THEN 'ES' ELSE country END AS country,
 {cases('trim(retailer)', fixed.RETAILER_ALIASES, 'trim(retailer)')} AS retailer,
 {cases('trim(retailer_slug)', fixed.SLUG_ALIASES, 'trim(retailer_slug)')} AS retailer_slug,
 CASE WHEN product_family = '' THEN brand ELSE product_family END AS product_family, brand,
 CASE WHEN device_type = '' THEN 'mobile' ELSE device_type END AS device_type, model,
 {_int('capacity_gb')} AS capacity_gb, product_code, offer_type, {_PRICE} AS price_value,
 price_text, price_unit, {_int('term_months')} AS term_months, {_STOCK} AS in_stock, data_quality_tier,
 {_KIND} AS price_capture_kind, extracted_at, source_url, source_title, source_snapshot, source_snapshots,
 snapshot_id, _ord FROM raw)"""


def _alt(words):
    return "'" + "|".join(w.replace("/", "/") for w in words) + "'"


def _src(*cols):
    return norm("concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + ")")


def _conn(x):
    return (f"CASE WHEN regexp_matches(' ' || {x} || ' ', {_alt(fixed.CELLULAR_MARKERS)}) THEN 'cellular' "
            f"WHEN regexp_matches(' ' || {x} || ' ', {_alt(fixed.WIFI_MARKERS)}) THEN 'wifi' ELSE '' END")


_VAR = "[" + ", ".join(f"'{v}'" for v in fixed.VARIANT_MARKERS) + "]"
_STOP = ", ".join(f"'{v}'" for v in fixed.MODEL_STOPWORDS)
_CONFLICT = f"""(len(list_intersect(string_split(mn, ' '), {_VAR})) > 0 AND len(list_filter(
 list_intersect(string_split(tu, ' '), {_VAR}), lambda v: NOT list_contains(string_split(mn, ' '), v))) > 0)"""
_TOKENS = f"""list_filter(list_transform(string_split(mn, ' '), lambda t: regexp_replace(t, '[^a-z0-9]+', '', 'g')),
 lambda t: regexp_matches(t, '\\d') AND t NOT IN ({_STOP}))"""
FEATURES = f""", feat AS MATERIALIZED (SELECT *, {_src('source_title', 'source_url', 'price_text')} AS src,
 {norm('model')} AS mn, {_src('source_title', 'source_url')} AS tu,
 {_src('data_quality_tier', 'price_capture_kind', 'source_title', 'price_text')} AS tt FROM canon),
gated AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(src, '(?i)(\\d{{2,4}}\\s*(?:gb|tb))\\b', 1),
 lambda h: CAST(regexp_extract(h, '^(\\d+)', 1) AS INT) * CASE WHEN h LIKE '%tb' THEN 1024 ELSE 1 END) AS caps,
 {_CONFLICT} AS vconf, {_TOKENS} AS toks, {_conn('mn')} AS cexp, {_conn('src')} AS cobs FROM feat),
reasons AS MATERIALIZED (SELECT *, concat_ws(',',
 CASE WHEN price_capture_kind NOT IN ('visible_dom', 'embedded_json_exact', 'api_exact') THEN 'capture_kind' END,
 CASE WHEN price_value IS NULL OR price_value <= 0 THEN 'price' END,
 CASE WHEN trim(retailer) = '' OR trim(model) = '' OR trim(offer_type) = ''
  OR (trim(source_url) = '' AND trim(source_title) = '') THEN 'required' END,
 CASE WHEN regexp_matches(tt, {_alt(fixed.DERIVED_MARKERS)}) THEN 'derived_price' END,
 CASE WHEN regexp_matches(src, {_alt(fixed.CONDITIONAL_MARKERS)}) THEN 'conditional_price' END,
 CASE WHEN regexp_matches(src, {_alt(fixed.ACCESSORY_MARKERS)}) THEN 'accessory' END,
 CASE WHEN capacity_gb IS NOT NULL AND len(caps) > 0 AND NOT list_contains(caps, capacity_gb) THEN 'capacity' END,
 CASE WHEN cexp <> '' AND cobs <> '' AND cexp <> cobs THEN 'connectivity' END,
 CASE WHEN vconf THEN 'variant' END,
 CASE WHEN src <> '' AND len(toks) > 0 AND len(list_filter(toks, lambda t: contains(src, t))) = 0
  THEN 'weak_match' END) AS why FROM gated)"""
_CAP_HIT = "coalesce(list_contains(caps, capacity_gb), false)"
_CODE_HIT = f"({norm('product_code')} <> '' AND contains(src, {norm('product_code')}))"
RANKED = f"""NOT regexp_matches(src, {_alt(fixed.CONDITIONAL_MARKERS)}) DESC,
 {cases('price_capture_kind', fixed.CAPTURE_KIND_RANK, '-1')} DESC, {_CAP_HIT} DESC, {_CODE_HIT} DESC,
 NOT vconf DESC, coalesce(in_stock, false) DESC, extracted_at DESC, price_value ASC"""
KEY7 = ", ".join([norm("brand"), norm("retailer"), norm("device_type"), "mn", "capacity_gb",
                  norm("offer_type"), "term_months"])
SHOWN = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c == "price_value" else c for c in fixed.CANONICAL_COLUMNS)


def _dedupe_sql(source, order="_ord"):
    return f"""SELECT * FROM {source} WHERE why = '' QUALIFY row_number() OVER (PARTITION BY {KEY7}
 ORDER BY {RANKED}, {order}) = 1"""


def _ordered_canon(raw):
    return N.canonicalize(raw)


def reasons(raw):
    return G.with_publishable(N.canonicalize(raw)).select(
        "retailer", "model", "source_title", "publishable",
        F.col("reject_reasons").alias("reasons"))


def j2(o):
    return D.dedupe_cheapest(o, D.CHEAPEST_KEYS).select(
        *D.CHEAPEST_KEYS, F.col("price_value").cast("double").alias("price"), "extracted_at")


def j2b(o):
    return D.dedupe_cheapest(o, D.CHEAPEST_KEYS_NO_BRAND).select(
        *D.CHEAPEST_KEYS, F.col("price_value").cast("double").alias("price"), "extracted_at")


def j3(o):
    return D.dedupe_cheapest(o, D.PAGE_KEYS).select(
        *D.PAGE_KEYS, "retailer", F.col("price_value").cast("double").alias("price"))


def _cheapest_sql(keys, shown):
    return over_offers(f"""SELECT {shown} FROM offers QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)}
 ORDER BY price_value ASC NULLS LAST, _ord) = 1""")


_SEVEN = "brand, retailer, device_type, model, capacity_gb, offer_type, term_months, CAST(price_value AS DOUBLE) AS price, extracted_at"


def _split(raw):
    canon = N.canonicalize(raw)
    return canon.where(F.col("snapshot_id") < CUT), canon.where(F.col("snapshot_id") >= CUT)


def _report(fresh, every):
    """Retailers whose validation sample lacks stock information are blocked."""
    checks = validation_sample(fresh).select("retailer", F.col("in_stock").isNotNull().alias("matched"))
    return V.gate(checks, every.select("retailer").distinct())


def j5(raw):
    old, new = _split(raw)
    return _show(M.merge_validated(old, new, _report(new, N.canonicalize(raw)), M.selected_keys(new)))


def j4(raw):
    old, new = _split(raw)
    names = new.where(F.col("retailer").isin("Amazon", "Media Markt", "Orange")).select("retailer").distinct()
    return _show(M.merge_slices(old, new, names, M.selected_keys(new)))


def j6(raw):
    return M.selected_keys(_split(raw)[1])


SAMPLE_ORDER = f"""{cases('offer_type', fixed.VALIDATION_PRIORITY, '9')}, model, coalesce(capacity_gb, 0), _ord"""


def _sample_sql(source):
    return f"""SELECT * FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY retailer, {norm('model')},
 capacity_gb, {norm('offer_type')}, term_months, source_url ORDER BY {SAMPLE_ORDER}) = 1)
 QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY {SAMPLE_ORDER}) <= 3"""


_GATE = f""", old AS (SELECT * FROM canon WHERE snapshot_id < '{CUT}'), new AS (SELECT * FROM canon WHERE snapshot_id >= '{CUT}'),
 sample AS ({_sample_sql('new')}), report AS (SELECT r.retailer, count(s.retailer) AS n_rows,
 count(s.retailer) FILTER (s.in_stock IS NULL) AS n_mismatches,
 (count(s.retailer) = 0 OR count(s.retailer) FILTER (s.in_stock IS NULL) > 0) AS blocked_publication
 FROM (SELECT DISTINCT retailer FROM canon) r LEFT JOIN sample s USING (retailer) GROUP BY r.retailer)"""


def _keys(source):
    return f"""SELECT DISTINCT {norm('brand')} AS k_brand, {norm('device_type')} AS k_device, {norm('model')} AS k_model,
 capacity_gb AS k_capacity FROM {source} WHERE {norm('retailer')} = 'home store'"""


def _merge_sql(open_sql, fresh_where):
    return over_raw(CANON + FEATURES + f""", old AS (SELECT * FROM reasons WHERE snapshot_id < '{CUT}'),
 new AS (SELECT * FROM reasons WHERE snapshot_id >= '{CUT}'), sample AS ({_sample_sql('new')}),
 report AS (SELECT r.retailer, (count(s.retailer) = 0 OR count(s.retailer) FILTER (s.in_stock IS NULL) > 0)
  AS blocked_publication FROM (SELECT DISTINCT retailer FROM reasons) r LEFT JOIN sample s USING (retailer) GROUP BY 1),
 keys AS ({_keys('new')}), opened AS ({open_sql}),
 stacked AS (SELECT *, 0 AS batch FROM old WHERE NOT (retailer IN (SELECT retailer FROM opened) AND EXISTS (
  SELECT 1 FROM keys WHERE k_brand = {norm('brand')} AND k_device = {norm('device_type')} AND k_model = mn
  AND k_capacity IS NOT DISTINCT FROM capacity_gb))
  UNION ALL SELECT *, 1 AS batch FROM new WHERE {fresh_where})
 SELECT {SHOWN} FROM ({_dedupe_sql('stacked', 'batch, _ord')})""")


def q8(o):
    """Details resolved for products: other capacity for some, out of stock for some."""
    rows = o.withColumn("row_id", F.col("_ord")).withColumn("connectivity", G.connectivity(normalize_text(F.col("model"))))
    det = o.where("term_months IS NULL").select(
        F.col("_ord").alias("row_id"),
        F.when(F.col("price_value") > 2000, F.col("capacity_gb") + 1).otherwise(F.col("capacity_gb")).alias("d_capacity"),
        F.concat(F.col("product_code"), F.lit("XX")).alias("d_sku"),
        G.connectivity(normalize_text(F.concat(F.col("model"), F.when(F.col("price_value") < 100, " LTE").otherwise("")))).alias("d_connectivity"),
        (F.col("price_value") * 2).cast("decimal(18,4)").alias("d_price"),
        F.concat(F.lit("Ficha "), F.col("model")).alias("d_title"),
        F.lit(None).cast("string").alias("d_url"), F.col("in_stock").alias("d_stock"))
    return V.revalidate(rows, det).select("retailer", "model", "capacity_gb", "term_months", "in_stock",
                                          "source_title", F.col("price_value").cast("double").alias("price"))


def _live(o):
    rows = o.where(F.col("snapshot_id") < CUT).where("price_value IS NOT NULL").withColumn("row_id", F.col("_ord")).withColumn("product", F.col("brand"))
    live = o.where(F.col("snapshot_id") >= CUT).where("price_value IS NOT NULL").withColumn("product", F.col("brand"))
    return rows, live


def h6(o):
    rows, live = _live(o)
    return V.check_live(rows, live).select("retailer", "model", "offer_type", "term_months",
                                           F.col("price_value").cast("double").alias("price"), "matched")


# a third of the pages show another price, some one within the tolerance
TEXT = """'Precio ' || replace(CAST(price_value + CASE WHEN capacity_gb = 512 THEN 7 WHEN capacity_gb = 256 THEN 0.75 ELSE 0 END AS STRING), '.', ',') || ' EUR ' || CASE WHEN in_stock
 THEN 'en ' || coalesce(CAST(term_months AS STRING), '') || ' meses' ELSE 'sin mas' END"""


def q4(o):
    return o.select("retailer", "model", "offer_type", "term_months", F.expr(TEXT).alias("text"), "price_value").select(
        "retailer", "model", "offer_type", "term_months", "text",
        V.price_in_text(F.col("text"), F.col("offer_type"), F.col("term_months"), F.col("price_value")).alias("shown"))


def q5(raw):
    old, new = _split(raw)
    return _report(new, N.canonicalize(raw))


def q6(raw):
    old, new = _split(raw)
    rep = _report(new, N.canonicalize(raw))
    return V.report_summary(rep, new, M.selected_keys(new))


def lineitem(fn):
    return lambda spark, sf: fn(read_table(spark, sf, "lineitem"))


def n8(o):
    from offerscope.operators.compare import groups

    g = groups(o)
    return g.select("model", "capacity_gb", "offer_type",
                    pct_from(F.col("best_price"), F.col("base_price"), 1).alias("pct1"),
                    pct_from(F.col("best_price"), F.col("base_price"), 2).alias("pct2"))


def n12(spark, sf):
    o = read_table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        N.snapshot_label(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("manual"), F.lit("all"),
                         F.col("o_custkey"), F.col("o_orderkey").cast("string")).alias("label"),
        N.day_badge(day, F.lit("1998-01-02").cast("date")).alias("badge"))


def n15(spark, sf):
    """Products with their price points; those without any keep a placeholder row."""
    p, li = read_table(spark, sf, "part"), read_table(spark, sf, "lineitem")
    points = li.select("l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber")
    joined = p.join(points, p.p_partkey == points.l_partkey, "left")
    return joined.select(
        F.col("p_name").alias("product"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"),
        F.coalesce(F.concat(F.lit("shop_"), F.col("l_suppkey").cast("string")), F.lit("N/A")).alias("source"),
        round_half_up(F.coalesce("l_extendedprice", F.lit(0.0))).alias("price"),
        F.coalesce(F.col("l_linenumber"), F.lit(0)).alias("instalments"))


QUERIES = {
    "n1_normalize_text": lambda spark, sf: spread(read_table(spark, sf, "documents")).select(
        "doc_id", normalize_text(F.col("text")).alias("text_n")),
    "n2_canonicalize": _r(lambda r: _show(N.canonicalize(r))),
    "n3_retailer_alias": _r(lambda r: r.select(N.retailer_name(F.col("retailer")).alias("retailer"),
                                               N.retailer_slug(F.col("retailer_slug")).alias("slug"))
                            .groupBy("retailer", "slug").agg(F.count("*").alias("n"))),
    "n4_capture_kind": _r(lambda r: r.select("retailer", "offer_type", "data_quality_tier",
                                             F.col("price_capture_kind").alias("given"),
                                             N.capture_kind({c: F.col(c) for c in r.columns}).alias("kind"))
                          .groupBy("retailer", "offer_type", "data_quality_tier", "given", "kind")
                          .agg(F.count("*").alias("n"))),
    "n5_public": _q(N.to_public),
    "n6_labels": _q(lambda o: o.select(
        "offer_type", N.modality_label(F.col("offer_type")).alias("label"),
        N.modality_order(F.col("offer_type")).alias("place"), N.price_unit(F.col("offer_type")).alias("unit"),
        N.display_unit(F.col("offer_type"), F.lit("")).alias("shown_unit"))
        .groupBy("offer_type", "label", "place", "unit", "shown_unit").agg(F.count("*").alias("n"))),
    "n7_total_cost": _q(lambda o: o.select(
        "retailer", "model", "offer_type", "term_months",
        N.total_cost(F.col("offer_type"), F.col("price_value"), F.col("term_months")).alias("total"),
        N.total_cost_or_price(F.col("price_value"), F.col("term_months")).alias("total_or_price"))),
    "n8_deltas": _q(n8),
    "n9_annuity": lineitem(lambda li: li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.annuity(F.col("l_extendedprice"), F.col("l_linenumber") * 6, F.col("l_tax") * 100).alias("instalment"))),
    "n10_instalment": lineitem(lambda li: li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.instalment_or_share(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")),
                              F.col("l_extendedprice"), F.col("l_linenumber") * 6).alias("monthly"))),
    "n11_formats": _q(lambda o: o.select(
        "retailer", "model", N.capacity_label(F.col("capacity_gb")).alias("size"),
        N.euro_text(F.floor(F.col("price_value") * 100) / 100).alias("euro"),
        N.signed_euro_text(F.floor((F.col("price_value") - 2000) * 100) / 100).alias("signed"))),
    "n12_labels_badges": n12,
    "n13_seeds": _q(lambda o: o.select(
        "brand", "model", "capacity_gb", "product_code", N.either(F.col("device_type"), "mobile").alias("device_type"),
        N.either(F.col("product_family"), F.col("brand")).alias("product_family")).distinct()),
    "n14_product_key": _q(lambda o: o.select(
        N.product_key(F.col("brand"), F.col("model"), F.col("capacity_gb")).alias("key")).distinct()),
    "n15_product_rows": n15,
    "n16_model_slug": _r(lambda r: r.select(
        N.model_slug(F.col("brand"), F.concat_ws(" ", "brand", "source_title"), F.concat(F.col("capacity_gb"), F.lit("GB"))).alias("slug")).distinct()),
    "l6_publishable": _r(reasons),
    "g_reason_counts": _r(lambda r: G.reason_counts(N.canonicalize(r))),
    "j1_dedupe_quality": _r(lambda r: _show(D.dedupe_by_quality(N.canonicalize(r)))),
    "j2_dedupe_cheapest": _q(j2),
    "j2_dedupe_cheapest_no_brand": _q(j2b),
    "j3_dedupe_page_rows": _q(j3),
    "j4_slice_replacement": _r(j4),
    "j5_validated_merge": _r(j5),
    "j6_selected_keys": _r(j6),
    "j7_targets": _q(lambda o: D.derive_targets(o, BASE).drop("_ord")),
    "j8_distinct_offers": _q(lambda o: D.distinct_offers(o, ["retailer", "model"]).select(
        "retailer", "model", "offer_type", "term_months", F.col("price_value").cast("double").alias("price"), "extracted_at")),
    "j9_most_confident": _q(lambda o: D.most_confident(
        o.withColumn("confidence", F.when(F.col("in_stock"), 0.9).otherwise(0.5)),
        ["retailer", "offer_type", normalize_text(F.col("model")), "capacity_gb"]).select(
        "retailer", "offer_type", "model", "capacity_gb", "confidence", F.col("price_value").cast("double").alias("price"))),
    "j9_distinct_in_order": _q(lambda o: D.distinct_in_order(o, normalize_text(F.col("model"))).select("value")),
    "j10_best_seed": _q(lambda o: D.best_seed_per_model(o, F.struct(
        (F.col("product_code") != "").cast("int"), F.length("product_code"))).select(
        "device_type", "model", "capacity_gb", "retailer", "extracted_at")),
    "j11_run_grouping": _q(M.run_grouping),
    "q3_validation_sample": _q(lambda o: validation_sample(o).select(
        "retailer", "offer_type", "model", "capacity_gb", "term_months", F.col("price_value").cast("double").alias("price"))),
    "q4_price_in_text": _q(q4),
    "q5_retailer_gate": _r(q5),
    "q6_report_summary": _r(q6),
    "q8_revalidate": _q(q8),
    "h6_live_check": _q(h6),
}

_EUR = "replace(replace(replace(format('{:,.2f}', CAST(floor({x} * 100) AS DOUBLE) / 100), ',', '@'), '.', ','), '@', '.')"


def _eur(x):
    return _EUR.replace("{x}", x)


_SLUG_N = f"trim(regexp_replace(regexp_replace({norm('NAME')}, '[^a-z0-9\\s\\-/]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _plain(x):
    return _SLUG_N.replace("NAME", x)


ORACLE = {
    "n1_normalize_text": f"SELECT doc_id, {norm('text')} AS text_n FROM documents",
    "n2_canonicalize": over_raw(CANON + f" SELECT {SHOWN} FROM canon"),
    "n3_retailer_alias": over_raw(f"""SELECT {cases('trim(retailer)', fixed.RETAILER_ALIASES, 'trim(retailer)')} AS retailer,
 {cases('trim(retailer_slug)', fixed.SLUG_ALIASES, 'trim(retailer_slug)')} AS slug, count(*) AS n FROM raw GROUP BY ALL"""),
    "n4_capture_kind": over_raw(f"""SELECT retailer, offer_type, data_quality_tier, price_capture_kind AS given, {_KIND} AS kind,
 count(*) AS n FROM raw GROUP BY ALL"""),
    "n5_public": over_offers(f"""SELECT extracted_at AS timestamp_extraccion, retailer AS competidor, source_url AS url_producto,
 brand AS marca, model AS modelo, capacity_gb AS capacidad, offer_type AS modalidad,
 {cases('offer_type', fixed.MODALITY_LABELS, 'offer_type')} AS modalidad_label, price_text AS precio_texto,
 CAST(price_value AS DOUBLE) AS precio_valor, 'EUR' AS moneda, in_stock AS disponibilidad, device_type, term_months,
 data_quality_tier AS quality_tier, source_title, retailer_slug FROM offers"""),
    "n6_labels": over_offers(f"""SELECT offer_type, {cases('offer_type', fixed.MODALITY_LABELS, 'offer_type')} AS label,
 {cases('offer_type', fixed.MODALITY_ORDER, '99')} AS place,
 CASE WHEN offer_type = 'cash' THEN 'EUR' ELSE 'EUR/month' END AS unit,
 CASE WHEN offer_type = 'cash' THEN 'EUR' ELSE 'EUR/mes' END AS shown_unit, count(*) AS n FROM offers GROUP BY ALL"""),
    "n7_total_cost": over_offers(f"""SELECT retailer, model, offer_type, term_months, CASE WHEN offer_type = 'cash'
 THEN CAST(price_value AS DOUBLE) WHEN term_months > 0 THEN {r2('CAST(price_value AS DOUBLE) * term_months')} END AS total,
 CASE WHEN coalesce(term_months, 0) <> 0 THEN {r2('CAST(price_value AS DOUBLE) * term_months')}
 ELSE CAST(price_value AS DOUBLE) END AS total_or_price FROM offers"""),
    "n8_deltas": over_offers(f""", g AS (SELECT model, capacity_gb, offer_type, CAST(min(price_value) AS DOUBLE) AS p,
 nullif(CAST(min(price_value) FILTER (retailer = '{BASE}') AS DOUBLE), 0) AS b FROM offers GROUP BY ALL)
 SELECT model, capacity_gb, offer_type, {r2('(p - b) / b * CAST(100.0 AS DOUBLE)', '10.0')} AS pct1,
 {r2('(p - b) / b * CAST(100.0 AS DOUBLE)')} AS pct2 FROM g"""),
    "n9_annuity": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice <> 0 THEN
 {r2('CASE WHEN l_tax * 100 <= 0 THEN l_extendedprice / (l_linenumber * 6) ELSE l_extendedprice * (l_tax * 100 / CAST(1200.0 AS DOUBLE)) * pow(CAST(1.0 AS DOUBLE) + l_tax * 100 / CAST(1200.0 AS DOUBLE), l_linenumber * 6) / (pow(CAST(1.0 AS DOUBLE) + l_tax * 100 / CAST(1200.0 AS DOUBLE), l_linenumber * 6) - 1) END')} END AS instalment FROM lineitem""",
    "n10_instalment": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R'
 THEN l_extendedprice ELSE {r2('l_extendedprice / (l_linenumber * 6)')} END AS monthly FROM lineitem""",
    "n11_formats": over_offers(f"""SELECT retailer, model, CASE WHEN capacity_gb IS NULL THEN '-' WHEN capacity_gb = 1024
 THEN '1 TB' ELSE CAST(capacity_gb AS VARCHAR) || ' GB' END AS size, {_eur('price_value')} AS euro,
 CASE WHEN floor((price_value - 2000) * 100) > 0 THEN '+' ELSE '' END || {_eur('(price_value - 2000)')} AS signed FROM offers"""),
    "n12_labels_badges": """SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 16) || ' | manual | all | '
 || o_custkey || ' registros' AS label, CASE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-02')
 WHEN 0 THEN 'HOY' WHEN 1 THEN 'AYER' END AS badge FROM orders""",
    "n13_seeds": over_offers("""SELECT DISTINCT brand, model, capacity_gb, product_code, device_type, product_family FROM offers"""),
    "n14_product_key": over_offers(f"""SELECT DISTINCT {norm('brand')} || '|' || {norm('model')} || '|'
 || coalesce(CAST(capacity_gb AS VARCHAR), 'na') AS key FROM offers"""),
    "n15_product_rows": f"""SELECT p_name AS product, p_brand AS brand, p_partkey AS part,
 coalesce('shop_' || l_suppkey, 'N/A') AS source, {r2('coalesce(l_extendedprice, 0.0::DOUBLE)')} AS price,
 coalesce(l_linenumber, 0) AS instalments FROM part LEFT JOIN lineitem
 ON p_partkey = l_partkey""",
    "n16_model_slug": over_raw(f""", s AS (SELECT {_plain("concat_ws(' ', brand, source_title)")} AS n, {_plain('brand')} AS b,
 lower(capacity_gb || 'GB') AS size FROM raw), t AS (SELECT CASE WHEN starts_with(n, b) THEN trim(substr(n, length(b) + 1))
 ELSE n END AS n, size FROM s) SELECT DISTINCT regexp_replace(regexp_replace(trim(CASE WHEN size <> '' AND NOT contains(n, size)
 THEN n || ' ' || size ELSE n END), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM t"""),
    "l6_publishable": over_raw(CANON + FEATURES + """ SELECT retailer, model, source_title, why = '' AS publishable,
 why AS reasons FROM reasons"""),
    "g_reason_counts": over_raw(CANON + FEATURES + """ SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN why = ''
 THEN ['none'] ELSE string_split(why, ',') END) AS reason FROM reasons) GROUP BY 1"""),
    "j1_dedupe_quality": over_raw(CANON + FEATURES + f" SELECT {SHOWN} FROM ({_dedupe_sql('reasons')})"),
    "j2_dedupe_cheapest": _cheapest_sql(D.CHEAPEST_KEYS, _SEVEN),
    "j2_dedupe_cheapest_no_brand": _cheapest_sql(D.CHEAPEST_KEYS_NO_BRAND, _SEVEN),
    "j3_dedupe_page_rows": _cheapest_sql(D.PAGE_KEYS, "model, capacity_gb, offer_type, term_months, source_url, retailer, CAST(price_value AS DOUBLE) AS price"),
    "j4_slice_replacement": _merge_sql("SELECT retailer FROM new WHERE retailer IN ('Amazon', 'Media Markt', 'Orange')", "true"),
    "j5_validated_merge": _merge_sql("SELECT retailer FROM report WHERE NOT blocked_publication",
                                     "retailer IN (SELECT retailer FROM opened)"),
    "j6_selected_keys": over_raw(CANON + _GATE + f" {_keys('new')}"),
    "j7_targets": over_offers(f"""SELECT brand, model, capacity_gb, product_code, device_type, product_family, source_url
 FROM offers WHERE retailer = '{BASE}' QUALIFY row_number() OVER (PARTITION BY model, capacity_gb ORDER BY _ord) = 1"""),
    "j8_distinct_offers": over_offers("""SELECT retailer, model, offer_type, term_months, CAST(price_value AS DOUBLE) AS price,
 extracted_at FROM offers QUALIFY row_number() OVER (PARTITION BY retailer, model, offer_type, price_value, term_months
 ORDER BY _ord) = 1"""),
    "j9_most_confident": over_offers(f"""SELECT retailer, offer_type, model, capacity_gb, CAST(c AS DOUBLE) AS confidence,
 CAST(price_value AS DOUBLE) AS price FROM (SELECT *, CASE WHEN in_stock THEN 0.9 ELSE 0.5 END AS c FROM offers)
 QUALIFY row_number() OVER (PARTITION BY retailer, offer_type, {norm('model')}, capacity_gb ORDER BY c DESC, _ord) = 1"""),
    "j9_distinct_in_order": over_offers(f"SELECT DISTINCT {norm('model')} AS value FROM offers"),
    "j10_best_seed": over_offers(f"""SELECT device_type, model, capacity_gb, retailer, extracted_at FROM offers QUALIFY
 row_number() OVER (PARTITION BY {norm('device_type')}, {norm('model')}, capacity_gb ORDER BY product_code <> '' DESC,
 length(product_code) DESC, _ord) = 1"""),
    "j11_run_grouping": over_offers("SELECT retailer, count(*) AS n FROM offers GROUP BY 1"),
    "q3_validation_sample": over_offers(f"""SELECT retailer, offer_type, model, capacity_gb, term_months,
 CAST(price_value AS DOUBLE) AS price FROM ({_sample_sql('offers')})"""),
    "q4_price_in_text": over_offers(f""", t AS (SELECT *, {TEXT} AS text FROM offers), n AS (SELECT *, {norm('text')} AS n FROM t),
 w AS (SELECT *, list_concat(regexp_split_to_array(replace(n, 'eur', '€'), '\\s+'), regexp_extract_all(n, '(\\d{{1,5}}(?:[.\\s]\\d{{3}})*(?:,\\d{{1,2}})?)\\s*(?:€|eur)', 1)) AS words FROM n)
 SELECT retailer, model, offer_type, term_months, text, coalesce(coalesce(text, '') <> '' AND price_value IS NOT NULL
 AND len(list_filter(words, lambda v: abs({num("replace(replace(replace(v, ' ', ''), '.', ''), ',', '.')")} - CAST(price_value AS DOUBLE)) <= 1.0)) > 0
 AND (offer_type = 'cash' OR ((term_months IS NULL OR contains(n, CAST(term_months AS VARCHAR))) AND regexp_matches(n, 'mes|cuota|plazo'))), false) AS shown FROM w"""),
    "q5_retailer_gate": over_raw(CANON + _GATE + """ SELECT retailer, n_rows, n_mismatches,
 CASE WHEN blocked_publication THEN 'failed' ELSE 'passed' END AS status, blocked_publication FROM report"""),
    "q6_report_summary": over_raw(CANON + _GATE + f""" SELECT count(*) AS n_retailers, count(*) FILTER (blocked_publication) AS n_blocked,
 (SELECT count(*) FROM new) AS raw_record_count, (SELECT count(*) FROM ({_keys('new')})) AS selected_key_count FROM report"""),
    "q8_revalidate": over_offers("""SELECT retailer, model, capacity_gb, term_months, in_stock,
 CASE WHEN term_months IS NULL THEN 'Ficha ' || model ELSE source_title END AS source_title,
 CAST(CASE WHEN term_months IS NULL THEN coalesce(price_value * 2, price_value) ELSE price_value END AS DOUBLE) AS price
 FROM offers WHERE term_months IS NOT NULL OR NOT (coalesce(NOT in_stock, false)
 OR coalesce(price_value > 2000 AND capacity_gb IS NOT NULL, false)
 OR coalesce(price_value < 100 AND NOT contains(model, '5G'), false))"""),
    "h6_live_check": over_offers(f"""SELECT retailer, model, offer_type, term_months, CAST(price_value AS DOUBLE) AS price,
 EXISTS (SELECT 1 FROM offers l WHERE l.snapshot_id >= '{CUT}' AND l.brand = o.brand AND l.offer_type = o.offer_type
 AND abs(CAST(l.price_value AS DOUBLE) - CAST(o.price_value AS DOUBLE)) <= 1.0
 AND (o.term_months IS NULL OR l.term_months IS NULL OR l.term_months = o.term_months)) AS matched
 FROM offers o WHERE o.snapshot_id < '{CUT}' AND price_value IS NOT NULL"""),
}
