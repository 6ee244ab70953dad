"""Queries on comparison, coverage, gaps, profiles and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.operators import compare as C
from offerscope.operators import position as P
from offerscope.operators import profile as R
from offerscope.operators.dedupe import latest_rows
from offerscope.operators.joins import join_null_safe
from offerscope.plans.sqltext import BASE, cases, dbl, norm, over_offers, r2
from offerscope.sources.tables import offers

LABEL = cases("offer_type", fixed.MODALITY_LABELS, "offer_type")
ISBASE = f"{norm('retailer')} = 'home store'"
MEAN = r2("CAST(sum(price_value) AS DOUBLE) / count(price_value)")


def catalogue(df):
    """Snapshots with a creation time, as the snapshot catalogue would list them."""
    return df.groupBy("snapshot_id").agg(F.max("extracted_at").alias("created_at"))


def _q(fn):
    return lambda spark, sf: fn(offers(spark, sf))


def a1(o):
    return C.compare(o).select(
        "retailer", "model", "capacity_gb", "offer_type", "term_months",
        F.col("price_value").cast("double").alias("price"),
        F.col("best_price").cast("double").alias("best_price"), "best_retailer",
        F.col("base_price").cast("double").alias("base_price"), "saving",
        "diff_vs_base", "diff_pct_vs_base")


PAIRED = f"""g AS (SELECT model, capacity_gb, offer_type, count(*) AS n_offers, min(price_value) AS best,
 arg_min(retailer, (price_value, _ord)) FILTER (price_value IS NOT NULL) AS best_retailer,
 min(price_value) FILTER ({ISBASE}) AS basep FROM offers GROUP BY ALL)"""
SAVING = r2("CAST(basep AS DOUBLE) - CAST(best AS DOUBLE)")
DIFF = r2("CAST(price_value AS DOUBLE) - CAST(basep AS DOUBLE)")
PCT = r2("(CAST(price_value AS DOUBLE) - CAST(nullif(basep,0) AS DOUBLE)) / CAST(nullif(basep,0) AS DOUBLE) * CAST(100.0 AS DOUBLE)")
JOINED = """FROM offers o JOIN g ON o.model = g.model AND o.offer_type = g.offer_type
 AND o.capacity_gb IS NOT DISTINCT FROM g.capacity_gb"""
COMPARED = f""", {PAIRED}, c AS (SELECT o.*, best, best_retailer, basep, {SAVING} AS saving,
 {DIFF} AS diff_vs_base, {PCT} AS diff_pct_vs_base {JOINED})"""


def groups(o):
    return C.groups(o).select("model", "capacity_gb", "offer_type", "n_offers", "best_retailer",
                              F.col("best_price").cast("double").alias("best_price"),
                              F.col("base_price").cast("double").alias("base_price"), "saving")


def a18_rows(o, cap=False):
    c = C.compare(o)
    rows = C.capped_alerts(c) if cap else C.alerts(c)
    return rows.select("model", "capacity_gb", "offer_type", "retailer",
                       F.col("diff_pct_vs_base").alias("pct"),
                       F.col("price_value").cast("double").alias("price"),
                       F.col("base_price").cast("double").alias("base_price"))


ALERTS = f"SELECT * FROM c WHERE retailer <> '{BASE}' AND diff_pct_vs_base <= -5"
MORDER = cases("offer_type", fixed.MODALITY_ORDER, "99")
CAPPED = f"""{ALERTS} ORDER BY {norm('model')}, coalesce(capacity_gb, 0), {MORDER}, model,
 capacity_gb NULLS FIRST, price_value, _ord LIMIT 20"""
ALERT_COLS = "model, capacity_gb, offer_type, retailer, diff_pct_vs_base AS pct, CAST(price_value AS DOUBLE) AS price, CAST(basep AS DOUBLE) AS base_price"


def audit(o, ignore=False):
    return C.audit(latest_rows(C.beside_base(o, ignore_term=ignore)), ignore_term=ignore)


KEY6 = "retailer, brand, model, capacity_gb, offer_type, term_months"
LATEST = f"""latest AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY {KEY6}
 ORDER BY CAST(extracted_at AS TIMESTAMPTZ) DESC, _ord DESC) = 1)"""


def audit_sql(ignore):
    keys = ["brand", "model", "capacity_gb", "offer_type"] + ([] if ignore else ["term_months"])
    on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    part = ", ".join(keys)
    pct = "(CAST(l.price_value AS DOUBLE) - CAST(b.price_value AS DOUBLE)) / CAST(b.price_value AS DOUBLE) * CAST(100.0 AS DOUBLE)"
    return over_offers(f""", {LATEST}, b AS (SELECT * FROM latest WHERE retailer = '{BASE}'
 QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY _ord DESC) = 1)
SELECT l.brand, l.model, l.capacity_gb, l.offer_type, l.term_months,
 {r2('CAST(b.price_value AS DOUBLE)', '10000.0')} AS base_price, l.retailer,
 {r2('CAST(l.price_value AS DOUBLE)', '10000.0')} AS rival_price, {r2(pct)} AS pct_signed,
 {r2('abs(' + pct + ')')} AS pct_abs, b.extracted_at AS base_extracted_at,
 l.extracted_at AS rival_extracted_at, b.source_url AS base_url, l.source_url AS rival_url
FROM latest l JOIN b ON {on}
WHERE l.retailer <> '{BASE}' AND b.price_value <> 0 AND abs({pct}) > 30""")


def evo(o):
    return R.evolution(o, catalogue(o))


EVO = f""", cat AS (SELECT snapshot_id, max(extracted_at) AS created_at FROM offers GROUP BY 1),
 recent AS (SELECT * FROM cat ORDER BY created_at DESC, snapshot_id DESC LIMIT 24),
 evo AS (SELECT o.snapshot_id, o.retailer, {MEAN} AS mean_price, max(created_at) AS created_at
 FROM offers o JOIN recent r USING (snapshot_id)
 WHERE price_value IS NOT NULL AND retailer <> '' GROUP BY 1, 2)"""
TIMELINE_RETAILERS = ["Home Store", "Amazon", "Grover", "Rentik"]


def timeline(o):
    wide = R.timeline(evo(o), TIMELINE_RETAILERS)
    return wide.select("day", *[F.col(f"`{r}`").alias(r.lower().replace(" ", "_")) for r in TIMELINE_RETAILERS])


def h1(o):
    return C.with_base_price(o).select("retailer", "model", "capacity_gb", "offer_type",
                                       F.col("price_value").cast("double").alias("price"),
                                       F.col("base_price").cast("double").alias("base_price"))


def h2(o):
    right = C.base_prices(o, BASE, "last")
    return right.select("model", "capacity_gb", "offer_type",
                        F.col("base_price").cast("double").alias("base_price"))


def a16(o):
    cost = R.min_total_cost(o, ["model", "capacity_gb"])
    ref = R.base_cash_price(o)
    return join_null_safe(cost, ref, ["model", "capacity_gb"], "left")


def a7(o):
    return R.by_model(o)


def kpi(o):
    return R.kpis(o)


def a21_missing_list(o):
    return R.missing_list(o, "Amazon")


WATCHED = ["Amazon", "Grover", "Rentik", "Orange"]


def low_cov(o):
    return R.low_coverage(R.coverage_counters(o), 600, WATCHED, ["Media Markt"])


COUNTERS = ", ".join(
    f"count(DISTINCT (device_type, model, capacity_gb)) FILTER (offer_type = '{m}') AS n_{m}"
    for m in fixed.MODALITY_LABELS)

QUERIES = {
    "a1_compare": _q(a1),
    "a1_groups": _q(groups),
    "a2_bars": _q(lambda o: C.bars(C.groups(o))),
    "a3_coverage": _q(C.coverage),
    "a4_by_modality": _q(R.by_modality),
    "a5_gap": _q(C.gap),
    "a6_by_competitor": _q(R.by_competitor),
    "a7_by_model": _q(a7),
    "a8_evolution": _q(evo),
    "a9_kpis": _q(kpi),
    "a10_filters_meta": _q(R.filters_meta),
    "a10_filters_range": _q(R.filters_range),
    "a11_table_meta": _q(lambda o: R.run_counts(o).where("value <> ''").select("facet", "value")),
    "a12_best_price": _q(lambda o: P.best_price(o).withColumn("best_price", F.col("best_price").cast("double"))),
    "a13_positioning": _q(P.positioning),
    "a14_scope_summary": _q(lambda o: R.scope_summary(o.where("offer_type = 'cash'"))),
    "a14_cheapest_vs_base": _q(lambda o: R.cheapest_vs_base(o.where("offer_type = 'cash'"))),
    "a15_best_per_retailer": _q(lambda o: R.best_per_retailer(o, ["offer_type"])),
    "a16_total_cost": _q(a16),
    "a17_headline": _q(R.headline),
    "a18_alerts": _q(a18_rows),
    "a18_alerts_capped": _q(lambda o: a18_rows(o, True)),
    "a18_by_modality": _q(lambda o: C.alert_counts(C.alerts(C.compare(o)), "offer_type")),
    "a18_by_retailer": _q(lambda o: C.alert_counts(C.alerts(C.compare(o)), "retailer")),
    "a19_coverage_stats": _q(lambda o: C.coverage_stats(C.coverage(o))),
    "a20_timeline": _q(timeline),
    "a20_timeline_long": _q(lambda o: R.timeline_long(evo(o))),
    "a21_run_counts": _q(R.run_counts),
    "a21_coverage_by_device": _q(R.coverage_by_device),
    "a21_missing_vs_base": _q(R.missing_vs_base),
    "a21_missing_list": _q(a21_missing_list),
    "a21_terms": _q(R.terms_per_product),
    "a26_coverage_counters": _q(R.coverage_counters),
    "a27_most_frequent": _q(R.most_frequent),
    "h1_base_price": _q(h1),
    "h2_last_base_price": _q(h2),
    "q1_latest_rows": _q(lambda o: latest_rows(o).select(
        "retailer", "brand", "model", "capacity_gb", "offer_type", "term_months",
        F.col("price_value").cast("double").alias("price"), "extracted_at")),
    "q2_audit": _q(audit),
    "q2_audit_ignoring_term": _q(lambda o: audit(o, True)),
    "q7_low_coverage": _q(low_cov),
}

SKUKEYS = f"""k AS (SELECT DISTINCT retailer, model, capacity_gb, {ISBASE} AS b FROM offers),
 bk AS (SELECT DISTINCT model, capacity_gb FROM k WHERE b)"""
COVERAGE = f""", {SKUKEYS}, cov AS (SELECT retailer, count(*) FILTER (bk.model IS NOT NULL) AS matched,
 (SELECT count(*) FROM bk) AS total_base,
 {r2('CAST(count(*) FILTER (bk.model IS NOT NULL) AS DOUBLE) / (SELECT count(*) FROM bk) * CAST(100.0 AS DOUBLE)')} AS coverage_pct
 FROM k LEFT JOIN bk ON k.model = bk.model AND k.capacity_gb IS NOT DISTINCT FROM bk.capacity_gb
 WHERE NOT b GROUP BY retailer)"""
DEVKEYS = "SELECT DISTINCT retailer, device_type, model, capacity_gb FROM offers"

_POSITION = f""", best AS (SELECT model, capacity_gb, retailer, min(price_value) AS p FROM offers
 WHERE price_value IS NOT NULL AND model <> '' AND retailer <> '' GROUP BY ALL),
two AS (SELECT *, row_number() OVER (PARTITION BY model, capacity_gb ORDER BY p, retailer) AS rn FROM best),
lead AS (SELECT model, capacity_gb, max(p) FILTER (rn = 1) AS p1, max(retailer) FILTER (rn = 1) AS r1,
 max(p) FILTER (rn = 2) AS p2 FROM two GROUP BY ALL),
vs AS (SELECT b.retailer, b.p, b.p - CASE WHEN b.retailer = r1 THEN p2 ELSE p1 END AS g
 FROM best b JOIN lead l ON b.model = l.model AND b.capacity_gb IS NOT DISTINCT FROM l.capacity_gb),
st AS (SELECT retailer, count(*) AS sku_count, CAST(sum(p) AS DOUBLE) / count(*) AS avgp, count(g) AS matched,
 count(*) FILTER (g <= 0) AS wins, count(*) FILTER (g > 0) AS losses,
 CAST(sum(g) AS DOUBLE) / nullif(count(g), 0) AS avgg FROM vs GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY sku_count DESC, {norm('retailer')}, retailer) AS coverage_rank,
 greatest(5, CAST(round_even(sku_count * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) AS thr FROM st),
ld AS (SELECT a.retailer, arg_min(b.retailer, (b.avgp, {norm('b.retailer')}, b.retailer)) AS price_leader,
 min(b.avgp) AS leadp FROM rk a JOIN rk b ON b.sku_count >= a.thr OR b.retailer = a.retailer GROUP BY 1),
tm AS (SELECT retailer, min(term_months) AS min_term, max(term_months) AS max_term FROM offers GROUP BY 1)
SELECT retailer, sku_count, coverage_rank, thr AS relevant_threshold, {r2('avgp')} AS avg_price, price_leader,
 {r2('leadp')} AS leader_avg_price, matched, wins, losses, {r2('avgg')} AS avg_gap, min_term, max_term,
 CASE WHEN coverage_rank = 1 AND avgg <= 5 THEN 'bien posicionado' WHEN avgg <= 0 THEN 'competitivo'
 WHEN avgg <= 15 THEN 'correcto, pero no lider' ELSE 'por encima del mercado' END AS label
FROM rk JOIN ld USING (retailer) LEFT JOIN tm USING (retailer)"""

ORACLE = {
    "a1_compare": over_offers(COMPARED + """ SELECT retailer, model, capacity_gb, offer_type, term_months,
 CAST(price_value AS DOUBLE) AS price, CAST(best AS DOUBLE) AS best_price, best_retailer,
 CAST(basep AS DOUBLE) AS base_price, saving, diff_vs_base, diff_pct_vs_base FROM c"""),
    "a1_groups": over_offers(f""", {PAIRED} SELECT model, capacity_gb, offer_type, n_offers, best_retailer,
 CAST(best AS DOUBLE) AS best_price, CAST(basep AS DOUBLE) AS base_price, {SAVING} AS saving FROM g"""),
    "a2_bars": over_offers(f""", {PAIRED} SELECT trim(model || ' ' || CASE WHEN coalesce(capacity_gb, 0) = 0
 THEN '' ELSE CAST(capacity_gb AS VARCHAR) END || 'GB') AS product, offer_type, {LABEL} AS label,
 {r2(dbl('best'))} AS best_price, {r2(dbl('basep'))} AS base_price, {SAVING} AS gap
 FROM g WHERE best IS NOT NULL"""),
    "a3_coverage": over_offers(COVERAGE + " SELECT * FROM cov"),
    "a4_by_modality": over_offers(f"""SELECT offer_type, {MEAN} AS mean_price, count(*) AS n, {LABEL} AS label
 FROM offers WHERE price_value IS NOT NULL AND offer_type <> '' GROUP BY offer_type"""),
    "a5_gap": over_offers(f""", b AS (SELECT model, capacity_gb, offer_type, arg_max(price_value, _ord) AS bp
 FROM offers WHERE {ISBASE} AND price_value IS NOT NULL GROUP BY ALL)
SELECT retailer, {r2('CAST(sum(price_value - bp) AS DOUBLE) / count(*)')} AS mean_gap, count(*) AS n
FROM offers o JOIN b ON o.model = b.model AND o.offer_type = b.offer_type
 AND o.capacity_gb IS NOT DISTINCT FROM b.capacity_gb
WHERE NOT ({ISBASE}) AND price_value IS NOT NULL GROUP BY retailer"""),
    "a6_by_competitor": over_offers(f"""SELECT retailer, {MEAN} AS mean_price,
 {r2(dbl('min(price_value)'))} AS min_price, {r2(dbl('max(price_value)'))} AS max_price, count(*) AS n
 FROM offers WHERE price_value IS NOT NULL AND retailer <> '' GROUP BY retailer"""),
    "a7_by_model": over_offers(f"""SELECT model, {MEAN} AS mean_price, count(*) AS n FROM offers
 WHERE price_value IS NOT NULL AND model <> '' GROUP BY model ORDER BY n DESC, min(_ord) LIMIT 12"""),
    "a8_evolution": over_offers(EVO + " SELECT * FROM evo"),
    "a9_kpis": over_offers("""SELECT count(*) AS n_rows, count(DISTINCT (model, capacity_gb)) AS n_products,
 count(DISTINCT nullif(retailer, '')) AS n_retailers, coalesce(max(extracted_at), '') AS latest_at FROM offers"""),
    "a10_filters_meta": over_offers("""SELECT DISTINCT facet, value FROM (
 SELECT 'retailer' AS facet, nullif(retailer, '') AS value FROM offers
 UNION ALL SELECT 'model', nullif(model, '') FROM offers
 UNION ALL SELECT 'capacity_gb', CAST(capacity_gb AS VARCHAR) FROM offers
 UNION ALL SELECT 'offer_type', nullif(offer_type, '') FROM offers
 UNION ALL SELECT 'in_stock', CAST(in_stock AS VARCHAR) FROM offers) WHERE value IS NOT NULL"""),
    "a10_filters_range": over_offers("""SELECT CAST(min(price_value) AS DOUBLE) AS price_min,
 CAST(max(price_value) AS DOUBLE) AS price_max, coalesce(max(extracted_at), '') AS latest_at,
 count(*) AS n_rows FROM offers"""),
    "a11_table_meta": over_offers("""SELECT DISTINCT facet, value FROM (SELECT 'retailer' AS facet, retailer AS value
 FROM offers UNION ALL SELECT 'data_quality_tier', data_quality_tier FROM offers
 UNION ALL SELECT 'offer_type', offer_type FROM offers) WHERE value <> ''"""),
    "a12_best_price": over_offers("""SELECT model, capacity_gb, retailer, CAST(min(price_value) AS DOUBLE) AS best_price
 FROM offers WHERE price_value IS NOT NULL AND model <> '' AND retailer <> '' GROUP BY ALL"""),
    "a13_positioning": over_offers(_POSITION),
    "a14_scope_summary": over_offers(f"""SELECT count(*) AS n, {MEAN} AS mean_price,
 {r2(dbl('min(price_value)'))} AS min_price, {r2(dbl('max(price_value)'))} AS max_price
 FROM offers WHERE offer_type = 'cash'"""),
    "a14_cheapest_vs_base": over_offers(f""", s AS (SELECT * FROM offers WHERE offer_type = 'cash'),
 b AS (SELECT * FROM s WHERE price_value IS NOT NULL ORDER BY price_value, _ord LIMIT 1),
 m AS (SELECT min(price_value) AS mine FROM s WHERE {ISBASE})
 SELECT retailer, model, capacity_gb, CAST(price_value AS DOUBLE) AS price, CAST(mine AS DOUBLE) AS base_price,
 {r2('CAST(mine AS DOUBLE) - CAST(price_value AS DOUBLE)')} AS base_delta FROM b, m"""),
    "a15_best_per_retailer": over_offers("""SELECT offer_type, retailer, CAST(min(price_value) AS DOUBLE) AS best_price
 FROM offers WHERE price_value IS NOT NULL GROUP BY ALL"""),
    "a16_total_cost": over_offers(f""", t AS (SELECT model, capacity_gb, retailer,
 CAST(min(price_value * term_months) AS DOUBLE) AS total_cost FROM offers WHERE price_value IS NOT NULL
 AND term_months IS NOT NULL AND offer_type IN ('renting_no_insurance', 'renting_with_insurance') GROUP BY ALL),
 r AS (SELECT model, capacity_gb, CAST(arg_min(price_value, _ord) AS DOUBLE) AS cash_price FROM offers
 WHERE price_value IS NOT NULL AND retailer = '{BASE}' AND offer_type = 'cash' GROUP BY ALL)
 SELECT t.model, t.capacity_gb, retailer, total_cost, cash_price FROM t LEFT JOIN r
 ON t.model = r.model AND t.capacity_gb IS NOT DISTINCT FROM r.capacity_gb"""),
    "a17_headline": over_offers("""SELECT count(DISTINCT model) AS n_models, count(DISTINCT retailer) AS n_retailers,
 arg_min(retailer, (price_value, _ord)) FILTER (offer_type LIKE 'renting%') AS renting_retailer,
 CAST(min(price_value) FILTER (offer_type LIKE 'renting%') AS DOUBLE) AS renting_price,
 arg_min(retailer, (price_value, _ord)) FILTER (offer_type = 'cash') AS cash_retailer,
 CAST(min(price_value) FILTER (offer_type = 'cash') AS DOUBLE) AS cash_price
 FROM offers WHERE price_value >= 0"""),
    "a18_alerts": over_offers(f"{COMPARED} SELECT {ALERT_COLS} FROM ({ALERTS})"),
    "a18_alerts_capped": over_offers(f"{COMPARED} SELECT {ALERT_COLS} FROM ({CAPPED})"),
    "a18_by_modality": over_offers(f"{COMPARED} SELECT offer_type, count(*) AS n FROM ({ALERTS}) GROUP BY 1"),
    "a18_by_retailer": over_offers(f"{COMPARED} SELECT retailer, count(*) AS n FROM ({ALERTS}) GROUP BY 1"),
    "a19_coverage_stats": over_offers(COVERAGE + """ SELECT CAST(sum(CAST(coverage_pct AS DECIMAL(18,2))) AS DOUBLE)
 / count(*) AS mean_pct, arg_min(retailer, (-coverage_pct, retailer)) AS best, max(coverage_pct) AS best_pct,
 arg_min(retailer, (coverage_pct, retailer)) AS worst, min(coverage_pct) AS worst_pct FROM cov"""),
    "a20_timeline": over_offers(EVO + """ SELECT substr(created_at, 1, 10) AS day, """ + ", ".join(
        f"arg_max(mean_price, created_at) FILTER (retailer = '{r}') AS {r.lower().replace(' ', '_')}"
        for r in TIMELINE_RETAILERS) + " FROM evo GROUP BY 1"),
    "a20_timeline_long": over_offers(EVO + """ SELECT substr(created_at, 1, 10) AS day, retailer,
 arg_max(mean_price, created_at) AS mean_price FROM evo GROUP BY ALL"""),
    "a21_run_counts": over_offers("""SELECT 'retailer' AS facet, retailer AS value, count(*) AS n FROM offers GROUP BY ALL
 UNION ALL SELECT 'data_quality_tier', data_quality_tier, count(*) FROM offers GROUP BY ALL
 UNION ALL SELECT 'offer_type', offer_type, count(*) FROM offers GROUP BY ALL"""),
    "a21_coverage_by_device": over_offers(f"""SELECT retailer, device_type, count(*) AS n_models
 FROM ({DEVKEYS}) GROUP BY ALL"""),
    "a21_missing_vs_base": over_offers(f""", k AS ({DEVKEYS}), r AS (SELECT DISTINCT retailer FROM k
 WHERE retailer <> '{BASE}'), b AS (SELECT * FROM k WHERE retailer = '{BASE}')
 SELECT r.retailer, count(*) AS missing FROM r CROSS JOIN b WHERE NOT EXISTS (SELECT 1 FROM k
 WHERE k.retailer = r.retailer AND k.device_type = b.device_type AND k.model = b.model
 AND k.capacity_gb IS NOT DISTINCT FROM b.capacity_gb) GROUP BY ALL"""),
    "a21_missing_list": over_offers(f"""SELECT device_type, model, capacity_gb FROM offers WHERE retailer = '{BASE}'
 EXCEPT SELECT device_type, model, capacity_gb FROM offers WHERE retailer = 'Amazon'"""),
    "a21_terms": over_offers("""SELECT DISTINCT retailer, device_type, model, capacity_gb, term_months FROM offers
 WHERE offer_type = 'financing_max_term' AND term_months IS NOT NULL"""),
    "a26_coverage_counters": over_offers(f"""SELECT retailer,
 count(DISTINCT (device_type, model, capacity_gb)) AS n_keys, {COUNTERS} FROM offers GROUP BY retailer"""),
    "a27_most_frequent": over_offers("""SELECT brand, count(*) AS n FROM offers WHERE brand <> ''
 GROUP BY brand ORDER BY n DESC, min(_ord) LIMIT 1"""),
    "h1_base_price": over_offers(f""", {PAIRED} SELECT o.retailer, o.model, o.capacity_gb, o.offer_type,
 CAST(price_value AS DOUBLE) AS price, CAST(basep AS DOUBLE) AS base_price {JOINED}"""),
    "h2_last_base_price": over_offers(f"""SELECT model, capacity_gb, offer_type,
 CAST(arg_max(price_value, _ord) AS DOUBLE) AS base_price FROM offers
 WHERE {ISBASE} AND price_value IS NOT NULL GROUP BY ALL"""),
    "q1_latest_rows": over_offers(f""", {LATEST} SELECT {KEY6}, CAST(price_value AS DOUBLE) AS price, extracted_at
 FROM latest"""),
    "q2_audit": audit_sql(False),
    "q2_audit_ignoring_term": audit_sql(True),
    "q7_low_coverage": over_offers(f"""SELECT *, retailer IN ('Amazon', 'Grover', 'Rentik', 'Orange', 'Media Markt')
 AND (n_keys < 300 OR (retailer = 'Media Markt' AND n_financing_max_term = 0)) AS retry FROM (SELECT retailer,
 count(DISTINCT (device_type, model, capacity_gb)) AS n_keys, count(DISTINCT (device_type, model, capacity_gb))
 FILTER (offer_type = 'financing_max_term') AS n_financing_max_term FROM offers GROUP BY retailer)"""),
}
