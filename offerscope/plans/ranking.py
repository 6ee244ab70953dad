"""Queries on selections, ordering, paging, questions and what-if simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.text import normalize_text
from offerscope.operators import filters as L
from offerscope.operators import ordering as W
from offerscope.operators import pages as PG
from offerscope.operators import position as P
from offerscope.operators import profile as R
from offerscope.operators import simulate as S
from offerscope.operators.canonical import is_base
from offerscope.operators.joins import join_null_safe
from offerscope.plans.sqltext import BASE, cases, norm, over_offers, r2
from offerscope.sources.tables import offers, read_table



def price():
    return F.col("price_value").cast("double").alias("price")


ROW = ["retailer", "model", "capacity_gb", "offer_type", "term_months"]
ROWSQL = "retailer, model, capacity_gb, offer_type, term_months, CAST(price_value AS DOUBLE) AS price"
RETAILERS = ["Amazon", "Media Markt", "Home Store"]
FACTORS = [0.5, 0.75, 0.9, 1.0, 1.1, 1.5]


def _q(fn):
    return lambda spark, sf: fn(offers(spark, sf))


def _row(df):
    return df.select(*ROW, price())


def l1(o):
    return _row(L.filter_offers(
        o, competitors=["amazon, El Corte Inglés", "home store"], modalities=["cash,renting_with_insurance"],
        capacities=[64, 256, 1024], min_price=500, max_price=4000, availability=True, search=" PRO "))


def l1_nulls(o):
    return _row(L.filter_offers(o, min_price=1000.0, max_price=1200.0))


def grid(o):
    return S.scenarios(S.reference_prices(o), FACTORS)


QUESTION = """'¿Cuál es el mejor precio de ' || p_name || ' ' || CAST(p_partkey AS STRING)
 || CASE p_partkey % 3 WHEN 0 THEN ' 256 GB' WHEN 1 THEN ' 1TB' ELSE '' END
 || CASE p_partkey % 5 WHEN 0 THEN ' al contado' WHEN 1 THEN ' en renting' WHEN 2 THEN ' financiación'
 WHEN 3 THEN ' renting con seguro' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN ' en El Corte Inglés?'
 WHEN 1 THEN ' y cómo está posicionado MediaMarkt' WHEN 2 THEN ' cobertura' ELSE ' estrategia para Orange' END"""


def questions(spark, sf):
    """One shopper question per part, with the reading of its text."""
    p = read_table(spark, sf, "part")
    raw = p.select(F.col("p_partkey").alias("question_id"), F.expr(QUESTION).alias("question"))
    q = raw.withColumn("text", normalize_text(F.col("question")))
    alias = L.question_alias(F.col("text"))
    return q.select(
        "question_id", "text", L.question_capacity(F.col("text")).alias("q_capacity"),
        L.question_modalities(F.col("text")).alias("q_modalities"), alias.alias("q_retailer"),
        L.question_intent(F.col("text"), alias.isNotNull()).alias("intent"))


def names(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"))


def h7(spark, sf):
    q = L.longest_contained(questions(spark, sf), names(spark, sf), "text", "q_model")
    return q.select("question_id", "q_model", "q_retailer")


def l11(spark, sf):
    """Offers each question is about, counted and priced."""
    o = offers(spark, sf)
    models = o.select("model").distinct()
    q = L.longest_contained(questions(spark, sf), models, "text", "q_model").where("q_model IS NOT NULL")
    scoped = L.scope(o, q)
    return scoped.groupBy("question_id").agg(
        F.count("*").alias("n"), F.min("price_value").cast("double").alias("min_price"))


def h4(o):
    """Rival offers limited to products the base retailer covers (semi join)."""
    key = ["device_type", "model", "capacity_gb"]
    ours = o.where(F.col("retailer") == BASE).select(*key).distinct()
    rivals = o.where(F.col("retailer") != BASE)
    hit = join_null_safe(rivals, ours.withColumn("_hit", F.lit(1)), key)
    return hit.select(*ROW, price())


def h9(spark, sf):
    """Snapshots with the products of the run that made them."""
    o = offers(spark, sf)
    snaps = o.groupBy("snapshot_id").agg(F.count("*").alias("record_count"))
    products = o.where("retailer = 'Home Store'").groupBy("snapshot_id").agg(
        F.count_distinct("model").alias("n_products"))
    return snaps.join(products, "snapshot_id", "left")


def w1(o):
    return S.simulate(o, grid(o)).select(
        "model", "capacity_gb", "offer_type", "factor", "sim_price", "current_pos", "simulated_pos", "total", "delta")


def w5(o):
    """Keys the sort compares, per row; the order itself is tested on a fixture."""
    return W.page(o, 3, 100, "model", True).select(*ROW, price())


def w7(o):
    """The second page beside the number of all rows."""
    return W.with_total(W.page(o, 2, 900), o).select(*ROW, price(), "total")


def w11_terms(o):
    rows = o.where("offer_type = 'financing_max_term' AND term_months IS NOT NULL")
    return rows.select("model", "term_months").distinct()


def w14(o):
    return R.missing_list(o, "Rentik")


def w15(spark, sf):
    pages = read_table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    terms = F.array(*[F.lit(t) for t in ("the", "le", "la", "en", "pro")])
    return PG.best_lines(pages.withColumn("terms", terms))


QUERIES = {
    "l1_filter": _q(l1),
    "l1_price_range_keeps_nulls": _q(l1_nulls),
    "l2_brand": _q(lambda o: _row(L.by_brand(o, "BRAND#7"))),
    "l3_table_view": _q(lambda o: _row(L.table_view(o, "Pro 1", offer_type="cash"))),
    "l4_comparator_selection": _q(lambda o: _row(L.selection(o, "renting_with_insurance", RETAILERS, term=24))),
    "l5_simulator_selection": _q(lambda o: _row(L.selection(o, "cash", None, capacity=256, term=24))),
    "l11_question_scope": l11,
    "l12_modality_subset": _q(lambda o: _row(L.modality_subset(o, ["cash", "financing_max_term"]))),
    "h4_covered_products": _q(h4),
    "h7_question_names": h7,
    "h9_snapshot_products": h9,
    "p15_question_reading": lambda spark, sf: questions(spark, sf),
    "w1_simulate": _q(w1),
    "w2_differences": _q(lambda o: S.differences(o, grid(o))),
    "w3_bounds": _q(lambda o: S.bounds(S.reference_prices(o))),
    "w4_coverage_rank": _q(lambda o: P.coverage_rank(P.best_price(o).groupBy("retailer").agg(F.count("*").alias("sku_count")))),
    "w5_page_by_model_desc": _q(w5),
    "w6_grid_order_top": _q(lambda o: W.sort_grid(o, "price_value", True).limit(200).select(*ROW, price())),
    "w7_page": _q(w7),
    "w8_retailer_order": _q(lambda o: o.select("retailer").distinct().orderBy(
        *W.retailer_order(F.col("retailer"), ["Home Store", "Media Markt", "Amazon"]))),
    "w9_interleave": _q(lambda o: W.interleave(o, 500).select(*ROW, "device_type", F.col("turn").cast("bigint").alias("turn"))),
    "w10_top_offers": _q(lambda o: W.top_k(o.where("price_value IS NOT NULL"), [F.col("price_value"), F.col("_ord")], 40, 25).select(*ROW, price())),
    "w11_terms_per_model": _q(w11_terms),
    "w12_union": _q(lambda o: o.where("in_stock").unionByName(o.where("NOT in_stock")).select(*ROW, "in_stock", price())),
    "w13_shared_with_base": _q(lambda o: o.where("retailer = 'Amazon'").select("model", "capacity_gb").intersect(
        o.where("retailer = 'Home Store'").select("model", "capacity_gb"))),
    "w14_missing_vs_base": _q(w14),
    "w15_best_lines": w15,
}

_Q = f"""WITH q0 AS (SELECT p_partkey AS question_id, {QUESTION} AS question FROM part),
q1 AS (SELECT question_id, {norm('question')} AS text FROM q0),
q AS (SELECT question_id, text, CASE WHEN regexp_matches(text, '(\\d{{2,4}})\\s*gb')
 THEN CAST(regexp_extract(text, '(\\d{{2,4}})\\s*gb', 1) AS INT) WHEN regexp_matches(text, '(\\d)\\s*tb')
 THEN CAST(regexp_extract(text, '(\\d)\\s*tb', 1) AS INT) * 1024 END AS q_capacity,
 CASE WHEN contains(text, 'contado') OR contains(text, 'cash') THEN 'cash' WHEN contains(text, 'financi')
 THEN 'financing_max_term' WHEN contains(text, 'renting con seguro') THEN 'renting_with_insurance'
 WHEN contains(text, 'renting sin seguro') THEN 'renting_no_insurance' WHEN contains(text, 'renting')
 THEN 'renting_no_insurance,renting_with_insurance' ELSE '' END AS q_modalities,
 CASE WHEN contains(text, 'corte ingles') THEN 'El Corte Ingles' WHEN contains(text, 'mediamarkt') THEN 'Media Markt'
 WHEN contains(text, 'orange') THEN 'Orange' WHEN contains(text, 'eci') THEN 'El Corte Ingles' END AS q_retailer FROM q1)"""
_INTENT = """CASE WHEN q_retailer IS NOT NULL AND contains(text, 'estrategia') THEN 'competitor_strategy'
 WHEN q_retailer IS NOT NULL AND (contains(text, 'posicionado') OR contains(text, 'como esta')) THEN 'competitor_positioning'
 WHEN contains(text, 'cobertura') THEN 'coverage' WHEN contains(text, 'mejor precio') THEN 'cheapest' ELSE 'summary' END"""
_SEL = "price_value >= 0 AND capacity_gb IS NOT NULL"
_SIM = f""", best AS (SELECT model, capacity_gb, offer_type, retailer, min(price_value) AS bp, min(_ord) AS fo
 FROM offers WHERE {_SEL} GROUP BY ALL), ref AS (SELECT model, capacity_gb, offer_type, arg_min(price_value, _ord) AS ref
 FROM offers WHERE {_SEL} AND retailer = '{BASE}' GROUP BY ALL), grid AS (SELECT r.*, factor,
 {r2('CAST(ref AS DOUBLE) * factor')} AS sim FROM ref r CROSS JOIN
 (SELECT unnest([{', '.join(str(f) for f in FACTORS)}]::DOUBLE[]) AS factor))"""
_RANKS = _SIM + """, slot AS (SELECT g.model, g.capacity_gb, g.offer_type, g.factor, g.sim, b.retailer, b.bp, b.fo,
 CASE WHEN b.retailer = 'Home Store' THEN sim ELSE CAST(b.bp AS DOUBLE) END AS sp FROM grid g JOIN best b
 USING (model, capacity_gb, offer_type)), r AS (SELECT *, row_number() OVER (PARTITION BY model, capacity_gb, offer_type,
 factor ORDER BY bp, fo) AS now_pos, row_number() OVER (PARTITION BY model, capacity_gb, offer_type, factor ORDER BY sp,
 retailer) AS sim_pos, count(*) OVER (PARTITION BY model, capacity_gb, offer_type, factor) AS total FROM slot)"""

ORACLE = {
    "l1_filter": over_offers(f"""SELECT {ROWSQL} FROM offers WHERE {norm('retailer')} IN ('amazon', 'el corte ingles', 'home store')
 AND offer_type IN ('cash', 'renting_with_insurance') AND capacity_gb IN (64, 256, 1024) AND (price_value IS NULL OR
 price_value BETWEEN 500 AND 4000) AND in_stock AND contains(lower(retailer || ' ' || model || ' ' || brand || ' ' ||
 offer_type || ' ' || capacity_gb), 'pro')"""),
    "l1_price_range_keeps_nulls": over_offers(f"SELECT {ROWSQL} FROM offers WHERE price_value IS NULL OR price_value BETWEEN 1000 AND 1200"),
    "l2_brand": over_offers(f"SELECT {ROWSQL} FROM offers WHERE lower(brand) = 'brand#7'"),
    "l3_table_view": over_offers(f"""SELECT {ROWSQL} FROM offers WHERE offer_type = 'cash' AND contains(lower(retailer || ' ' || brand
 || ' ' || model || ' ' || product_code || ' ' || offer_type || ' ' || coalesce(CAST(capacity_gb AS VARCHAR), '') || ' ' ||
 coalesce(CAST(term_months AS VARCHAR), '')), 'pro 1')"""),
    "l4_comparator_selection": over_offers(f"""SELECT {ROWSQL} FROM offers WHERE offer_type = 'renting_with_insurance'
 AND retailer IN ('Amazon', 'Media Markt', 'Home Store') AND term_months = 24 AND price_value >= 0"""),
    "l5_simulator_selection": over_offers(f"""SELECT {ROWSQL} FROM offers WHERE offer_type = 'cash' AND capacity_gb = 256
 AND price_value >= 0"""),
    "l11_question_scope": _Q.replace("WITH q0", "WITH offers AS MATERIALIZED (" + over_offers("SELECT * FROM offers") + "), q0", 1) + f""",
 m AS (SELECT DISTINCT model, {norm('model')} AS mn FROM offers), hit AS (SELECT question_id, model FROM q JOIN m ON
 contains(text, mn) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(model) DESC, model) = 1)
 SELECT question_id, count(*) AS n, CAST(min(price_value) AS DOUBLE) AS min_price FROM hit JOIN q USING (question_id)
 JOIN offers o ON o.model = hit.model WHERE (q_capacity IS NULL OR o.capacity_gb = q_capacity) AND (q_modalities = ''
 OR list_contains(string_split(q_modalities, ','), o.offer_type)) GROUP BY 1""",
    "l12_modality_subset": over_offers(f"SELECT {ROWSQL} FROM offers WHERE offer_type IN ('cash', 'financing_max_term')"),
    "h4_covered_products": over_offers(f"""SELECT {ROWSQL} FROM offers o WHERE retailer <> '{BASE}' AND EXISTS (SELECT 1 FROM offers b
 WHERE b.retailer = '{BASE}' AND b.device_type = o.device_type AND b.model = o.model AND b.capacity_gb IS NOT DISTINCT FROM o.capacity_gb)"""),
    "h7_question_names": _Q + f""", m AS (SELECT p_name || ' ' || p_partkey AS name FROM part), hit AS (SELECT question_id, name
 FROM q JOIN m ON contains(text, lower(name)) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(name) DESC,
 name) = 1) SELECT q.question_id, name AS q_model, q_retailer FROM q LEFT JOIN hit USING (question_id)""",
    "h9_snapshot_products": over_offers("""SELECT snapshot_id, record_count, n_products FROM (SELECT snapshot_id, count(*) AS record_count
 FROM offers GROUP BY 1) LEFT JOIN (SELECT snapshot_id, count(DISTINCT model) AS n_products FROM offers
 WHERE retailer = 'Home Store' GROUP BY 1) USING (snapshot_id)"""),
    "p15_question_reading": _Q + f" SELECT question_id, text, q_capacity, q_modalities, q_retailer, {_INTENT} AS intent FROM q",
    "w1_simulate": over_offers(_RANKS + """ SELECT model, capacity_gb, offer_type, factor, sim AS sim_price, now_pos AS current_pos,
 sim_pos AS simulated_pos, total, now_pos - sim_pos AS delta FROM r WHERE retailer = 'Home Store'"""),
    "w2_differences": over_offers(_SIM + f""" SELECT model, capacity_gb, offer_type, factor, retailer, CAST(bp AS DOUBLE) AS price,
 {r2('CAST(bp AS DOUBLE) - sim')} AS diff, {r2('(CAST(bp AS DOUBLE) - sim) / sim * CAST(100.0 AS DOUBLE)')} AS diff_pct
 FROM grid JOIN best USING (model, capacity_gb, offer_type) WHERE retailer <> '{BASE}' AND sim <> 0"""),
    "w3_bounds": over_offers(_SIM + f""" SELECT model, capacity_gb, offer_type, CAST(ref AS DOUBLE) AS ref_price,
 {r2('CAST(ref AS DOUBLE) * CAST(0.5 AS DOUBLE)')} AS low, {r2('CAST(ref AS DOUBLE) * CAST(1.5 AS DOUBLE)')} AS high,
 CAST(CASE WHEN offer_type IN ('cash', 'financing_max_term') THEN 1.0 ELSE 0.5 END AS DOUBLE) AS step FROM ref"""),
    "w4_coverage_rank": over_offers(f"""SELECT *, row_number() OVER (ORDER BY sku_count DESC, {norm('retailer')}, retailer) AS coverage_rank
 FROM (SELECT retailer, count(DISTINCT (model, capacity_gb)) AS sku_count FROM offers WHERE price_value IS NOT NULL GROUP BY 1)"""),
    "w5_page_by_model_desc": over_offers(f"""SELECT {ROWSQL} FROM offers ORDER BY {norm('model')} DESC, _ord LIMIT 100 OFFSET 200"""),
    "w6_grid_order_top": over_offers(f"SELECT {ROWSQL} FROM offers ORDER BY price_value ASC NULLS FIRST, _ord LIMIT 200"),
    "w7_page": over_offers(f"SELECT {ROWSQL}, (SELECT count(*) FROM offers) AS total FROM offers ORDER BY price_value ASC NULLS LAST, _ord LIMIT 500 OFFSET 500"),
    "w8_retailer_order": over_offers("""SELECT DISTINCT retailer FROM offers ORDER BY CASE retailer WHEN 'Home Store' THEN 0
 WHEN 'Media Markt' THEN 1 WHEN 'Amazon' THEN 2 ELSE 999 END, retailer"""),
    "w9_interleave": over_offers("""SELECT retailer, model, capacity_gb, offer_type, term_months, CAST(price_value AS DOUBLE) AS price,
 device_type, turn FROM (SELECT *, CASE device_type WHEN 'mobile' THEN 0 WHEN 'tablet' THEN 1 ELSE 2 END AS g,
 row_number() OVER (PARTITION BY CASE device_type WHEN 'mobile' THEN 0 WHEN 'tablet' THEN 1 ELSE 2 END ORDER BY _ord) AS turn
 FROM offers) ORDER BY turn, g LIMIT 500""").replace("CAST(price_value AS DOUBLE) AS price,\n device_type", "device_type"),
    "w10_top_offers": over_offers(f"SELECT {ROWSQL} FROM offers WHERE price_value IS NOT NULL ORDER BY price_value, _ord LIMIT 25"),
    "w11_terms_per_model": over_offers("""SELECT DISTINCT model, term_months FROM offers WHERE offer_type = 'financing_max_term'
 AND term_months IS NOT NULL"""),
    "w12_union": over_offers(f"SELECT {ROWSQL}, in_stock FROM offers WHERE in_stock IS NOT NULL"),
    "w13_shared_with_base": over_offers("""SELECT model, capacity_gb FROM offers WHERE retailer = 'Amazon' INTERSECT
 SELECT model, capacity_gb FROM offers WHERE retailer = 'Home Store'"""),
    "w14_missing_vs_base": over_offers("""SELECT device_type, model, capacity_gb FROM offers WHERE retailer = 'Home Store'
 EXCEPT SELECT device_type, model, capacity_gb FROM offers WHERE retailer = 'Rentik'"""),
    "w15_best_lines": f"""WITH lines AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t, {norm('line')} AS tn FROM lines),
s AS (SELECT *, 3 * len(list_filter(['the', 'le', 'la', 'en', 'pro'], lambda w: contains(tn, w)))
 + CASE WHEN regexp_matches(t, '(?i)\\d[\\d.,]{{1,10}}\\s?(?:€|eur)|€\\s?\\d') THEN 3 ELSE 0 END
 + CASE WHEN regexp_matches(t, 'https?://|\\]\\(|/dp/') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(tn, '\\b\\d+\\s?(?:gb|tb)\\b') THEN 1 ELSE 0 END AS score FROM c WHERE t <> ''),
k AS (SELECT * FROM s QUALIFY score > 0 OR max(score) OVER (PARTITION BY page_id) = 0)
SELECT page_id, CAST(line_no AS INT) AS line_no, CAST(score AS INT) AS score, t AS line
FROM k QUALIFY row_number() OVER (PARTITION BY page_id, tn ORDER BY line_no) = 1""",
}
