"""Best prices per product and rival positioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.numbers import round_half_up
from offerscope.functions.text import normalize_text
from offerscope.session import cut_lineage

SKU = ["model", "capacity_gb"]


def best_price(offers: DataFrame) -> DataFrame:
    """Lowest price per (model, capacity, retailer)."""
    return (
        offers.where("price_value IS NOT NULL AND model <> '' AND retailer <> ''")
        .groupBy(*SKU, "retailer").agg(F.min("price_value").alias("best_price"))
    )


def coverage_rank(counts: DataFrame) -> DataFrame:
    """Rank of each retailer by product count (descending), then normalized name.

    Ties are ranked inside their count; the offsets come from the table of distinct counts. That
    table has at most sqrt(2 * pairs) rows, since distinct positive counts sum to at most the
    number of (product, retailer) pairs, so its single-task running sum is bounded.
    """
    inside = Window.partitionBy("sku_count").orderBy(normalize_text(F.col("retailer")), F.col("retailer"))
    ranked = counts.withColumn("_in", F.row_number().over(inside))
    sizes = counts.groupBy("sku_count").agg(F.count("*").alias("_size"))
    before = Window.orderBy(F.col("sku_count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("sku_count", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    return ranked.join(offsets, "sku_count").select(
        *counts.columns, (F.col("_off") + F.col("_in")).cast("bigint").alias("coverage_rank")
    )


def price_leader(stats: DataFrame) -> DataFrame:
    """Cheapest mean among the retailers relevant to each one.

    Relevant means at least max(5, 30% of its own product count) products, or itself. The minimum
    over "count at least t" is a running minimum over distinct counts, looked up by threshold; both
    tables obey the bound given for ``coverage_rank``.
    """
    me = F.struct(F.col("avg_price").alias("p"), normalize_text(F.col("retailer")).alias("n"),
                  F.col("retailer").alias("r"))
    thr = F.greatest(F.lit(5), F.bround(F.col("sku_count") * F.lit(0.3), 0).cast("bigint"))
    own = stats.withColumn("_thr", thr).withColumn("_me", me)
    points = own.groupBy(F.col("sku_count").cast("bigint").alias("at")).agg(F.min("_me").alias("m"))
    asks = own.select(F.col("_thr").alias("at")).distinct().withColumn("m", F.lit(None).cast(points.schema["m"].dataType))
    run = Window.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = points.unionByName(asks).select("at", F.min("m").over(run).alias("_best")).distinct()
    joined = own.join(best.withColumnRenamed("at", "_thr"), "_thr", "left")
    pick = F.least(F.col("_me"), F.coalesce(F.col("_best"), F.col("_me")))
    return joined.select(
        "retailer", F.col("_thr").alias("relevant_threshold"),
        pick["r"].alias("price_leader"), pick["p"].alias("leader_avg_price"),
    )


def positioning(offers: DataFrame) -> DataFrame:
    """One row per retailer: coverage, price level, wins and losses against the best rival."""
    # the only pass over the offers: a row per product and retailer
    seen = cut_lineage(offers.groupBy(*SKU, "retailer").agg(
        F.min("price_value").alias("best_price"), F.min("term_months").alias("min_term"), F.max("term_months").alias("max_term")))
    best = seen.where("best_price IS NOT NULL AND model <> '' AND retailer <> ''")
    cheapest = Window.partitionBy(*SKU).orderBy("best_price", "retailer")
    # the best rival of the cheapest is the next one, of all others the cheapest
    rival = F.when(F.row_number().over(cheapest) == 1, F.lead("best_price").over(cheapest)).otherwise(F.first("best_price").over(cheapest))
    vs = best.withColumn("_rival", rival).select("retailer", F.col("best_price").alias("p"), (F.col("best_price") - F.col("_rival")).alias("g"))
    stats = cut_lineage(vs.groupBy("retailer").agg(
        F.count("*").alias("sku_count"),
        (F.sum("p").cast("double") / F.count("*")).alias("avg_price"),
        F.count("g").alias("matched"),
        F.count(F.when(F.col("g") <= 0, 1)).alias("wins"),
        F.count(F.when(F.col("g") > 0, 1)).alias("losses"),
        (F.sum("g").cast("double") / F.nullif(F.count("g"), F.lit(0))).alias("avg_gap"),
    ))
    terms = seen.groupBy("retailer").agg(F.min("min_term").alias("min_term"), F.max("max_term").alias("max_term"))
    out = coverage_rank(stats).join(price_leader(stats), "retailer").join(terms, "retailer", "left")
    gap = F.col("avg_gap")
    label = (
        F.when((F.col("coverage_rank") == 1) & (gap <= 5), "bien posicionado")
        .when(gap <= 0, "competitivo")
        .when(gap <= 15, "correcto, pero no lider")
        .otherwise("por encima del mercado")
    )
    return out.select(
        "retailer", "sku_count", "coverage_rank", "relevant_threshold",
        round_half_up(F.col("avg_price")).alias("avg_price"), "price_leader",
        round_half_up(F.col("leader_avg_price")).alias("leader_avg_price"),
        "matched", "wins", "losses", round_half_up(gap).alias("avg_gap"),
        "min_term", "max_term", label.alias("label"),
    )
