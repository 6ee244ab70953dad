"""Profiles, trends and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import mean_of, round_half_up
from offerscope.functions.text import text_or_empty
from offerscope.operators.canonical import is_base, modality_label
from offerscope.operators.joins import join_null_safe

PRICED = "price_value IS NOT NULL"


def _mean(digits: int = 2) -> Column:
    return round_half_up(mean_of(F.sum("price_value"), F.count("price_value")), digits)


def by_modality(offers: DataFrame) -> DataFrame:
    return (
        offers.where(PRICED).where("offer_type <> ''").groupBy("offer_type")
        .agg(_mean().alias("mean_price"), F.count("*").alias("n"))
        .withColumn("label", modality_label(F.col("offer_type")))
    )


def by_competitor(offers: DataFrame) -> DataFrame:
    return (
        offers.where(PRICED).where("retailer <> ''").groupBy("retailer")
        .agg(
            _mean().alias("mean_price"),
            round_half_up(F.min("price_value")).alias("min_price"),
            round_half_up(F.max("price_value")).alias("max_price"),
            F.count("*").alias("n"),
        )
    )


def by_model(offers: DataFrame, n: int = fixed.TOP_MODELS) -> DataFrame:
    """The n models with most prices (first seen wins ties), shown by mean price."""
    return (
        offers.where(PRICED).where("model <> ''").groupBy("model")
        .agg(_mean().alias("mean_price"), F.count("*").alias("n"), F.min("_ord").alias("_first"))
        .orderBy(F.col("n").desc(), "_first").limit(n)
        .select("model", "mean_price", "n").orderBy("mean_price", F.col("n").desc(), "model")
    )


def kpis(offers: DataFrame) -> DataFrame:
    """Rows, distinct products (missing capacity is a value), active retailers, latest timestamp."""
    return offers.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.struct("model", "capacity_gb")).alias("n_products"),
        F.count_distinct(F.when(F.col("retailer") != "", F.col("retailer"))).alias("n_retailers"),
        F.coalesce(F.max("extracted_at"), F.lit("")).alias("latest_at"),
    )


def distinct_values(offers: DataFrame, column: str) -> DataFrame:
    """Sorted option list of one column."""
    col = F.col(column)
    rows = offers.where(col.isNotNull())
    if dict(offers.dtypes)[column] == "string":
        rows = rows.where(col != "")
    return rows.select(column).distinct().orderBy(column)


def filters_meta(offers: DataFrame) -> DataFrame:
    """Option lists as (facet, value) rows, so no list has to fit one row."""
    parts = []
    for facet in ("retailer", "model", "capacity_gb", "offer_type", "in_stock"):
        values = distinct_values(offers, facet).select(
            F.lit(facet).alias("facet"), F.col(facet).cast("string").alias("value")
        )
        parts.append(values)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filters_range(offers: DataFrame) -> DataFrame:
    return offers.agg(
        F.min("price_value").cast("double").alias("price_min"),
        F.max("price_value").cast("double").alias("price_max"),
        F.coalesce(F.max("extracted_at"), F.lit("")).alias("latest_at"),
        F.count("*").alias("n_rows"),
    )


def evolution(history: DataFrame, catalogue: DataFrame, last_n: int = fixed.TREND_SNAPSHOTS) -> DataFrame:
    """Mean price per snapshot and retailer over the newest n snapshots of the catalogue."""
    recent = catalogue.orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc()).limit(last_n)
    # the least of their ids, known before the scan: partitions of older snapshots are not read
    oldest = recent.agg(F.min("snapshot_id")).scalar()
    rows = history.where(F.col("snapshot_id") >= oldest).where(PRICED).where("retailer <> ''")
    means = rows.groupBy("snapshot_id", "retailer").agg(_mean().alias("mean_price"))
    return means.join(recent.select("snapshot_id", "created_at"), "snapshot_id")


def timeline(trend: DataFrame, retailers: list[str]) -> DataFrame:
    """Day x retailer table; the last snapshot of a day wins."""
    day = F.substring("created_at", 1, 10).alias("day")
    return trend.groupBy(day).pivot("retailer", retailers).agg(F.max_by("mean_price", "created_at"))


def timeline_long(trend: DataFrame) -> DataFrame:
    """The same without fixing the retailers beforehand, one row per day and retailer."""
    day = F.substring("created_at", 1, 10).alias("day")
    return trend.groupBy(day, "retailer").agg(F.max_by("mean_price", "created_at").alias("mean_price"))


def scope_summary(offers: DataFrame) -> DataFrame:
    """Count, mean and range of a selection."""
    return offers.agg(
        F.count("*").alias("n"), _mean().alias("mean_price"),
        round_half_up(F.min("price_value")).alias("min_price"),
        round_half_up(F.max("price_value")).alias("max_price"),
    )


def cheapest_vs_base(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Cheapest row of a selection and the base retailer's cheapest against it."""
    order = F.when(F.col("price_value").isNotNull(), F.struct("price_value", "_ord"))
    ours = F.min(F.when(is_base(F.col("retailer"), base), F.col("price_value")))
    best = F.min("price_value")
    return offers.agg(
        F.min_by("retailer", order).alias("retailer"),
        F.min_by("model", order).alias("model"),
        F.min_by("capacity_gb", order).alias("capacity_gb"),
        best.cast("double").alias("price"),
        ours.cast("double").alias("base_price"),
        round_half_up(ours.cast("double") - best.cast("double")).alias("base_delta"),
    )


def best_per_retailer(offers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lowest price per retailer, for a selection or per given keys."""
    return offers.where(PRICED).groupBy(*(by or []), "retailer").agg(
        F.min("price_value").cast("double").alias("best_price")
    )


def min_total_cost(offers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lowest price x term per retailer over renting rows with a term."""
    rows = offers.where(PRICED).where("term_months IS NOT NULL").where(
        F.col("offer_type").isin(*fixed.RENTING_MODALITIES)
    )
    return rows.groupBy(*(by or []), "retailer").agg(
        F.min(F.col("price_value") * F.col("term_months")).cast("double").alias("total_cost")
    )


def base_cash_price(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """The base retailer's first cash price per product."""
    rows = offers.where(PRICED).where((F.col("retailer") == base) & (F.col("offer_type") == "cash"))
    return rows.groupBy("model", "capacity_gb").agg(
        F.min_by("price_value", "_ord").cast("double").alias("cash_price")
    )


def headline(offers: DataFrame) -> DataFrame:
    """Best renting and best cash offer, number of models and retailers."""
    renting = F.col("offer_type").isin(*fixed.RENTING_MODALITIES)
    cash = F.col("offer_type") == "cash"
    ok = F.col("price_value") >= 0

    def pick(cond: Column, column: str) -> Column:
        return F.min_by(column, F.when(cond & ok, F.struct("price_value", "_ord")))

    return offers.where(ok).agg(
        F.count_distinct("model").alias("n_models"),
        F.count_distinct("retailer").alias("n_retailers"),
        pick(renting, "retailer").alias("renting_retailer"),
        pick(renting, "price_value").cast("double").alias("renting_price"),
        pick(cash, "retailer").alias("cash_retailer"),
        pick(cash, "price_value").cast("double").alias("cash_price"),
    )


def run_counts(offers: DataFrame) -> DataFrame:
    """Rows by retailer, tier and modality as one (facet, value, n) table; one pass."""
    return (
        offers.select(F.inline(F.array(*[
            F.struct(F.lit(f).alias("facet"), text_or_empty(F.col(f)).alias("value"))
            for f in ("retailer", "data_quality_tier", "offer_type")
        ])))
        .groupBy("facet", "value").agg(F.count("*").alias("n"))
    )


def coverage_by_device(offers: DataFrame) -> DataFrame:
    """Distinct (model, capacity) per retailer and device."""
    distinct = offers.select("retailer", "device_type", "model", "capacity_gb").distinct()
    return distinct.groupBy("retailer", "device_type").agg(F.count("*").alias("n_models"))


def missing_vs_base(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Base products each rival lacks.

    Counted per rival as base products minus shared ones, so no rival x product grid is built
    unless the list itself is asked for with ``missing_list``.
    """
    keys = offers.select("retailer", "device_type", "model", "capacity_gb").distinct()
    ours = keys.where(F.col("retailer") == base).drop("retailer")
    total = ours.agg(F.count("*")).scalar()
    rivals = keys.where(F.col("retailer") != base)
    joined = join_null_safe(rivals, ours.withColumn("_hit", F.lit(1)), ours.columns, "left")
    return joined.groupBy("retailer").agg(F.count("_hit").alias("shared")).select(
        "retailer", (total - F.col("shared")).alias("missing")
    )


def missing_list(offers: DataFrame, rival: str, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """The base products one rival lacks (set difference)."""
    cols = ["device_type", "model", "capacity_gb"]
    ours = offers.where(F.col("retailer") == base).select(*cols)
    theirs = offers.where(F.col("retailer") == rival).select(*cols)
    return ours.subtract(theirs)


def terms_per_product(offers: DataFrame, modality: str = "financing_max_term") -> DataFrame:
    """Distinct terms each retailer offers per product, one row per term."""
    return offers.where((F.col("offer_type") == modality) & F.col("term_months").isNotNull()).select(
        "retailer", "device_type", "model", "capacity_gb", "term_months"
    ).distinct()


def coverage_counters(offers: DataFrame) -> DataFrame:
    """Distinct (device, model, capacity), overall and per modality, for each retailer.

    One pass: every key gets the set of its modalities as bits, then bits are counted.
    """
    modalities = list(fixed.MODALITY_LABELS)
    bit = F.lit(0)
    for place, name in enumerate(modalities):
        bit = F.when(F.col("offer_type") == name, 1 << place).otherwise(bit)
    keys = offers.groupBy("retailer", "device_type", "model", "capacity_gb").agg(F.bit_or(bit).alias("_bits"))
    return keys.groupBy("retailer").agg(
        F.count("*").alias("n_keys"),
        *[F.sum(F.getbit("_bits", F.lit(place)).cast("long")).alias(f"n_{name}") for place, name in enumerate(modalities)])


def low_coverage(
    counters: DataFrame, seed_count: int, watched: list[str], needs_financing: list[str]
) -> DataFrame:
    """Flags watched retailers covering under half the seeds, or lacking financing where expected."""
    few = F.col("n_keys") < max(1, seed_count // 2)
    no_plan = F.col("retailer").isin(*needs_financing) & (F.col("n_financing_max_term") == 0)
    retry = F.col("retailer").isin(*watched, *needs_financing) & (few | no_plan)
    return counters.select("retailer", "n_keys", "n_financing_max_term", retry.alias("retry"))


def most_frequent(offers: DataFrame, column: str = "brand") -> DataFrame:
    """Most frequent value, first seen on ties, with the latest timestamp."""
    top = (
        offers.where(F.col(column) != "").groupBy(column)
        .agg(F.count("*").alias("n"), F.min("_ord").alias("_first"))
        .orderBy(F.col("n").desc(), "_first").limit(1)
    )
    return top.select(column, "n")
