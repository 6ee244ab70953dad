"""Dedupe operators.

All of them keep one row per key with ``row_number() = 1``. Spark turns that into a per-task
group limit ahead of the shuffle, so a key holding a third of all rows sends one row per map
task across the network, never the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.text import apart, normalize_text
from offerscope.operators.canonical import either
from offerscope.operators.gate import publishable_only

QUALITY_KEY = ("brand", "retailer", "device_type", "model", "capacity_gb", "offer_type", "term_months")


def first_per_key(df: DataFrame, keys: list, order: list, limit: int = 1) -> DataFrame:
    """The first ``limit`` rows per key in the given order; keys may be expressions.

    Rows of several keys are sorted by a hash of the key first, which tells nearly all keys apart in one
    comparison of numbers; the key itself still decides. Only expressions become columns of their own: a copy of a
    column would be sorted and moved beside it.
    """
    named = {f"_k{i}": k for i, k in enumerate(keys) if not isinstance(k, str)}
    columns = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    hashed = {"_kh": F.xxhash64(*columns)} if len(columns) > 1 else {}
    window = Window.partitionBy(*hashed, *columns).orderBy(*order)
    return (
        df.withColumns(named).withColumns(hashed)
        .withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= limit)
        .drop("_rn", *named, *hashed)
    )


def quality_key() -> list[Column]:
    c = F.col
    return [
        normalize_text(c("brand")),
        normalize_text(c("retailer")),
        normalize_text(either(c("device_type"), "mobile")),
        normalize_text(c("model")),
        c("capacity_gb"),
        normalize_text(c("offer_type")),
        c("term_months"),
    ]


def dedupe_by_quality(offers: DataFrame) -> DataFrame:
    """Publishable rows, best quality per key; equal quality keeps the earliest arrival."""
    return best_ranked(publishable_only(offers))


def best_ranked(ranked: DataFrame) -> DataFrame:
    """The same of rows that have passed the gate and have their ``_rank``."""
    order = [F.col("_rank").desc(), F.col("price_value").asc_nulls_last(), F.col("_ord").asc()]
    keys = {f"_q{i}": key for i, key in enumerate(quality_key())}
    return first_per_key(apart(ranked, keys, "model"), [*keys], order).drop("_rank", *keys)


def dedupe_cheapest(offers: DataFrame, keys: list) -> DataFrame:
    """Cheapest row per key, first arrival on ties; rows without a price lose."""
    return first_per_key(offers, keys, [F.col("price_value").asc_nulls_last(), F.col("_ord").asc()])


CHEAPEST_KEYS = ["brand", "retailer", "device_type", "model", "capacity_gb", "offer_type", "term_months"]
CHEAPEST_KEYS_NO_BRAND = CHEAPEST_KEYS[1:]
PAGE_KEYS = ["model", "capacity_gb", "offer_type", "term_months", "source_url"]


def distinct_offers(offers: DataFrame, page: list[str]) -> DataFrame:
    """First offer per (modality, price, term) within a page."""
    return first_per_key(
        offers, [*page, "offer_type", "price_value", "term_months"], [F.col("_ord").asc()]
    )


def most_confident(offers: DataFrame, keys: list, confidence: str = "confidence") -> DataFrame:
    """Highest confidence per key, first arrival on ties."""
    return first_per_key(offers, keys, [F.col(confidence).desc_nulls_last(), F.col("_ord").asc()])


def distinct_in_order(df: DataFrame, value: Column) -> DataFrame:
    """Distinct values with the position of their first appearance (map-side aggregated)."""
    return df.groupBy(value.alias("value")).agg(F.min("_ord").alias("_ord"))


def derive_targets(
    offers: DataFrame, base: str, brands: list[str] | None = None, by_name: bool = False
) -> DataFrame:
    """One target per (model, capacity) of the base retailer's rows: the first to arrive."""
    from offerscope.operators.canonical import is_base

    rows = offers.where(is_base(F.col("retailer"), base))
    if brands:
        rows = rows.where(F.lower("brand").isin(*[b.lower() for b in brands]))
    model = normalize_text(F.col("model")) if by_name else F.col("model")
    return first_per_key(rows, [model, "capacity_gb"], [F.col("_ord").asc()]).select(
        "brand", "model", "capacity_gb", "product_code", "device_type",
        either(F.col("product_family"), F.col("brand")).alias("product_family"),
        "source_url", "_ord",
    )


def latest_rows(offers: DataFrame) -> DataFrame:
    """Latest row per raw six-part key; the later arrival wins equal timestamps.

    A timestamp that cannot be read counts as the oldest possible.
    """
    at = F.coalesce(F.col("extracted_at").try_cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    keys = [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in
            ("retailer", "brand", "model", "capacity_gb", "offer_type", "term_months")]
    return first_per_key(offers, keys, [at.desc(), F.col("_ord").desc()])


def best_seed_per_model(seeds: DataFrame, score: Column) -> DataFrame:
    """One seed per (device, model, capacity): best score, first arrival on ties.

    Seeds that are spelled alike come together first, before keys are added to them. In the order of the input a task
    sorts all it has read, which spills, and finds few of them to leave out. Rebalanced, what is left out is nearly
    everything, and a hot spelling is dealt to several tasks.
    """
    keys = [normalize_text(F.col("device_type")), normalize_text(F.col("model")), "capacity_gb"]
    alike = seeds.hint("rebalance", "device_type", "model", "capacity_gb")
    return first_per_key(alike, keys, [score.desc(), F.col("_ord").asc()])


VALIDATION_LIMIT = fixed.VALIDATION_SAMPLE
