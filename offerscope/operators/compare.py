"""Comparison against the base retailer.

Group figures are map-side aggregates joined back on a null-safe key, not windows: a key with a
third of all rows is split by the skew-join rule instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import diff_from, mean_of, pct_from, round_half_up
from offerscope.functions.text import normalize_text, text_or_empty
from offerscope.operators.canonical import is_base, modality_label, modality_order
from offerscope.operators.joins import join_null_safe
from offerscope.session import shared_dir

PAIR = ["model", "capacity_gb", "offer_type"]
SKU = ["model", "capacity_gb"]


def base_prices(offers: DataFrame, base: str, how: str = "cheapest") -> DataFrame:
    """The base retailer's price per pair key: the cheapest, or the last to arrive."""
    rows = offers.where(is_base(F.col("retailer"), base) & F.col("price_value").isNotNull())
    price = F.min("price_value") if how == "cheapest" else F.max_by("price_value", "_ord")
    return rows.groupBy(*PAIR).agg(price.alias("base_price"))


def with_base_price(offers: DataFrame, base: str = fixed.DEFAULT_BASE, how: str = "cheapest") -> DataFrame:
    """Left, null-safe join of every offer to the base price of its pair key."""
    return join_null_safe(offers, base_prices(offers, base, how), PAIR, "left")


def groups(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """One row per pair key: best offer, base price, saving."""
    priced = F.col("price_value").isNotNull()
    out = (
        offers.withColumn("_b", is_base(F.col("retailer"), base))
        .groupBy(*PAIR)
        .agg(
            F.count("*").alias("n_offers"),
            F.min("price_value").alias("best_price"),
            F.min_by("retailer", F.when(priced, F.struct("price_value", "_ord"))).alias("best_retailer"),
            F.min(F.when(F.col("_b"), F.col("price_value"))).alias("base_price"),
        )
    )
    return out.withColumn("saving", diff_from(F.col("base_price"), F.col("best_price")))


def compare(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Every offer with its group's best and base price and its difference to the base price."""
    g = groups(offers, base).drop("n_offers")
    joined = join_null_safe(offers, g, PAIR)
    return joined.withColumns({
        "diff_vs_base": diff_from(F.col("price_value"), F.col("base_price")),
        "diff_pct_vs_base": pct_from(F.col("price_value"), F.col("base_price")),
    })


def bars(grouped: DataFrame) -> DataFrame:
    """Chart rows: groups that have a price, labelled by product."""
    size = F.when(F.coalesce(F.col("capacity_gb"), F.lit(0)) == 0, F.lit("")).otherwise(
        F.col("capacity_gb").cast("string")
    )
    return grouped.where(F.col("best_price").isNotNull()).select(
        F.trim(F.concat(F.col("model"), F.lit(" "), size, F.lit("GB"))).alias("product"),
        "offer_type",
        modality_label(F.col("offer_type")).alias("label"),
        round_half_up(F.col("best_price")).alias("best_price"),
        round_half_up(F.col("base_price")).alias("base_price"),
        F.col("saving").alias("gap"),
    )


def group_order() -> list:
    return [normalize_text(F.col("model")), F.coalesce(F.col("capacity_gb"), F.lit(0)),
            modality_order(F.col("offer_type"))]


def coverage(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Share of the base retailer's (model, capacity) keys that each rival offers too."""
    keys = offers.groupBy("retailer", *SKU).agg(
        F.max(is_base(F.col("retailer"), base)).alias("_b")
    )
    base_keys = keys.where("_b").select(*SKU).distinct()
    total = base_keys.agg(F.count("*")).scalar()
    rivals = keys.where(~F.col("_b"))
    joined = join_null_safe(rivals, base_keys.withColumn("_hit", F.lit(1)), SKU, "left")
    return joined.groupBy("retailer").agg(F.count("_hit").alias("matched")).select(
        "retailer", "matched", total.alias("total_base"),
        F.coalesce(
            round_half_up(F.col("matched") / F.nullif(total, F.lit(0)) * 100.0), F.lit(0.0)
        ).alias("coverage_pct"),
    )


def coverage_stats(cov: DataFrame) -> DataFrame:
    """Mean, best and worst coverage."""
    pct = F.col("coverage_pct")
    return cov.agg(
        (F.sum(pct.cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean_pct"),
        F.min_by("retailer", F.struct(-pct, F.col("retailer"))).alias("best"),
        F.max(pct).alias("best_pct"),
        F.min_by("retailer", F.struct(pct, F.col("retailer"))).alias("worst"),
        F.min(pct).alias("worst_pct"),
    )


def gap(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Mean price gap per rival over the keys it shares with the base (base = last price)."""
    right = base_prices(offers, base, "last")
    left = offers.where(~is_base(F.col("retailer"), base) & F.col("price_value").isNotNull()).select(
        "retailer", *PAIR, "price_value"
    )
    joined = join_null_safe(left, right, PAIR)
    return joined.groupBy("retailer").agg(
        F.sum(F.col("price_value") - F.col("base_price")).alias("s"), F.count("*").alias("n")
    ).select("retailer", round_half_up(mean_of(F.col("s"), F.col("n"))).alias("mean_gap"), "n")


def alerts(compared: DataFrame, base: str = fixed.DEFAULT_BASE, threshold_pct: float = fixed.ALERT_PCT) -> DataFrame:
    """Every rival offer at or below the threshold against the base price."""
    return compared.where(
        (F.col("retailer") != base) & (F.col("diff_pct_vs_base") <= threshold_pct)
    )


def capped_alerts(compared: DataFrame, base: str = fixed.DEFAULT_BASE, cap: int = fixed.ALERT_CAP) -> DataFrame:
    """The first alerts in comparator order, as the panel shows them."""
    order = [*group_order(), F.col("model"), F.col("capacity_gb"), F.col("price_value"), F.col("_ord")]
    return alerts(compared, base).orderBy(*order).limit(cap)


def alert_counts(alert_rows: DataFrame, by: str) -> DataFrame:
    return alert_rows.groupBy(by).agg(F.count("*").alias("n"))


def _audit_keys(ignore_term: bool) -> dict[str, Column]:
    keys = ["brand", "model", "capacity_gb", "offer_type"] + ([] if ignore_term else ["term_months"])
    return {f"j_{k}": F.trim(text_or_empty(F.col(k))) for k in keys}


def beside_base(offers: DataFrame, base: str = fixed.DEFAULT_BASE, ignore_term: bool = False) -> DataFrame:
    """The rows of products that the base retailer has too: all that an audit can compare, before the latest of them are
    looked for. The base's products are written out, so that the planner knows their size."""
    keys = _audit_keys(ignore_term)
    path = shared_dir(offers.sparkSession, "audited")
    offers.where(F.trim("retailer") == base).select(*[c.alias(k) for k, c in keys.items()]).distinct().write.parquet(path)
    ours = offers.sparkSession.read.parquet(path)
    return offers.withColumns(keys).join(ours, list(keys), "left_semi").drop(*keys)


def audit(
    latest: DataFrame,
    base: str = fixed.DEFAULT_BASE,
    threshold_pct: float = fixed.AUDIT_PCT,
    ignore_term: bool = False,
) -> DataFrame:
    """Rival rows whose price differs from the base by more than the threshold.

    When ignoring terms gives several base rows per key, the last to arrive is the reference.
    """
    trimmed = _audit_keys(ignore_term)
    rows, jkeys = latest.withColumns(trimmed), list(trimmed)
    ours = rows.where(F.trim("retailer") == base)
    ref = ours.groupBy(*jkeys).agg(
        F.max_by(F.struct("price_value", "extracted_at", "source_url"), "_ord").alias("ref")
    )
    rivals = rows.where(F.trim("retailer") != base)
    joined = rivals.join(ref, jkeys, "inner")
    price = F.col("price_value").cast("double")
    ref_price = F.col("ref.price_value").cast("double")
    signed = (price - ref_price) / F.nullif(ref_price, F.lit(0.0)) * 100.0
    return (
        joined.where(F.abs(signed) > threshold_pct)
        .select(
            F.trim("brand").alias("brand"), F.trim("model").alias("model"), "capacity_gb", "offer_type",
            "term_months",
            round_half_up(ref_price, 4).alias("base_price"),
            F.trim("retailer").alias("retailer"),
            round_half_up(price, 4).alias("rival_price"),
            round_half_up(signed).alias("pct_signed"),
            round_half_up(F.abs(signed)).alias("pct_abs"),
            F.col("ref.extracted_at").alias("base_extracted_at"),
            F.col("extracted_at").alias("rival_extracted_at"),
            F.col("ref.source_url").alias("base_url"),
            F.col("source_url").alias("rival_url"),
        )
    )


def sheet_link(url, label: str):
    """Spreadsheet hyperlink formula, quotes doubled, empty for an empty url."""
    text = F.replace(text_or_empty(url), F.lit('"'), F.lit('""'))
    shown = label.replace('"', '""')
    return F.when(text == "", "").otherwise(
        F.concat(F.lit('=HYPERLINK("'), text, F.lit(f'","{shown}")'))
    )


def html_text(col):
    """Text safe inside markup."""
    out = text_or_empty(col)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
