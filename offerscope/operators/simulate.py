"""What-if ranking for the base retailer's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import pct_from, round_half_up
from offerscope.operators.joins import join_null_safe

SELECTION = ["model", "capacity_gb", "offer_type"]


def best_by_retailer(offers: DataFrame) -> DataFrame:
    """Lowest valid price per selection and retailer, with its first arrival."""
    rows = offers.where("price_value >= 0 AND capacity_gb IS NOT NULL")
    return rows.groupBy(*SELECTION, "retailer").agg(
        F.min("price_value").alias("best_price"), F.min("_ord").alias("_first")
    )


def reference_prices(offers: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """The base retailer's first price per selection: the slider's starting point."""
    rows = offers.where("price_value >= 0 AND capacity_gb IS NOT NULL").where(F.col("retailer") == base)
    return rows.groupBy(*SELECTION).agg(F.min_by("price_value", "_ord").alias("ref_price"))


def bounds(ref: DataFrame) -> DataFrame:
    """Slider limits and step per selection."""
    step = F.when(F.col("offer_type").isin("cash", "financing_max_term"), 1.0).otherwise(0.5)
    return ref.select(
        *SELECTION, F.col("ref_price").cast("double").alias("ref_price"),
        round_half_up(F.col("ref_price").cast("double") * 0.5).alias("low"),
        round_half_up(F.col("ref_price").cast("double") * 1.5).alias("high"),
        step.alias("step"),
    )


def scenarios(ref: DataFrame, factors: list[float]) -> DataFrame:
    """A grid of simulated prices per selection, as multiples of the reference price."""
    grid = F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")
    return ref.select("*", grid).withColumn(
        "sim_price", round_half_up(F.col("ref_price").cast("double") * F.col("factor"))
    )


def _before(price: Column, mine: Column, tie: Column, my_tie: Column) -> Column:
    return (price < mine) | ((price == mine) & (tie < my_tie))


def simulate(offers: DataFrame, grid: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Original and simulated position of the base retailer for every scenario.

    Equal prices: the original list keeps arrival order, the simulated one retailer name order.
    Positions are counts of rivals ahead, aggregated before the shuffle; no sort is needed.
    """
    best = best_by_retailer(offers)
    ours = best.where(F.col("retailer") == base).select(
        *SELECTION, F.col("best_price").alias("own_best"), F.col("_first").alias("own_first")
    )
    plan = join_null_safe(grid, ours, SELECTION)
    joined = join_null_safe(plan, best.where(F.col("retailer") != base), SELECTION, "left")
    price = F.col("best_price").cast("double")
    ahead_now = _before(price, F.col("own_best").cast("double"), F.col("_first"), F.col("own_first"))
    ahead_sim = _before(price, F.col("sim_price"), F.col("retailer"), F.lit(base))
    return joined.groupBy(*SELECTION, "ref_price", "factor", "sim_price").agg(
        (F.count(F.when(ahead_now, 1)) + 1).alias("current_pos"),
        (F.count(F.when(ahead_sim, 1)) + 1).alias("simulated_pos"),
        (F.count("best_price") + 1).alias("total"),
    ).withColumn("delta", F.col("current_pos") - F.col("simulated_pos"))


def differences(offers: DataFrame, grid: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Each rival's difference to the simulated price, for every scenario."""
    rivals = best_by_retailer(offers).where(F.col("retailer") != base)
    joined = join_null_safe(grid.where("sim_price <> 0"), rivals, SELECTION)
    price = F.col("best_price").cast("double")
    return joined.select(
        *SELECTION, "factor", "retailer", price.alias("price"),
        round_half_up(price - F.col("sim_price")).alias("diff"),
        pct_from(price, F.col("sim_price")).alias("diff_pct"),
    )
