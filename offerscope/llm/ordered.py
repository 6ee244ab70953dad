"""Positions and running sums of rows inside their group, without one task per group.

A table is dealt by range of (group, order) and sorted inside each range, so that a group that holds a third
of all rows lies in many ranges. A row's position is its place inside its piece, the part of one group in one
range, and the rows of the group's earlier pieces; there are no more pieces of a group than ranges. Running
sums go by blocks of ``BLOCK`` positions in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.common import materialize

BLOCK = 4096
_PART_BITS = 33  # monotonically_increasing_id: partition above, place inside the partition below


def deal(df: DataFrame, group: str, order: Sequence[Column], purpose: str) -> DataFrame:
    """The rows dealt by range, written, each with a reference ``_at`` that ascends with (group, order).

    Since the dealt table is written, references stay the same however often they are read.
    """
    keys = [F.asc(group), *order]
    return materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), purpose)


def number(dealt: DataFrame, group: str, pos: str = "_pos", size: str = "_n") -> DataFrame:
    """A dealt table with ``pos`` (from 0) of each row in its group and the group's ``size``."""
    rows = dealt.withColumn("_piece", F.shiftright("_at", _PART_BITS))
    pieces = rows.groupBy(group, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, "_piece", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias(size))
    return rows.join(pieces, [group, "_piece"]).withColumn(pos, F.col("_at") + F.col("_shift")).drop("_piece", "_shift")


def number_rows(df: DataFrame, group: str, order: Sequence[Column], purpose: str) -> DataFrame:
    """All columns of ``df``, ``_pos`` (from 0, by ``order``) and ``_n``, the group's size. ``group`` holds no null.

    Rows that ``order`` does not tell apart are numbered in any order.
    """
    return number(deal(df, group, order, purpose), group).drop("_at")


def running_sums(df: DataFrame, group: str, pos: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """All columns of ``df``, with ``columns`` replaced by their sums over the group's rows up to ``pos``.

    ``df`` is read twice: for the rows and for the sums of the blocks.
    """
    rows = df.withColumn("_block", F.expr(f"{pos} div {block}"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_block").agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    sums = sums.select(group, "_block", *(F.sum(f"_sum_{c}").over(earlier).alias(f"_before_{c}") for c in columns)).where("_block > 0")
    within = Window.partitionBy(group, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(within) for c in columns})
    joined = local.join(sums, [group, "_block"], "left")
    return joined.select(*(F.col(c) + F.coalesce(f"_before_{c}", F.lit(0)) if c in columns else F.col(c) for c in df.columns)).toDF(*df.columns)
