"""Null-safe equi joins: missing keys match each other, as they do in grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal-or-both-missing keys; the left side's key columns are kept.

    Spark turns the condition into an equi join (hash or sort-merge, with skew handling), and picks
    a broadcast only when the measured size of a side allows it.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(
        lambda acc, k: acc & F.col(k).eqNullSafe(F.col(f"_right_{k}")), keys[1:],
        F.col(keys[0]).eqNullSafe(F.col(f"_right_{keys[0]}")),
    )
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"_right_{k}" for k in keys])
