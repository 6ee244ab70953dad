"""Rounding, null-safe arithmetic and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.text import normalize_text


def round_half_up(value: Column, digits: int = 2) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` on doubles: halves go up, as a browser rounds them."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact decimal sum, so the result does not depend on addition order."""
    return total.cast("double") / F.nullif(count, F.lit(0)).cast("double")


def diff_from(price: Column, reference: Column, digits: int = 2) -> Column:
    return round_half_up(price.cast("double") - reference.cast("double"), digits)


def pct_from(price: Column, reference: Column, digits: int = 2) -> Column:
    """Signed percentage against a reference; null when the reference is null or zero."""
    ref = F.when(reference.cast("double") != 0.0, reference.cast("double"))
    return round_half_up((price.cast("double") - ref) / ref * 100.0, digits)


def finite(value: Column) -> Column:
    return F.when(
        ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value
    )


def to_double(text: Column) -> Column:
    """Plain decimal or scientific notation only; anything else, NaN included, is null."""
    # extracted, so that a text which is costly to work out is mentioned once
    return F.regexp_extract(F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$", 1).try_cast("double")


def parse_int(value: Column) -> Column:
    """'256', '256.0' or ' 256 ' to 256, truncating toward zero."""
    return whole_number(to_double(value.cast("string")))


def whole_number(number: Column) -> Column:
    """Truncated toward zero; null beyond an integer's range."""
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return whole.try_cast("int")


def parse_table_float(value: Column) -> Column:
    """Table reader's number: comma is the decimal mark, nothing else is stripped."""
    return to_double(F.replace(value.cast("string"), F.lit(","), F.lit(".")))


def parse_public_float(value: Column) -> Column:
    """Public number: drops blanks and the currency, comma is the decimal mark."""
    text = F.translate(value.cast("string"), " €", "")
    text = F.replace(F.replace(text, F.lit("EUR"), F.lit("")), F.lit("eur"), F.lit(""))
    return to_double(F.replace(text, F.lit(","), F.lit(".")))


def parse_bool(value: Column) -> Column:
    """Table reader's boolean."""
    word = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(word.isin(*fixed.TRUE_WORDS), True).when(word.isin(*fixed.FALSE_WORDS), False)


def parse_public_bool(value: Column) -> Column:
    """Public boolean, which also understands the Spanish yes."""
    word = normalize_text(value.cast("string"))
    return F.when(word.isin(*fixed.PUBLIC_TRUE_WORDS), True).when(
        word.isin(*fixed.FALSE_WORDS), False
    )


def parse_grid_number(value: Column) -> Column:
    """Grid number: any finite number, blanks mean missing."""
    return to_double(value.cast("string"))


def parse_grid_bool(value: Column) -> Column:
    """Grid boolean: no trimming, fewer spellings."""
    word = F.lower(value.cast("string"))
    return F.when(word.isin("true", "1", "yes", "si"), True).when(
        word.isin("false", "0", "no"), False
    )
