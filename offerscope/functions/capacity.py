"""Storage sizes in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerscope.functions.text import normalize_text

# --- fixed values ---
SMALLEST_CAPACITY = 64
GB_SIZES = r"\b(64|128|256|512|1024|2048)\s*gb\b"
TB_SIZES = r"\b(1|2|4)\s*tb\b"


def _in_gb(hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.regexp_extract(h, r"^(\d+)", 1).try_cast("int")
        * F.when(F.lower(h).endswith("tb"), 1024).otherwise(1),
    )


def smallest_mention(text: Column) -> Column:
    return F.array_min(_in_gb(F.regexp_extract_all(text, F.lit(r"(?i)(\d{2,4}\s*(?:gb|tb))\b"), 1)))


def largest_mention(text: Column) -> Column:
    return F.array_max(_in_gb(F.regexp_extract_all(text, F.lit(r"(?i)(\d+\s*(?:gb|tb))"), 1)))


def last_mention(text: Column) -> Column:
    return F.try_element_at(
        _in_gb(F.regexp_extract_all(text, F.lit(r"(?i)(\d+\s*(?:gb|tb))"), 1)), F.lit(-1)
    )


def standard_sizes(text: Column) -> Column:
    """Whitelisted sizes in the text, in GB, distinct."""
    n = normalize_text(text)
    gb = F.transform(F.regexp_extract_all(n, F.lit(GB_SIZES), 1), lambda v: v.cast("int"))
    tb = F.transform(F.regexp_extract_all(n, F.lit(TB_SIZES), 1), lambda v: v.cast("int") * 1024)
    return F.array_union(gb, tb)


def plausible(capacity: Column) -> Column:
    return F.when(capacity >= SMALLEST_CAPACITY, capacity)


def for_device(text: Column, device: Column) -> Column:
    """Laptops: largest whitelisted size; others: smallest mention, if plausible."""
    return F.when(normalize_text(device) == "laptop", F.array_max(standard_sizes(text))).otherwise(
        plausible(smallest_mention(text))
    )


def storage_text(text: Column) -> Column:
    """'256GB', upper-cased, or empty."""
    hit = F.regexp_extract(text, r"(?i)(\d+)\s*(GB|TB)", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)(\d+)\s*(GB|TB)", 2))
    return F.concat(hit, unit)


def small_number_is_tb(text: Column) -> Column:
    """Bare figures: 1 to 4 mean terabytes, anything larger gigabytes."""
    explicit = largest_mention(text)
    bare = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(explicit, F.when(bare.between(1, 4), bare * 1024).otherwise(bare))
