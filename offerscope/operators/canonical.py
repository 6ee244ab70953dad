"""Canonical offers and the column derivations built on them (N family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.numbers import (
    parse_bool,
    parse_int,
    parse_public_bool,
    parse_public_float,
    parse_table_float,
    pct_from,
    round_half_up,
    to_double,
    whole_number,
)
from offerscope.functions.text import any_of, apart, normalize_literal, normalize_text, same, text_or_empty

SPACES = " \t\n\r\f\v"


def strip(col: Column) -> Column:
    return F.btrim(text_or_empty(col), F.lit(SPACES))


def either(col: Column, fallback: Column | str) -> Column:
    """The text, or the fallback when it is missing or empty."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    text = text_or_empty(col)
    return F.when(text == "", other).otherwise(text)


def lookup(table: dict[str, str], col: Column, default: Column) -> Column:
    """A small fixed mapping as a CASE expression; no join, no broadcast."""
    pairs = list(table.items())
    case = reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), pairs[1:],
                  F.when(col == pairs[0][0], F.lit(pairs[0][1])))
    return case.otherwise(default)


def is_base(col: Column, base: str = fixed.DEFAULT_BASE) -> Column:
    return normalize_text(col) == normalize_literal(base)


def retailer_name(col: Column) -> Column:
    return lookup(fixed.RETAILER_ALIASES, strip(col), strip(col))


def retailer_slug(col: Column) -> Column:
    return lookup(fixed.SLUG_ALIASES, strip(col), strip(col))


def _kind_word(kind: Column) -> Column:
    return F.translate(normalize_text(kind), "- ", "__")


def _kind_of(explicit: Column, tier: Column, retailer: Column, offer_type: Column, base: str) -> Column:
    """The rule itself, over folded texts."""
    by_api = (normalize_literal(base), *fixed.RETAILERS_BY_API)
    return (
        F.when(explicit.isin(*fixed.CAPTURE_KIND_RANK), explicit)
        .when(tier.contains("api"), "api_exact")
        .when(tier.contains("json") | tier.contains("embedded"), "embedded_json_exact")
        .when(retailer.isin(*by_api), "api_exact")
        .when(retailer.isin(*fixed.RETAILERS_BY_JSON), "embedded_json_exact")
        .when(retailer.isin(*fixed.RETAILERS_BY_DOM), "visible_dom")
        .when(retailer.isin(*fixed.RETAILERS_BY_DOM_CASH_ONLY) & (offer_type == "cash"), "visible_dom")
        .when(tier.contains("adapter_live"), "visible_dom")
        .otherwise("")
    )


def capture_kind(row: dict[str, Column], base: str = fixed.DEFAULT_BASE) -> Column:
    """Explicit kind, else what the quality tier says, else what the retailer implies."""
    word = _kind_word(row["price_capture_kind"])
    folded = [normalize_text(row[c]) for c in ("data_quality_tier", "retailer", "offer_type")]
    return _kind_of(lookup(fixed.CAPTURE_KIND_ALIASES, word, word), *folded, base)


def canonicalize(raw: DataFrame, base: str = fixed.DEFAULT_BASE) -> DataFrame:
    """Coerce every column to its canonical type; values are never rejected here.

    Columns the input lacks count as empty; bookkeeping columns (``_ord``, ``snapshot_id``)
    pass through, other extras are dropped. What a rule reads several times is a column of its own
    first: inside a condition Spark would work it out once per mention.
    """
    row = {
        name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
        for name in fixed.CANONICAL_COLUMNS
    }
    c = F.col
    by = next((name for name in ("model", *fixed.CANONICAL_COLUMNS) if name in raw.columns), None)
    read = apart(apart(raw, {
        "_c_word": _kind_word(row["price_capture_kind"]), "_c_tier": normalize_text(row["data_quality_tier"]),
        "_c_seller": normalize_text(row["retailer"]), "_c_modality": normalize_text(row["offer_type"]),
        "_c_retailer": strip(row["retailer"]), "_c_slug": strip(row["retailer_slug"]),
        "_c_capacity": strip(row["capacity_gb"]), "_c_term": strip(row["term_months"]), "_c_stock": strip(row["in_stock"]),
        "_c_price": parse_table_float(strip(row["price_value"])),
    }, by), {
        "_c_explicit": lookup(fixed.CAPTURE_KIND_ALIASES, c("_c_word"), c("_c_word")),
        "_c_capacity": to_double(c("_c_capacity")), "_c_term": to_double(c("_c_term")),
    }, by)
    out = {
        "country": either(row["country"], "ES"),
        "retailer": lookup(fixed.RETAILER_ALIASES, c("_c_retailer"), c("_c_retailer")),
        "retailer_slug": lookup(fixed.SLUG_ALIASES, c("_c_slug"), c("_c_slug")),
        "product_family": either(row["product_family"], text_or_empty(row["brand"])),
        "device_type": either(row["device_type"], "mobile"),
        "capacity_gb": whole_number(c("_c_capacity")),
        "price_value": c("_c_price").try_cast("decimal(18,4)"),
        "term_months": whole_number(c("_c_term")),
        "in_stock": parse_bool(c("_c_stock")),
        "price_capture_kind": _kind_of(c("_c_explicit"), c("_c_tier"), c("_c_seller"), c("_c_modality"), base),
    }
    passthrough = [c for c in ("_ord", "snapshot_id") if c in raw.columns]
    columns = {name: out.get(name, text_or_empty(row[name])).alias(name) for name in fixed.CANONICAL_COLUMNS}
    return read.select(*(columns | {"model": same(columns["model"]).alias("model")}).values(), *passthrough)


def modality_label(col: Column) -> Column:
    return lookup(fixed.MODALITY_LABELS, col, col)


def modality_order(col: Column) -> Column:
    order = F.lit(fixed.UNKNOWN_MODALITY_ORDER)
    for name, rank in fixed.MODALITY_ORDER.items():
        order = F.when(col == name, rank).otherwise(order)
    return order


def price_unit(offer_type: Column) -> Column:
    return F.when(offer_type.isin(*fixed.MONTHLY_MODALITIES), "EUR/month").otherwise("EUR")


def display_unit(offer_type: Column, currency: Column) -> Column:
    money = either(currency, "EUR")
    return F.when(offer_type == "cash", money).otherwise(F.concat(money, F.lit("/mes")))


def to_public(offers: DataFrame) -> DataFrame:
    """The public projection: renamed columns, label, currency (always euro)."""
    c = F.col
    return offers.select(
        text_or_empty(c("extracted_at")).alias("timestamp_extraccion"),
        text_or_empty(c("retailer")).alias("competidor"),
        text_or_empty(c("source_url")).alias("url_producto"),
        either(c("brand"), text_or_empty(c("product_family"))).alias("marca"),
        text_or_empty(c("model")).alias("modelo"),
        parse_int(c("capacity_gb")).alias("capacidad"),
        text_or_empty(c("offer_type")).alias("modalidad"),
        modality_label(text_or_empty(c("offer_type"))).alias("modalidad_label"),
        text_or_empty(c("price_text")).alias("precio_texto"),
        parse_public_float(c("price_value")).alias("precio_valor"),
        F.lit("EUR").alias("moneda"),
        parse_public_bool(c("in_stock")).alias("disponibilidad"),
        either(c("device_type"), "mobile").alias("device_type"),
        parse_int(c("term_months")).alias("term_months"),
        text_or_empty(c("data_quality_tier")).alias("quality_tier"),
        text_or_empty(c("source_title")).alias("source_title"),
        text_or_empty(c("retailer_slug")).alias("retailer_slug"),
    )


def total_cost(offer_type: Column, price: Column, term: Column) -> Column:
    """Cash price, or price times a positive term; null when a term is missing."""
    return F.when(offer_type == "cash", price.cast("double")).when(
        term > 0, round_half_up(price.cast("double") * term.cast("double"))
    )


def total_cost_or_price(price: Column, term: Column) -> Column:
    """Export variant: falls back to the price itself when there is no term."""
    return F.when(
        F.coalesce(term, F.lit(0)) != 0, round_half_up(price.cast("double") * term.cast("double"))
    ).otherwise(price.cast("double"))


def annuity(principal: Column, months: Column, annual_rate: Column) -> Column:
    """Level monthly instalment; plain division without interest, null for no price or term."""
    p, n = principal.cast("double"), months.cast("double")
    r = annual_rate.cast("double") / 1200.0
    growth = F.pow(1.0 + r, n)
    level = F.when((annual_rate <= 0) | (growth == 1.0), p / n).otherwise(p * r * growth / (growth - 1.0))
    return F.when((p != 0.0) & (n > 0), round_half_up(level))


def instalment_or_share(monthly: Column, total: Column, term: Column) -> Column:
    """Stated monthly price, else the total spread over the term."""
    share = round_half_up(total.cast("double") / F.nullif(term, F.lit(0)).cast("double"))
    return F.coalesce(monthly.cast("double"), share)


def capacity_label(capacity: Column) -> Column:
    tb = capacity.cast("double") / 1024.0
    return (
        F.when(capacity.isNull(), "-")
        .when((capacity >= 1024) & (capacity % 1024 == 0),
              F.concat((capacity / 1024).cast("bigint").cast("string"), F.lit(" TB")))
        .when(capacity >= 1024, F.concat(F.format_string("%.1f", tb), F.lit(" TB")))
        .otherwise(F.concat(capacity.cast("string"), F.lit(" GB")))
    )


def euro_text(value: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(value.cast("decimal(24,2)"), 2), ",.", ".,")


def signed_euro_text(value: Column) -> Column:
    return F.concat(F.when(value > 0, "+").otherwise(""), euro_text(value))


def product_key(brand: Column, model: Column, capacity: Column) -> Column:
    return F.concat_ws(
        "|", normalize_text(brand), normalize_text(model),
        F.coalesce(capacity.cast("string"), F.lit("na")),
    )


def model_slug(brand: Column, name: Column, storage: Column) -> Column:
    """Slug for matching: name without its leading brand, with the storage unless already there."""

    def plain(col: Column) -> Column:
        kept = F.regexp_replace(normalize_text(col), r"[^a-z0-9\s\-/]", " ")
        return F.trim(F.regexp_replace(kept, r"\s+", " "))

    n, b, size = plain(name), plain(brand), F.lower(F.coalesce(storage, F.lit("")))
    bare = F.when(n.startswith(b), F.trim(F.substring(n, F.length(b) + 1, F.length(n)))).otherwise(n)
    full = F.when((size != "") & ~bare.contains(size), F.concat(bare, F.lit(" "), size)).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(F.trim(full), r"\s+", "-"), r"-+", "-")


def snapshot_label(created_at, mode, scope, records, snapshot_id) -> Column:
    stamp = F.when(text_or_empty(created_at) == "", snapshot_id).otherwise(
        F.substring(F.replace(created_at, F.lit("T"), F.lit(" ")), 1, 16)
    )
    return F.concat_ws(" | ", stamp, mode, scope, F.concat(records.cast("string"), F.lit(" registros")))


def day_badge(day: Column, today: Column) -> Column:
    gap = F.datediff(today, day)
    return F.when(gap == 0, "HOY").when(gap == 1, "AYER")


def with_reference_delta(df: DataFrame, price: str, reference: str, digits: int = 2) -> DataFrame:
    return df.withColumn("diff", round_half_up(F.col(price).cast("double") - F.col(reference).cast("double"), digits)) \
        .withColumn("diff_pct", pct_from(F.col(price), F.col(reference), digits))
