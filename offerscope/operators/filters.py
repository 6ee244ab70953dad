"""Selections (L family) and question scoping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.functions.text import any_of, normalize_literal, normalize_text, text_or_empty
from offerscope.operators.dedupe import first_per_key


def _choices(values: Iterable[str] | None) -> list[str]:
    """Comma-split, normalized, without blanks or repeats."""
    parts = [normalize_literal(p) for v in (values or []) for p in str(v or "").split(",")]
    return sorted({p for p in parts if p})


def by_brand(offers: DataFrame, brand: str) -> DataFrame:
    wanted = normalize_literal(brand)
    return offers if wanted == "all" else offers.where(normalize_text(F.col("brand")) == wanted)


def filter_offers(
    offers: DataFrame,
    *,
    competitors: Iterable[str] | None = None,
    models: Iterable[str] | None = None,
    capacities: Iterable[int] | None = None,
    modalities: Iterable[str] | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    availability: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    """Conjunction of the given filters; a missing price passes both price bounds."""
    out = offers
    for column, values in (("retailer", competitors), ("model", models), ("offer_type", modalities)):
        chosen = _choices(values)
        if chosen:
            out = out.where(normalize_text(F.col(column)).isin(*chosen))
    if capacities:
        out = out.where(F.col("capacity_gb").isin(*[int(c) for c in capacities]))
    price = F.col("price_value")
    if min_price is not None:
        out = out.where(price.isNull() | (price >= min_price))
    if max_price is not None:
        out = out.where(price.isNull() | (price <= max_price))
    if availability is not None:
        out = out.where(F.col("in_stock") == availability)
    needle = normalize_literal(search or "")
    if needle:
        size = F.when(F.col("capacity_gb") != 0, F.col("capacity_gb").cast("string"))
        fields = [text_or_empty(F.col(c)) for c in ("retailer", "model", "brand", "offer_type")]
        hay = normalize_text(F.concat_ws(" ", *fields, text_or_empty(size)))
        out = out.where(hay.contains(needle))
    return out


def table_view(offers: DataFrame, search: str = "", **equal) -> DataFrame:
    """Grid selection: exact matches and a lower-cased (not folded) text search over 7 fields."""
    out = offers
    for column, value in equal.items():
        if value != "all":
            out = out.where(F.col(column).cast("string") == str(value))
    needle = search.lower().strip()
    if needle:
        names = ("retailer", "brand", "model", "product_code", "offer_type", "capacity_gb", "term_months")
        hay = F.lower(F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in names]))
        out = out.where(hay.contains(needle))
    return out


def selection(
    offers: DataFrame,
    modality: str,
    retailers: list[str] | None = None,
    model: str = "all",
    capacity: int | str = "all",
    term: int | str = "all",
) -> DataFrame:
    """Comparator and simulator selection; the term counts only for modalities that have one."""
    out = offers.where((F.col("offer_type") == modality) & (F.col("price_value") >= 0))
    if retailers is not None:
        out = out.where(F.col("retailer").isin(*retailers))
    if model != "all":
        out = out.where(F.col("model") == model)
    if capacity != "all":
        out = out.where(F.col("capacity_gb") == int(capacity))
    if term != "all" and modality in fixed.MONTHLY_MODALITIES:
        out = out.where(F.col("term_months") == int(term))
    return out


def modality_subset(offers: DataFrame, modalities: list[str]) -> DataFrame:
    return offers.where(F.col("offer_type").isin(*modalities)) if modalities else offers


# --- question text -----------------------------------------------------------------------------


def question_capacity(q: Column) -> Column:
    gb = F.regexp_extract(q, r"(\d{2,4})\s*gb", 1)
    tb = F.regexp_extract(q, r"(\d)\s*tb", 1)
    return F.when(gb != "", gb.cast("int")).when(tb != "", tb.cast("int") * 1024)


def question_modalities(q: Column) -> Column:
    """The requested modalities as a comma-joined list in fixed order."""
    return (
        F.when(any_of(q, ("contado", "cash")), "cash")
        .when(q.contains("financi"), "financing_max_term")
        .when(q.contains("renting con seguro"), "renting_with_insurance")
        .when(q.contains("renting sin seguro"), "renting_no_insurance")
        .when(q.contains("renting"), "renting_no_insurance,renting_with_insurance")
        .otherwise("")
    )


def question_intent(q: Column, has_retailer: Column) -> Column:
    return (
        F.when(has_retailer & any_of(q, fixed.STRATEGY_HINTS), "competitor_strategy")
        .when(has_retailer & any_of(q, fixed.POSITIONING_HINTS), "competitor_positioning")
        .when(q.contains("cobertura"), "coverage")
        .when(any_of(q, fixed.CHEAPEST_HINTS), "cheapest")
        .otherwise("summary")
    )


def question_alias(q: Column) -> Column:
    """Retailer named by its longest alias inside the question; null when none is."""
    aliases = sorted(fixed.QUESTION_ALIASES.items(), key=lambda kv: len(kv[0]), reverse=True)
    out = F.lit(None).cast("string")
    for alias, name in reversed(aliases):
        out = F.when(q.contains(alias), name).otherwise(out)
    return out


GRAM = 8


def _pieces(text: str, size) -> Column:
    """All runs of ``size`` characters of a text that has at least so many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(F.col(text), at, size))


def longest_contained(questions: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """The longest name found inside each question's normalized text; null when none is.

    ``names`` holds the candidate names in its only column. Texts and names meet by one gram per name, the one
    that fewest texts hold (eight characters, or the whole name if shorter); a name with a gram that no text
    holds meets none. So endings or beginnings that many names share are no keys. Texts count once, however many
    questions ask the same. The grams are many times as large as the tables that they come from, whose size is all
    that the planner knows: the joins are told to shuffle, or the grams would go through the driver as a broadcast.
    """
    label = F.col(names.columns[0])
    n = names.select(label.alias("_name"), normalize_text(label).alias("_norm")).distinct().where("_norm <> ''")
    short = F.length("_norm") < GRAM
    own = F.array_distinct(F.when(short, F.array("_norm")).otherwise(_pieces("_norm", GRAM)))
    n = n.withColumn("_own", own).withColumn("_count", F.size("_own"))
    sizes = sorted(r.size for r in n.where(short).select(F.length("_norm").alias("size")).distinct().take(GRAM))  # seven at most
    texts = questions.select(F.col(text).alias("_q")).where("_q <> ''").distinct()
    whole = F.when(F.length("_q") >= GRAM, _pieces("_q", GRAM)).otherwise(F.array().cast("array<string>"))
    parts = [F.when(F.length("_q") >= size, _pieces("_q", size)).otherwise(F.array().cast("array<string>")) for size in sizes]
    held = texts.select("_q", F.explode(F.array_distinct(F.concat(whole, *parts))).alias("_gram"))
    heat = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = n.select("_name", "_norm", "_count", F.explode("_own").alias("_gram")).hint("merge").join(heat, "_gram").groupBy("_name", "_norm", "_count").agg(
        F.count("*").alias("_met"), F.min(F.struct("_n", "_gram")).alias("_least"))
    keyed = rarest.where("_met = _count").select("_name", "_norm", F.col("_least._gram").alias("_gram"))
    hits = held.hint("merge").join(keyed, "_gram").where(F.col("_q").contains(F.col("_norm")))
    best = first_per_key(hits.select("_q", "_name"), ["_q"], [F.length("_name").desc(), F.col("_name").asc()])
    return questions.hint("merge").join(best.select(F.col("_q").alias(text), F.col("_name").alias(name)), text, "left").select(*questions.columns, name)


def scope(offers: DataFrame, questions: DataFrame) -> DataFrame:
    """Offers in the scope of each question (model known, capacity and modalities optional)."""
    q = questions.alias("q")
    o = offers.alias("o")
    joined = o.hint("merge").join(q, F.col("o.model") == F.col("q.q_model"))
    cap_ok = F.col("q.q_capacity").isNull() | (F.col("o.capacity_gb") == F.col("q.q_capacity"))
    mod_ok = (F.col("q.q_modalities") == "") | F.array_contains(
        F.split("q.q_modalities", ","), F.col("o.offer_type"))
    return joined.where(cap_ok & mod_ok).select("q.question_id", "o.*")
