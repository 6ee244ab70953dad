"""Price texts to numbers. The parsers differ on purpose: each source writes prices its own way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerscope.functions.numbers import round_half_up, to_double
from offerscope.functions.text import normalize_literal, normalize_text

# --- fixed values: patterns that decide what counts as a price ---
EURO_AMOUNT = r"(\d{1,5}(?:[.\s]\d{3})*(?:,\d{1,2})?)"
EURO_PRICE = EURO_AMOUNT + r"\s*€"
EURO_VALUE = r"(?i)" + EURO_AMOUNT + r"\s*(?:€|eur)"
MONTHLY_VALUE = r"(?i)" + EURO_AMOUNT + r"\s*(?:€|eur)\s*/?\s*mes"
TERM = r"(?i)(\d{1,2})\s*mes(?:es)?"
THOUSANDS = r"\b\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?\b"
KEYWORD_WINDOW = 500
TERM_WINDOW = 80


def _without(text: Column, *parts: str) -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def _comma_to_dot(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("."))


def _last_separator_is_decimal(text: Column) -> Column:
    comma_last = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
    return F.when(comma_last, _comma_to_dot(_without(text, "."))).otherwise(_without(text, ","))


def _both(text: Column) -> Column:
    return text.contains(",") & text.contains(".")


def parse_audit_price(value: Column) -> Column:
    """Currency and blanks dropped; with both separators the later one is the decimal mark."""
    text = _without(F.trim(value.cast("string")), "€", "EUR", " ")
    return to_double(F.when(_both(text), _last_separator_is_decimal(text)).otherwise(_comma_to_dot(text)))


def parse_spanish_euro(value: Column) -> Column:
    """Dots always group thousands: '12.99' is 1299."""
    return to_double(_comma_to_dot(_without(value, " ", ".")))


def parse_loose_euro(value: Column) -> Column:
    """As the audit parser, but a lone dot is a decimal mark only before one or two digits."""
    text = _without(F.trim(value.cast("string")), " ")
    plain = F.when(text.rlike(r"^\d+(?:\.\d{1,2})?$"), text).otherwise(_without(text, "."))
    return to_double(
        F.when(_both(text), _last_separator_is_decimal(text))
        .when(text.contains(","), _comma_to_dot(_without(text, ".")))
        .otherwise(plain)
    )


def parse_rival_price(value: Column) -> Column:
    """Drops currency signs, blanks, slashes and the letters of 'mes' and 'mo'."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"(?i)[€$£\s/meso]+", "")
    shaped = (
        F.when(text.rlike(r"\d\.\d{3},\d"), _comma_to_dot(_without(text, ".")))
        .when(text.contains(",") & ~text.contains("."), _comma_to_dot(text))
        .when(_both(text), _without(text, ","))
        .otherwise(text)
    )
    return round_half_up(to_double(F.regexp_replace(shaped, r"[^\d.]", "")))


def parse_catalogue_price(value: Column) -> Column:
    """Keeps digits and separators; with both, the comma is the decimal mark."""
    text = F.regexp_replace(value.cast("string"), r"[^\d,.]", "")
    return to_double(
        F.when(_both(text), _comma_to_dot(_without(text, "."))).otherwise(_comma_to_dot(text))
    )


def parse_upfront_price(value: Column) -> Column:
    """One-off payment text: grouped thousands lose their dots before the rival parser runs."""
    text = F.coalesce(value, F.lit(""))
    for entity, sign in (("&euro;", "€"), ("&nbsp;", " "), ("&#8364;", "€"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.trim(F.replace(text, F.lit(" "), F.lit(" ")))
    return parse_rival_price(F.when(text.rlike(THOUSANDS), _without(text, ".")).otherwise(text))


def fix_price_fragment(value: Column) -> Column:
    """'599,-' and '599,–' become '599,00'."""
    text = F.translate(F.trim(F.coalesce(value, F.lit(""))), " ", " ")
    return F.replace(F.regexp_replace(text, r",\s*[–-]+", ",00"), F.lit("–"), F.lit("00"))


def split_price(whole: Column, fraction: Column, fallback: Column) -> Column:
    """Whole and fraction shown apart; else the hidden full text."""
    w = F.regexp_replace(F.coalesce(whole, F.lit("")), r"[^\d]", "")
    f = F.when(fraction.isNull(), "00").otherwise(F.regexp_replace(fraction, r"[^\d]", ""))
    parts = F.when(w != "", to_double(F.concat(w, F.lit("."), F.substring(f, 1, 2))))
    text = F.regexp_replace(fallback, r"[€$£\s]", "")
    shaped = F.when(text.rlike(r"\d\.\d{3},\d"), _comma_to_dot(_without(text, "."))).otherwise(
        _comma_to_dot(text)
    )
    return F.coalesce(parts, to_double(F.regexp_replace(shaped, r"[^\d.]", "")))


def _amount(text: Column, pattern: str, group: int = 1) -> Column:
    """Null where nothing matches: an empty text is no number."""
    return parse_spanish_euro(F.regexp_extract(text, pattern, group))


def first_price(text: Column) -> Column:
    return _amount(text, EURO_PRICE)


def first_price_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, EURO_PRICE, 0), F.lit(""))


def first_euro_value(text: Column) -> Column:
    return _amount(F.replace(text, F.lit(" "), F.lit(" ")), EURO_VALUE)


def segment_after(text: Column, keyword: str, window: int = KEYWORD_WINDOW, folded: Column | None = None) -> Column:
    """Text from the keyword on. The offset is found in the normalized text and used on the raw one.

    Pass the normalized text as a column (``folded``) where several keywords are looked for, or each folds it anew.
    """
    at = F.instr(normalize_text(text) if folded is None else folded, normalize_literal(keyword))
    return F.when(at > 0, F.substring(text, at, F.lit(window)))


def price_after(text: Column, keywords, window: int = KEYWORD_WINDOW, folded: Column | None = None) -> Column:
    """Price following the first keyword that has one within the window. Spellings that fold to the same are one."""
    distinct = {normalize_literal(k): k for k in reversed(keywords)}
    ordered = [k for k in keywords if distinct[normalize_literal(k)] == k]
    return F.coalesce(*[first_price(segment_after(text, k, window, folded)) for k in ordered])


def monthly_price(text: Column) -> Column:
    return _amount(F.replace(text, F.lit(" "), F.lit(" ")), MONTHLY_VALUE)


def monthly_term(text: Column) -> Column:
    """Term mentioned around the monthly price."""
    flat = F.replace(text, F.lit(" "), F.lit(" "))
    at = F.regexp_instr(flat, F.lit(MONTHLY_VALUE))
    size = F.length(F.regexp_extract(flat, MONTHLY_VALUE, 0))
    start = F.greatest(at - F.lit(TERM_WINDOW), F.lit(1))
    window = F.substring(text, start, at + size + F.lit(TERM_WINDOW) - start)
    return F.when(at > 0, F.nullif(F.regexp_extract(window, TERM, 1), F.lit("")).cast("int"))
