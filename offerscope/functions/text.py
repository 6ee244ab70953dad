"""Text folding and token expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\t-\r\x1c-\x20]+"
OTHER_BLANKS = r"[\t-\r\x1c-\x1f]"
WORDY = "¼½¾…™℠№ﬀﬁﬂﬃﬄﬅﬆⅡⅢⅣⅥⅦⅧⅨ㎅㎆㎇㎏㎜㎝㎞"


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


@lru_cache(maxsize=1)
def letter_table() -> tuple[str, str]:
    """Characters that fold to exactly one ASCII character: letters, digits, punctuation, blanks.

    Computed from the Unicode database: everything below the box-drawing block, the ideographic
    blank and the full-width forms.
    """
    points = [*range(0x80, 0x2500), 0x3000, *range(0xFF01, 0xFF5F)]
    pairs = [(chr(p), _fold(chr(p))) for p in points]
    kept = [(ch, out) for ch, out in pairs if len(out) == 1]
    return "".join(ch for ch, _ in kept), "".join(out for _, out in kept)


def _all_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _spelled_out(text: Column) -> Column:
    """The symbols of ``WORDY`` as the words they stand for."""
    return reduce(lambda out, ch: F.replace(out, F.lit(ch), F.lit(_fold(ch))), WORDY, text)


def to_ascii(text: Column) -> Column:
    """Decompose, then drop what is not ASCII, inside generated code.

    Plain ASCII is known by its size and passes through, letters go through one ``translate``, and the symbols that
    spell out as several characters (fractions, ellipsis, ligatures, units) are replaced only where one occurs. Rarer
    compatibility symbols are dropped; ``normalize_text_exact`` expands all of them.

    The expression is kept short: many of them make up one generated method, which the virtual machine only compiles
    while it is small.
    """
    wordy = F.length(F.translate(text, WORDY, "")) < F.length(text)
    letters = F.translate(F.when(wordy, _spelled_out(text)).otherwise(text), *letter_table())
    return F.when(_all_ascii(text), text).otherwise(F.regexp_replace(letters, r"[^\x00-\x7F]+", ""))


def normalize_text(text: Column) -> Column:
    """ASCII-fold, collapse blanks, trim, lower-case. Null becomes the empty string.

    Most texts are ASCII with lone blanks: they are recognised by searches and not rebuilt.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.regexp_replace(to_ascii(text), BLANKS, " ")
    unlike = ~_all_ascii(text) | text.contains("  ") | text.rlike(OTHER_BLANKS)
    return F.lower(F.trim(F.when(unlike, folded).otherwise(text)))


def normalize_literal(value: str) -> str:
    """The same folding for a parameter known on the driver."""
    return re.sub(r"\s+", " ", _fold(value)).strip().lower()


@F.pandas_udf(T.StringType())
def normalize_text_exact(text: pd.Series) -> pd.Series:
    """The folding for every Unicode character, Arrow-batched, for columns with exotic symbols."""
    return text.fillna("").map(normalize_literal)


def same(col: Column, kind: str = "string") -> Column:
    """The value itself. Spark does not fuse the step that hands it on with others (see ``apart``): reading JSON, which
    no value leads to here, is nothing that fused steps can do."""
    text = col.cast("string")
    return F.when(F.octet_length(text) < 0, F.from_json(text, "v string")["v"].cast(kind)).otherwise(col)


def apart(df: DataFrame, columns: dict[str, Column], by: str | None) -> DataFrame:
    """``df`` with ``columns``, worked out in a step of their own.

    Long expressions that Spark fuses with the operators around them become one method, and the virtual machine only
    interprets those of more than 8,000 bytes. The code of a step that is not fused is cut into methods that are
    all compiled. Such a step hands on ``by`` through ``same``; it should be a column that whatever follows reads.
    """
    return df.withColumns(columns | ({by: same(F.col(by), dict(df.dtypes)[by])} if by else {}))


def any_of(text: Column, needles) -> Column:
    """True when one of the fixed substrings occurs; byte searches, no regex."""
    return reduce(lambda found, needle: found | text.contains(needle), needles[1:], text.contains(needles[0]))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""),
        r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$", "",
    )


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))
