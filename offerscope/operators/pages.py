"""Page text: useful lines of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.text import normalize_text
from offerscope.operators.dedupe import first_per_key

# --- fixed values: what makes a line useful ---
PRICE_HINT = r"(?i)\d[\d.,]{1,10}\s?(?:€|eur)|€\s?\d"
LINK_HINT = r"https?://|\]\(|/dp/"
CAPACITY_HINT = r"\b\d+\s?(?:gb|tb)\b"


def best_lines(pages: DataFrame, digest_chars: int | None = None, digest_lines: int | None = None) -> DataFrame:
    """The useful lines of each page, in page order; by default all of them.

    ``pages`` has page_id, text and terms (words of the query). A page without a useful line keeps all its
    lines, as does one of at most ``digest_chars`` characters if that is given; longer ones are then cut to
    the best ``digest_lines`` lines and to so many characters. Repeated lines are recognised by their whole
    normalized text.
    """
    flat = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = pages.select("page_id", "terms", F.length("text").alias("_size"), F.posexplode(F.split(flat, "\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", r"\s+", " "))).where("line <> ''")
    lines = lines.withColumn("_n", normalize_text(F.col("line")))
    score = (
        F.size(F.filter("terms", lambda t: F.col("_n").contains(t))) * 3
        + F.when(F.col("line").rlike(PRICE_HINT), 3).otherwise(0)
        + F.when(F.col("line").rlike(LINK_HINT), 2).otherwise(0)
        + F.when(F.col("_n").rlike(CAPACITY_HINT), 1).otherwise(0)
    )
    whole = F.max("score").over(Window.partitionBy("page_id")) == 0
    if digest_chars is not None:
        whole = whole | (F.col("_size") <= digest_chars)
    top = lines.withColumn("score", score).withColumn("_whole", whole).where("_whole OR score > 0")
    if digest_lines is not None:
        best = first_per_key(top.where("NOT _whole"), ["page_id"], [F.col("score").desc(), F.col("line_no").asc()], digest_lines)
        top = best.unionByName(top.where("_whole"))
    once = first_per_key(top, ["page_id", "_n"], [F.col("line_no").asc()])
    if digest_chars is None:
        return once.select("page_id", "line_no", "score", "line")
    before = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    budget = once.withColumn("_used", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    room = (F.lit(digest_chars) - F.col("_used")).cast("int")
    return budget.where(F.col("_used") < digest_chars).select(
        "page_id", "line_no", "score", F.trim(F.substring("line", F.lit(1), room)).alias("line"))
