"""Product groups across sellers and the tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.numbers import pct_from
from offerscope.functions.text import normalize_text
from offerscope.operators.likeness import similar_within
from offerscope.operators.matching import GROUP_THRESHOLD, sorted_words
from offerscope.session import cut_lineage

# --- fixed values: words without weight, and how a model key is recognised ---
STOPWORDS = (
    "con", "de", "del", "la", "el", "los", "las", "para", "y", "en", "and", "with", "for", "the",
    "nuevo", "new", "edition", "edicion", "reacondicionado", "refurbished", "open", "box",
)
MODEL_PATTERNS = (
    r"(iphone\s+\d+(?:\s+(?:pro|air|plus|max|mini))*)",
    r"(ipad\s+(?:pro|air|mini)?\s*(?:m\d)?\s*\d*(?:\.?\d+)?)",
    r"(macbook\s+(?:air|pro)\s*(?:m\d)?)",
    r"(galaxy\s+(?:s|a|z|tab)\s*\d+(?:\+|ultra|plus|fe|fold|flip)?)",
    r"(galaxy\s+z\s+(?:fold|flip)\s*\d+)",
)
STORAGE = r"(\d+\s*(?:gb|tb))"
# source -> (renting column, purchase column) of the wide comparison
SOURCES = {
    "home_store": ("home_renting", "home_purchase"),
    "rentik": ("rentik_renting", None),
    "grover": ("grover_renting", None),
    "movistar": ("movistar_renting", None),
    "amazon": (None, "amazon_purchase"),
    "mediamarkt": (None, "mediamarkt_purchase"),
    "apple_store": (None, "apple_official"),
    "samsung_store": (None, "samsung_official"),
}
URLS = {"home_store": "home_url", "rentik": "rentik_url", "grover": "grover_url", "movistar": "movistar_url"}
MARKET = ("amazon_purchase", "mediamarkt_purchase", "rentik_renting", "grover_renting")


def plain_name(name: Column) -> Column:
    """Folded, punctuation as blanks, without stopwords and one-character words."""
    kept = F.regexp_replace(normalize_text(name), r"[^a-z0-9\s\-]", " ")
    words = F.filter(F.split(kept, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.array_join(words, " ")


def model_key(name: Column) -> Column:
    """The recognised model with its storage, else the whole plain name."""
    text = plain_name(name)
    hit = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in MODEL_PATTERNS])
    return F.when(hit.isNotNull(), F.concat_ws(" ", F.trim(hit), F.nullif(F.regexp_extract(text, STORAGE, 1), F.lit("")))).otherwise(text)


def leaders(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy grouping in arrival order, as rounds over the similarity graph.

    ``keys``: id, with ids ordered by arrival; ``edges``: a < b. A key with no earlier undecided
    neighbour leads, its neighbours follow; at the end every follower goes to the earliest leader next
    to it. This is what absorbing later similar keys one by one gives. Every round settles at least
    the first undecided key of each component; rounds are cut with reliable checkpoints.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = cut_lineage(both)
    state = cut_lineage(keys.select("id", F.lit(None).cast("boolean").alias("leads")))
    while True:
        open_ = state.where("leads IS NULL").select("id")
        live = both.join(open_, "id").join(open_.select(F.col("id").alias("other")), "other")
        blocked = live.where("other < id").select("id").distinct()
        fresh = open_.join(blocked, "id", "left_anti").select("id", F.lit(True).alias("_new"))
        taken = live.join(fresh.select(F.col("id").alias("other")), "other").select("id").distinct()
        settled = fresh.unionByName(taken.withColumn("_new", F.lit(False)))
        state = cut_lineage(state.join(settled, "id", "left").select("id", F.coalesce("leads", "_new").alias("leads")))
        if state.where("leads IS NULL").isEmpty():
            break
    heads = state.where("leads").select("id")
    followed = both.join(heads.select(F.col("id").alias("other")), "other").join(
        state.where("NOT leads").select("id"), "id").groupBy("id").agg(F.min("other").alias("leader"))
    return heads.select("id", F.col("id").alias("leader")).unionByName(followed)


def group_products(products: DataFrame, threshold: float = GROUP_THRESHOLD) -> DataFrame:
    """Adds ``group_key``: products share it when their model keys are equal or were merged.

    ``products`` needs name and a non-negative integer _ord. Similarity is computed on distinct keys, whose number is that of
    model names, not of products.
    """
    keyed = products.withColumn("model_key", model_key(F.col("name")))
    first = cut_lineage(keyed.groupBy("model_key").agg(F.min("_ord").alias("_first")))
    # The arrival order of keys as a sortable id: rank by first appearance without a global window.
    ordered = first.select("model_key", F.concat_ws("|", F.lpad(F.col("_first").cast("string"), 20, "0"), "model_key").alias("id"))
    texts = ordered.select("id", sorted_words(F.col("model_key")).alias("text"))
    settled = leaders(ordered.select("id"), similar_within(texts, threshold).select("a", "b"))
    names = ordered.join(settled, "id").join(
        ordered.select(F.col("id").alias("leader"), F.col("model_key").alias("group_key")), "leader")
    return keyed.join(names.select("model_key", "group_key"), "model_key")


def comparison_wide(prices: DataFrame) -> DataFrame:
    """One row per group: cheapest renting and purchase price per source, and the reference product.

    ``prices``: group_key, name, brand, category, source, price_type, price, url, installments, _ord. The reference is the
    first product with a price at the base source, else the first product. Urls are those of the cheapest price; the base
    source has two prices, the one that arrived later gives the url. Its instalments are those of the cheapest rent.
    """
    arrival = F.struct("price", "_ord")
    aggs, urls = [], []
    for source, (renting, purchase) in SOURCES.items():
        for kind, column in (("renting", renting), ("purchase", purchase)):
            if column:
                hit = (F.col("source") == source) & (F.col("price_type") == kind) & F.col("price").isNotNull()
                aggs.append(F.min_by(F.struct("price", "url", "installments", "_ord"), F.when(hit, arrival)).alias(f"_{column}"))
    for source, url in URLS.items():
        renting, purchase = SOURCES[source]
        found = F.col(f"_{renting}.url")
        if purchase:
            later = F.coalesce(F.col(f"_{renting}._ord") > F.col(f"_{purchase}._ord"), F.col(f"_{purchase}").isNull())
            found = F.when(later, found).otherwise(F.col(f"_{purchase}.url"))
        urls.append(found.alias(url))
    order = F.struct((F.col("source") != "home_store").alias("away"), F.col("_ord").alias("o"))
    ref = F.min_by(F.struct("name", "brand", "category"), order).alias("ref")
    names = [c for pair in SOURCES.values() for c in pair if c]
    out = prices.groupBy("group_key").agg(ref, *aggs).select(
        "group_key", "ref.name", "ref.brand", "ref.category", *(F.col(f"_{c}.price").alias(c) for c in names), *urls, F.col("_home_renting.installments").alias("home_instalments"))
    deltas = {
        f"{col}_delta": pct_from(F.col(col), F.nullif(F.col(base), F.lit(0.0)), 1)
        for col, base in (("rentik_renting", "home_renting"), ("grover_renting", "home_renting"), ("movistar_renting", "home_renting"),
                          ("amazon_purchase", "home_purchase"), ("mediamarkt_purchase", "home_purchase"))
    }
    return out.withColumns(deltas)


def category_summary(wide: DataFrame) -> DataFrame:
    """Per category and brand: counts, price ranges, share cheaper, about equal and dearer than the market.

    Cheaper and about equal (within 5%) overlap, and the market minimum mixes renting and purchase
    prices, as in the report this reproduces.
    """
    base = F.coalesce(F.nullif(F.col("home_renting"), F.lit(0.0)), F.nullif(F.col("home_purchase"), F.lit(0.0)))
    offers = [F.nullif(F.col(c), F.lit(0.0)) for c in MARKET]
    low, high = F.least(*offers), F.greatest(*offers)
    rows = wide.select("category", "brand", base.alias("b"), low.alias("lo"), high.alias("hi"))

    def share(cond: Column) -> Column:
        return F.floor(F.count(F.when(cond, 1)) / F.count("*") * 100.0 + 0.5).cast("int")

    return rows.groupBy("category", "brand").agg(
        F.count("*").alias("n"), F.min("b").alias("min_base"), F.max("b").alias("max_base"),
        F.min("lo").alias("min_market"), F.max("hi").alias("max_market"),
        share(F.col("b") < F.col("lo")).alias("cheaper_pct"),
        share(F.abs(F.col("b") - F.col("lo")) / F.col("b") < 0.05).alias("same_pct"),
        share(F.col("b") > F.col("lo") * 1.05).alias("dearer_pct"))


def source_counts(prices: DataFrame) -> DataFrame:
    """Price points and products per source."""
    return prices.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_products"))
