"""Offers out of nested vendor payloads.

Each job reads a table (page_id, payload) of JSON texts. Lists inside one payload are bounded by the
page that carried them, so they are sorted and cut in place; anything across pages is aggregated.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.functions.capacity import largest_mention, small_number_is_tb, standard_sizes
from offerscope.functions.numbers import round_half_up, to_double
from offerscope.functions.prices import parse_rival_price
from offerscope.functions.text import normalize_text
from offerscope.operators.canonical import annuity
from offerscope.operators.dedupe import first_per_key

# --- fixed values: payload shapes ---
GROUPS = ("code string, stock struct<stockLevelStatus:string>, priceGroups array<struct<groupId:string, "
          "prices array<struct<value:double, installments:int, paymentMode:string, "
          "insuranceTypeData:struct<title:string>>>>>").replace("prices array", "prices: array")
RENTAL = ("rentalPlans array<struct<priceInCents:long, durationMonths:int>>, "
          "cheapestRentalPlan struct<priceInCents:long, durationMonths:int>")
INSTALMENTS = ("data struct<installmentCalculations:struct<installments:array<struct<duration:int, "
               "monthlyRate:double>>>>")
LINKED = ("name string, sku string, hasVariant array<struct<sku:string, name:string, "
          "additionalProperty:array<struct<value:string>>, offers:struct<price:string, url:string, "
          "availability:string>>>, offers struct<price:string, url:string, availability:string>, "
          "object struct<sku:string, name:string, offers:struct<price:string, url:string, availability:string>>")
SELECTION = ("products array<struct<familyType:string, dimensionCapacity:string, fullPrice:string>>, "
             "displayValues struct<prices:map<string, struct<currentPrice:struct<raw_amount:string>, "
             "amountBeforeTradeIn:string>>>")
CARD = ("struct<name:string, currentPrice:double, stock:int, pvp_fusion_mv:double, pvp_fusion_av:double, "
        "pvp_fusion_bv:double, monthlyPayment48:double, monthlyPayment36:double, monthlyPayment24:double, "
        "swapRenewalPeriod:double, quotaMonths:double>")
CARDS = (f"offers map<string, map<string, struct<name:string, cards:struct<cardFree:array<{CARD}>, "
         f"cardR2R:array<{CARD}>, cardAditionalR2R:array<{CARD}>>>>>")
OPTIONS = ("code string, baseOptions array<struct<options:array<struct<code:string, name:string, "
           "variantOptionQualifiers:array<struct<qualifier:string, name:string, value:string>>>>>>")
STANDARD_TERMS = (3, 6, 10, 12, 14, 18, 20, 24, 30)
DEFAULT_RATE = 18.95
FREE_TERM = 36
DEFAULT_RENT_TERM = 24
STORAGE_WORDS = ("storage", "capacidad", "capacity", "memory", "memoria", "almacenamiento")


def price_groups(payloads: DataFrame) -> DataFrame:
    """Renting: the two lowest prices, without and with insurance. Card: cash at 0 instalments."""
    doc = payloads.select("page_id", F.from_json("payload", GROUPS).alias("d"))
    groups = doc.select("page_id", (F.col("d.stock.stockLevelStatus") == "inStock").alias("in_stock"),
                        F.explode("d.priceGroups").alias("g"))
    ordered = F.array_sort(F.transform("g.prices", lambda p, i: F.struct(
        F.coalesce(p["value"], F.lit(0.0)).alias("value"), i.alias("i"), p["installments"].alias("term"))))
    kept = F.when(F.col("g.groupId") == "renting", F.slice(ordered, 1, 2)).when(
        F.col("g.groupId") == "creditCard", ordered)
    rows = groups.select("page_id", "in_stock", F.col("g.groupId").alias("grp"), F.posexplode(kept).alias("n", "p"))
    renting = F.col("grp") == "renting"
    cash = ~renting & (F.coalesce("p.term", F.lit(0)) == 0)
    kind = F.when(renting & (F.col("n") == 0), "renting_no_insurance").when(
        renting, "renting_with_insurance").when(cash, "cash").otherwise("financing_max_term")
    term = F.when(renting, F.coalesce("p.term", F.lit(36))).when(~cash, F.col("p.term"))
    return rows.select("page_id", kind.alias("offer_type"), F.col("p.value").alias("price"),
                       term.alias("term_months"), "in_stock")


def cheapest_by_mode(payloads: DataFrame) -> DataFrame:
    """Cheapest price per (modality, term), with the modality read from the payment mode."""
    doc = payloads.select("page_id", F.explode(F.from_json("payload", GROUPS)["priceGroups"]).alias("g"))
    p = doc.select("page_id", F.explode("g.prices").alias("p")).where("p.value IS NOT NULL")
    mode = normalize_text(F.col("p.paymentMode"))
    term = F.when(F.col("p.installments") > 0, F.col("p.installments"))
    insured = normalize_text(F.col("p.insuranceTypeData.title")).contains("con seguro")
    renting = mode.contains("renting")
    financed = mode.rlike("credit ?card") & term.isNotNull()
    kind = F.when(renting & insured, "renting_with_insurance").when(renting, "renting_no_insurance").when(
        financed, "financing_max_term").otherwise("cash")
    flat = p.select("page_id", kind.alias("offer_type"),
                    F.when(renting | financed, term).alias("term_months"), F.col("p.value").alias("value"))
    return flat.groupBy("page_id", "offer_type", "term_months").agg(F.min("value").alias("price"))


def rental_plans(payloads: DataFrame) -> DataFrame:
    """Plans in cents; the cheapest plan stands in when the list is empty."""
    d = payloads.select("page_id", F.from_json("payload", RENTAL).alias("d"))
    listed = F.coalesce(F.size("d.rentalPlans") > 0, F.lit(False))
    plans = F.when(listed, F.col("d.rentalPlans")).when(
        F.col("d.cheapestRentalPlan").isNotNull(), F.array("d.cheapestRentalPlan"))
    rows = d.select("page_id", F.explode(plans).alias("p"))
    return rows.where("p.priceInCents > 0").select(
        "page_id", F.lit("renting_with_insurance").alias("offer_type"),
        (F.col("p.priceInCents") / 100.0).alias("price"),
        F.when(F.col("p.durationMonths") > 0, F.col("p.durationMonths")).alias("term_months"))


def instalment_list(payloads: DataFrame) -> DataFrame:
    """Financing offers from a list of durations and monthly rates, repeats removed."""
    rows = payloads.select("page_id", F.explode(
        F.from_json("payload", INSTALMENTS)["data"]["installmentCalculations"]["installments"]).alias("p"))
    return rows.where("p.duration > 0 AND p.monthlyRate IS NOT NULL").select(
        "page_id", F.lit("financing_max_term").alias("offer_type"), F.col("p.monthlyRate").alias("price"),
        F.col("p.duration").alias("term_months")).distinct()


LINKED_BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def linked_data(pages: DataFrame) -> DataFrame:
    """Products and variants of structured-data script blocks, one row per priced variant.

    A block holds one item or a list of them; an item without offers of its own may be an action whose
    ``object`` is the product. ``place`` counts through all variants of a block.
    """
    blocks = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(LINKED_BLOCK), 1)).alias("block", "json"))
    # One object under an array schema is read as a list of one.
    d = blocks.select("page_id", "block", F.from_json("json", T.ArrayType(T.StructType.fromDDL(LINKED))).alias("d"))

    def variants(item: Column) -> Column:
        own = F.struct(
            F.coalesce(item["sku"], item["object"]["sku"]).alias("sku"), F.coalesce(item["name"], item["object"]["name"]).alias("name"),
            F.lit(None).cast("array<struct<value:string>>").alias("additionalProperty"),
            F.coalesce(item["offers"], item["object"]["offers"]).alias("offers"))
        return F.when(F.size(item["hasVariant"]) > 0, item["hasVariant"]).otherwise(F.array(own))

    rows = d.select("page_id", "block", F.posexplode(F.flatten(F.transform("d", variants))).alias("place", "v"))
    storage = F.array_join(F.transform("v.additionalProperty", lambda p: p["value"]), " ")
    available = F.lower(F.coalesce("v.offers.availability", F.lit("")))
    return rows.select(
        "page_id", "block", "place", F.col("v.sku").alias("sku"), F.col("v.name").alias("name"),
        F.coalesce(largest_mention(storage), largest_mention(F.col("v.name"))).alias("capacity_gb"),
        parse_rival_price(F.col("v.offers.price")).alias("price"), F.col("v.offers.url").alias("url"),
        F.when(available != "", available.contains("instock")).alias("in_stock"),
    ).where("price IS NOT NULL")


def best_variant(variants: DataFrame, targets: DataFrame) -> DataFrame:
    """Variant for each page's target: same product code, then same capacity, in stock, cheapest."""
    joined = variants.join(targets, "page_id")
    code = F.coalesce(F.col("sku") == F.col("t_code"), F.lit(False))
    size = F.coalesce(F.col("capacity_gb") == F.col("t_capacity"), F.lit(False))
    score = F.when(code, 2).otherwise(0) + F.when(size, 1).otherwise(0)
    scored = joined.withColumn("score", score).where("score > 0")
    return first_per_key(scored, ["page_id"], [
        F.col("score").desc(), F.coalesce("in_stock", F.lit(False)).desc(), F.col("price").asc(),
        F.col("block").asc(), F.col("place").asc()])


def option_capacity(option: Column) -> Column:
    """Capacity of a variant option: a storage qualifier first, then any qualifier, then its name."""
    quals = F.coalesce(option["variantOptionQualifiers"], F.array().cast(
        "array<struct<qualifier:string,name:string,value:string>>"))
    named = F.filter(quals, lambda q: normalize_text(F.concat_ws(" ", q["qualifier"], q["name"])).rlike(
        "|".join(STORAGE_WORDS)))

    def sizes(items: Column) -> Column:
        return F.array_max(F.flatten(F.transform(items, lambda q: standard_sizes(q["value"]))))

    first = F.array_max(standard_sizes(F.try_element_at(named, F.lit(1))["value"]))
    return F.coalesce(first, sizes(named), sizes(quals), F.array_max(standard_sizes(option["name"])))


def code_token(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"[^A-Z0-9]", "")


def variant_capacities(payloads: DataFrame) -> DataFrame:
    """Every option with its normalized code and capacity."""
    d = payloads.select("page_id", F.from_json("payload", OPTIONS).alias("d"))
    base = d.select("page_id", F.col("d.code").alias("detail_code"), F.posexplode("d.baseOptions").alias("b", "base"))
    opts = base.select("page_id", "detail_code", "b", F.posexplode("base.options").alias("o", "opt"))
    return opts.select("page_id", "detail_code", "b", "o", F.col("opt.code").alias("code"),
                       code_token(F.col("opt.code")).alias("token"), option_capacity(F.col("opt")).alias("capacity_gb"))


def capacity_for_code(options: DataFrame) -> DataFrame:
    """Capacity of the page's own code; without a matching code, the only capacity there is."""
    mine = F.col("token") == code_token(F.col("detail_code"))
    out = options.groupBy("page_id").agg(
        F.max(mine & (F.col("token") != "")).alias("hit"),
        F.max(F.when(mine & (F.col("token") != ""), F.col("capacity_gb"))).alias("own"),
        F.min("capacity_gb").alias("lo"), F.max("capacity_gb").alias("hi"))
    only = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return out.select("page_id", F.when(F.col("hit"), F.col("own")).otherwise(only).alias("capacity_gb"))


def storage_variants(payloads: DataFrame) -> DataFrame:
    """First code per distinct storage qualifier of a page."""
    d = payloads.select("page_id", F.from_json("payload", OPTIONS).alias("d"))
    opts = d.select("page_id", F.posexplode(F.flatten(F.transform("d.baseOptions", lambda b: b["options"]))).alias("o", "opt"))
    q = opts.select("page_id", "o", F.col("opt.code").alias("code"), F.explode("opt.variantOptionQualifiers").alias("q"))
    rows = q.where("q.qualifier = 'storage' AND q.value <> ''").select("page_id", F.col("q.value").alias("storage"), "o", "code")
    return rows.groupBy("page_id", "storage").agg(F.min_by("code", "o").alias("code"))


SELECTION_KEY = r"productSelectionData:\s*\{"
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def balanced_object(text: str, start: int) -> str | None:
    """The object whose brace opens at ``start``; braces inside quoted strings don't count. None if it never closes."""
    depth = 0
    for found in _BRACES.finditer(text, start):
        if found[0] == "{":
            depth += 1
        elif found[0] == "}":
            depth -= 1
            if not depth:
                return text[start:found.end()]
    return None


def objects_in_html(pages: DataFrame, key: str = SELECTION_KEY) -> DataFrame:
    """page_id and payload: the object after the first ``key`` (a pattern that ends in its opening brace) of each page.

    ``pages``: page_id, html. Pages without the key or with an object that never closes have no row.
    """
    opening = re.compile(key)

    def cut(batches):
        for batch in batches:
            found = [opening.search(html or "") for html in batch.column("html").to_pylist()]
            made = [balanced_object(m.string, m.end() - 1) if m else None for m in found]
            kept = pa.array([m is not None for m in made])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.string())], names=["page_id", "payload"]).filter(kept)

    schema = T.StructType([pages.schema["page_id"], T.StructField("payload", T.StringType())])
    return pages.select("page_id", "html").mapInArrow(cut, schema)


def selection_prices(payloads: DataFrame) -> DataFrame:
    """Products joined to the price dictionary of their own payload; cheapest per family and size."""
    d = payloads.select("page_id", F.from_json("payload", SELECTION).alias("d"))
    rows = d.select("page_id", F.col("d.displayValues.prices").alias("prices"), F.explode("d.products").alias("p"))
    entry = F.try_element_at("prices", "p.fullPrice")
    raw = F.coalesce(entry["currentPrice"]["raw_amount"], entry["amountBeforeTradeIn"])
    size = F.lower(F.trim("p.dimensionCapacity"))
    gb = F.when(size.rlike(r"^\d+(gb|tb)$"), largest_mention(size))
    priced = rows.select("page_id", F.col("p.familyType").alias("family"), gb.alias("capacity_gb"), to_double(raw).alias("price"))
    return priced.where("family <> '' AND capacity_gb > 0 AND price > 0").groupBy(
        "page_id", "family", "capacity_gb").agg(F.min("price").alias("price"))


def family_name(family: Column) -> Column:
    """'iphone17promax' to 'iphone 17 pro max'."""
    s = F.replace(F.regexp_replace(family, r"(\d+)", " $1 "), F.lit("promax"), F.lit("pro max"))
    s = F.regexp_replace(s, r"(?<=[a-z])(ultra|plus|mini|air|max|pro|se|fe)(?=\s|$)", " $1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def financing_schedule(cash: DataFrame, rate: str = "rate") -> DataFrame:
    """Cash offers x standard terms at the page's rate, or the default one."""
    nominal = F.when(F.col(rate) > 0, F.col(rate)).otherwise(F.lit(DEFAULT_RATE))
    rows = cash.withColumn("term_months", F.explode(F.array(*[F.lit(t) for t in STANDARD_TERMS])))
    return rows.withColumn("price", annuity(F.col("cash_price"), F.col("term_months"), nominal)).withColumn(
        "offer_type", F.lit("financing_max_term"))


def free_financing(offers: DataFrame) -> DataFrame:
    """Interest-free financing rows next to the cash rows they come from."""
    cash = offers.where((F.col("offer_type") == "cash") & (F.col("price") != 0))
    plans = cash.withColumn("price", round_half_up(F.col("price") / float(FREE_TERM))).withColumn(
        "offer_type", F.lit("financing_max_term")).withColumn("term_months", F.lit(FREE_TERM))
    return offers.unionByName(plans)


def _first_positive(card: Column, fields: tuple) -> Column:
    return F.coalesce(*[F.when(card[f] > 0, card[f]) for f in fields])


def swap_term(cards: Column) -> Column:
    """Term of the first card that states one."""
    both = F.concat(*[F.coalesce(cards[k], F.array().cast(f"array<{CARD}>")) for k in ("cardAditionalR2R", "cardR2R")])

    def term(card: Column) -> Column:
        paid = F.when(card["monthlyPayment48"] > 0, 48).when(card["monthlyPayment36"] > 0, 36).when(
            card["monthlyPayment24"] > 0, 24)
        return F.coalesce(paid, *[F.when(card[k] >= 1, F.floor(card[k]).cast("int")) for k in ("swapRenewalPeriod", "quotaMonths")])

    return F.try_element_at(F.filter(F.transform(both, term), lambda t: t.isNotNull()), F.lit(1))


def capacity_cards(payloads: DataFrame) -> DataFrame:
    """capacity -> colour -> cards: first colour that has cards; a cash row and a renting row."""
    d = payloads.select("page_id", F.explode(F.from_json("payload", CARDS)["offers"]).alias("size", "colours"))
    first = F.try_element_at(F.filter(F.map_values("colours"), lambda c: c["cards"].isNotNull()), F.lit(1))
    o = d.select("page_id", largest_mention(F.col("size")).alias("capacity_gb"), first.alias("o")).where(
        "capacity_gb > 0 AND o IS NOT NULL")
    free, rent = F.try_element_at("o.cards.cardFree", F.lit(1)), F.try_element_at("o.cards.cardR2R", F.lit(1))
    cash = F.struct(F.lit("cash").alias("offer_type"), free["currentPrice"].alias("price"), F.lit(None).cast("int").alias("term_months"))
    swap = F.struct(F.lit("renting_no_insurance").alias("offer_type"),
                    _first_positive(rent, ("pvp_fusion_mv", "pvp_fusion_av", "pvp_fusion_bv")).alias("price"),
                    swap_term(F.col("o.cards")).alias("term_months"))
    rows = o.select("page_id", "capacity_gb", F.col("o.name").alias("name"), F.inline(F.array(cash, swap)))
    return rows.where("price > 0")


def promo_term(titles: Column) -> Column:
    """Longest interest-free term among promotion titles."""
    good = F.filter(titles, lambda t: F.lower(t).contains("financi") & F.lower(t).contains("sin intereses"))
    months = F.transform(good, lambda t: F.nullif(F.regexp_extract(t, r"(?i)(\d+)\s+mes(?:es)?", 1), F.lit("")).cast("int"))
    return F.nullif(F.array_max(months), F.lit(0))


def positional_pairs(pages: DataFrame) -> DataFrame:
    """Sizes and prices listed in parallel; first price per size. Columns: sizes, prices (arrays)."""
    n = F.least(F.size("sizes"), F.size("prices"))
    zipped = F.arrays_zip(F.slice("sizes", F.lit(1), n).alias("s"), F.slice("prices", F.lit(1), n).alias("p"))
    rows = pages.select("page_id", F.posexplode(zipped).alias("i", "z"))
    flat = rows.select("page_id", "i", small_number_is_tb(F.col("z.s")).alias("capacity_gb"), parse_rival_price(F.col("z.p")).alias("price"))
    return flat.where("capacity_gb > 0 AND price > 0").groupBy("page_id", "capacity_gb").agg(F.min_by("price", "i").alias("price"))


# --- fixed values: names under which product lists lie, and fields that mark a product ---
PRODUCT_PATHS = ("products", "items", "models", "tiles", "edges", "nodes", "results", "hits", "data")
PRODUCT_FIELDS = frozenset(("name", "title", "slug", "price", "sku", "minimumRentalPrice", "modelName", "modelCode"))


def _first_product_list(payload: str | None) -> str | None:
    """JSON of the first list, depth first and usual names first, whose first element looks like a product."""
    try:
        open_nodes = [json.loads(payload or "null")]
    except (ValueError, RecursionError):
        return None
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, list) and node and isinstance(node[0], dict) and not PRODUCT_FIELDS.isdisjoint(node[0]):
            return json.dumps([item for item in node if isinstance(item, dict)])
        if isinstance(node, dict):
            named = [node[name] for name in PRODUCT_PATHS if name in node]
            others = [value for name, value in node.items() if name not in PRODUCT_PATHS]
            open_nodes.extend(reversed(named + others))
    return None


def product_lists(payloads: DataFrame) -> DataFrame:
    """The products of each payload's first product list, at any depth and under any name.

    Empty lists and lists of other things are passed over. Each payload is parsed once, in Arrow batches:
    column expressions can't descend to a depth that is not known beforehand.
    """

    def first_lists(texts: pd.Series) -> pd.Series:
        return texts.map(_first_product_list)

    found = F.pandas_udf(first_lists, T.StringType())("payload")
    items = F.from_json(found, "array<struct<modelName:string, name:string, title:string, modelCode:string, price:string>>")
    rows = payloads.select("page_id", F.posexplode(items).alias("place", "item"))
    return rows.select("page_id", "place", F.coalesce("item.modelName", "item.name", "item.title").alias("name"),
                       F.col("item.modelCode").alias("code"), parse_rival_price(F.col("item.price")).alias("price"))


def first_strategy(rows: DataFrame) -> DataFrame:
    """Keeps, per page, only the rows of the first strategy (lowest number) that found any."""
    best = rows.groupBy("page_id").agg(F.min("strategy").alias("_best"))
    return rows.join(best, "page_id").where(F.col("strategy") == F.col("_best")).drop("_best")


def capacity_slugs(tags: DataFrame) -> DataFrame:
    """'256GB@/path/slug' tags to (capacity, slug); the last tag of a capacity wins."""
    rows = tags.select("page_id", F.posexplode("tags").alias("i", "tag")).where(F.col("tag").contains("@"))
    label, path = F.substring_index("tag", "@", 1), F.regexp_replace("tag", r"^[^@]*@", "")
    flat = rows.select("page_id", "i", largest_mention(label).alias("capacity_gb"),
                       F.trim(F.substring_index(path, "/", -1)).alias("slug"))
    return flat.where("capacity_gb > 0 AND slug <> ''").groupBy("page_id", "capacity_gb").agg(F.max_by("slug", "i").alias("slug"))


def rent_term(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*mes", 1), F.lit("")).cast("int"), F.lit(DEFAULT_RENT_TERM))


def stock_count(text: Column) -> Column:
    return F.coalesce(to_double(text).cast("int"), F.lit(0))
