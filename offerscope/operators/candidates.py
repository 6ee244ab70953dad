"""Which search results of a retailer are the wanted product (F8).

Every text is folded once; what the rules need (word lists, hints, marks, sizes) becomes one column each. A rule
is a row of ``RULES``: conditions on the url, how the model's words are cut, and the names of further checks. The
checks are columns too, worked out once for all retailers, so that the decision is a lookup by retailer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.functions.capacity import GB_SIZES, TB_SIZES
from offerscope.functions.text import normalize_text
from offerscope.operators import features as X

# --- fixed values: words, marks and url shapes that the decisions depend on ---
APPLE_PRODUCTS = ("apple", "iphone", "ipad", "macbook", "imac", "mac mini", "mac studio")
SAMSUNG_WORDS = ("samsung", "galaxy")
MARKS = ("ultra", "plus", "fe", "flip", "fold", "edge", "lite")
APPLE_MARKS = ("pro", "max", "plus", "mini", "air")
SAMSUNG_LAPTOP_MARKS = ("pro", "ultra", "360")
APPLE_LAPTOP_MARKS = ("pro", "air", "mini", "max", "studio")
CONNECTIVITY = ("wifi", "cell", "cellular", "wificell", "wi", "fi")
BARE = {
    "every brand": r"\b(?:samsung|galaxy|apple)\b",
    "family": r"\b(?:apple|iphone|ipad|macbook|imac|mac)\b",
    "samsung": r"\b(?:samsung|galaxy)\b",
}


@dataclass(frozen=True)
class Rule:
    """What a retailer's result must show. Url conditions are substrings of the folded url."""

    url: tuple[str, ...] = ()
    url_by_device: dict[str, tuple[str, ...]] | None = None  # any of them
    url_pattern: str = ""
    url_ban: tuple[str, ...] = ()
    ban: tuple[str, ...] = ()  # in text and url
    bare: str = "own"  # words that don't count: "own" is the family's for Apple and Samsung's else
    whole_words: bool = False  # letters and digits stay together
    ignored_apple: tuple[str, ...] = ()
    ignored_other: tuple[str, ...] = ()
    chips_ignored: bool = False
    checks: tuple[str, ...] = ()


RULES = {
    "Amazon": Rule(url_pattern=r"^(?:[a-z]+:)?//[^/?#]*amazon\..*(?:/dp/|/gp/product/)[a-z0-9]{10}", ban=X.SECOND_HAND, bare="every brand", ignored_apple=CONNECTIVITY,
                   checks=("brand", "apple in title", "no accessory", "device", "words or laptop code", "samsung families", "marks, not for laptops", "apple marks", "capacity")),
    "Grover": Rule(url=("grover.com", "/products/"), whole_words=True, ignored_apple=CONNECTIVITY, chips_ignored=True,
                   checks=("brand", "no accessory", "device", "words", "marks anywhere", "apple marks", "capacity in gb")),
    "Movistar": Rule(url_by_device={"mobile": ("/moviles/",), "tablet": ("/tablet",), "laptop": ("/portatil", "/ordenador", "/laptop")},
                     url_ban=("pack-ahorro", "watch", "smart-tv", "reacondicionado"), checks=("brand", "device", "words", "marks", "apple marks")),
    "Movistar detail": Rule(url_by_device={"mobile": ("/moviles/",), "tablet": ("/tablet",), "laptop": ("/portatil", "/ordenador", "/laptop")}, checks=("detail",)),
    "Media Markt": Rule(url=("/product/", "mediamarkt"), ban=("reacondicionado", "reacondic", "seminuevo", "renovado", "usado", "segunda mano"),
                        ignored_other=("wifi", "wi", "fi", "lte", "cell", "cellular"),
                        checks=("brand", "no accessory but keyboards", "device", "words", "laptop size", "tablet connectivity", "phone connectivity", "one family", "marks but core ultra", "apple marks")),
    "Rentik": Rule(url=("rentik.com",), url_ban=("watch", "reacondicionados", "gaming"), ignored_apple=CONNECTIVITY, chips_ignored=True,
                   checks=("rentik path", "brand", "no accessory", "device", "words", "marks", "apple marks")),
    "Fnac": Rule(url=("fnac.es",), url_pattern=r"/a\d+", url_ban=("watch", "tablet", "tab-", "smart-tv", "reacondicionado", "fundas", "carcasa", "protector"),
                 bare="samsung", checks=("samsung", "words", "marks of any brand")),
    "PcComponentes": Rule(url=("pccomponentes.com",), ban=("reacondicionado", "funda", "carcasa", "protector", "cargador", "auriculares"),
                          bare="samsung", checks=("one path part", "samsung", "words")),
    "Apple Oficial": Rule(checks=("apple wanted", "no accessory", "brand", "device", "apple path")),
    "Samsung Oficial": Rule(url=("samsung.com/es", "/buy/"), url_by_device={"tablet": ("/tablets/",), "laptop": ("/computers/", "/laptops/", "/galaxy-book/"), "mobile": ("/smartphones/",)},
                            checks=("device", "some points", "marks both ways", "5g both ways", "families")),
}
LIST_PATHS = ("/search", "/buscar", "/smartphone-moviles", "/smartphone-y-tablets", "/tablets", "/televisores", "/smartwatch", "/pulseras", "/auriculares", "/galaxy-unpacked")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")" if words else "false"


def _all(column: str, words) -> str:
    return " AND ".join(f"contains({column}, {_quoted(w)})" for w in words) or "true"


def _list(words) -> str:
    return f"array({', '.join(map(_quoted, words))})"


def _matches(column: str, pattern: str) -> str:
    return f"rlike({column}, {_quoted(pattern)})"


def _first(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, {_quoted(pattern)}, 1)"


def _runs(column: str) -> str:
    """Runs of letters and of digits, apart; plus signs stay."""
    apart = f"regexp_replace(regexp_replace({column}, '([a-z])([0-9])', '$1 $2'), '([0-9])([a-z])', '$1 $2')"
    return f"filter(split({apart}, '[^a-z0-9+]+'), t -> t <> '')"


def _marks(tokens: str, raw: str) -> str:
    plus = f"if({_matches(raw, r'\b[saz][0-9]{1,3}[+]')}, array('plus'), cast(array() AS array<string>))"
    return f"array_union(array_intersect({_list(MARKS)}, {tokens}), {plus})"


def _same_number(word: str) -> str:
    """The wanted generation after ``word``, if it has one, stands in the text too."""
    number = _first("_bare", rf"\b{word}\s*(\d{{1,2}})\b")
    return f"({number} = '' OR rlike(_mix, concat('\\\\b{word}\\\\s*', {number}, '\\\\b')))"


def _by_retailer(value, otherwise: str) -> str:
    arms: dict[str, list[str]] = {}
    for name, rule in RULES.items():
        arms.setdefault(value(rule), []).append(name)
    return "CASE " + " ".join(f"WHEN retailer IN ({', '.join(map(_quoted, names))}) THEN {sql}" for sql, names in arms.items()) + f" ELSE {otherwise} END"


def _folded(df: DataFrame) -> DataFrame:
    """The texts, each folded once. At a detail page an Apple product is looked for in the page's text as well."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = df.withColumns({
        "_brand": normalize_text(F.col("brand")), "_model": normalize_text(F.col("model")), "_url": normalize_text(F.col("href")), "_code": normalize_text(F.col("product_code")),
        "_kind": F.lower(F.trim(text("device_type")))})
    body = F.when((F.col("retailer") == "Movistar detail") & (F.col("_brand") == "apple"), F.concat(F.lit(" "), text("body"))).otherwise("")
    seen = seen.withColumn("_shown", F.concat(text("text"), body, F.lit(" "), text("href")))
    return seen.withColumns({
        "_apple": F.col("_brand") == "apple", "_samsung": F.col("_brand") == "samsung",
        "_device": F.when(F.col("_kind").isin("tablet", "laptop"), F.col("_kind")).otherwise("mobile"),
        "_mix": normalize_text(F.col("_shown")), "_raw": F.lower("_shown"), "_name": F.lower(text("model")),
        "_title": normalize_text(F.when(text("title") != "", text("title")).otherwise(text("text"))),
        "_detail": normalize_text(F.concat_ws(" ", text("text"), text("href"), text("body"))),
        "_path": F.regexp_extract("_url", r"^(?:(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)})


def _with_words(df: DataFrame) -> DataFrame:
    bare = _by_retailer(lambda r: f"if(_apple, {_quoted(BARE['family'])}, {_quoted(BARE['samsung'])})" if r.bare == "own" else _quoted(BARE[r.bare]), "''")
    df = df.withColumns({
        "_compact": F.regexp_replace("_mix", "[^a-z0-9]", ""),
        "_code_root": F.regexp_replace(F.split(F.col("_code"), "[-_/]")[0], "[^a-z0-9]", ""), "_code": F.regexp_replace("_code", "[^a-z0-9]", ""),
        "_mix_runs": F.expr(_runs("_mix")), "_model_runs": F.expr(_runs("_model")), "_url_runs": F.expr(_runs("_url")),
        "_bare": F.expr(f"trim(regexp_replace(regexp_replace(_model, {bare}, ' '), '\\\\s+', ' '))"),
        "_any_accessory": F.expr(_any("_mix", X.ACCESSORY_HINTS)),
        "_laptop": F.expr(f"{_any('_mix', X.LAPTOP_HINTS)} OR {_any('_mix', SAMSUNG_WORDS)} AND {_matches('_mix', r'\bbook\s*\d?\b')}"),
        "_tablet": F.expr(f"{_any('_mix', ('ipad', 'tablet'))} OR {_matches('_mix', r'\btab(?:let|lets)?\b')}")})
    words = _by_retailer(lambda r: "split(_bare, '[^a-z0-9]+')" if r.whole_words else _runs("_bare"), "cast(array() AS array<string>)")
    ignored = _by_retailer(lambda r: f"if(_apple, {_list(('5g', 'gb', '', *r.ignored_apple))}, {_list(('5g', 'gb', '', *r.ignored_other))})", "array('')")
    df = df.withColumns({
        "_words": F.expr(f"filter(array_except({words}, {ignored}), w -> NOT ({_by_retailer(lambda r: 'true' if r.chips_ignored else 'false', 'false')} AND _apple AND rlike(w, '^m[0-9]+$')))"),
        "_wanted": F.expr(_marks("_model_runs", "concat(_name, ' ', _model)")), "_found": F.expr(_marks("_mix_runs", "concat(_raw, ' ', _mix)")),
        "_linked": F.expr(_marks("_url_runs", "concat(lower(coalesce(href, '')), ' ', _url)")),
        "_sizes": F.expr(f"array_union(transform(regexp_extract_all(_mix, {_quoted(GB_SIZES)}, 1), v -> cast(v AS int)), transform(regexp_extract_all(_mix, {_quoted(TB_SIZES)}, 1), v -> cast(v AS int) * 1024))")})
    strong = _by_retailer(lambda r: "length(w) >= 4 OR rlike(w, '[0-9]') AND NOT rlike(w, '^[0-9]+$')" if r.whole_words else "length(w) >= 4 OR rlike(w, '[0-9]')", "false")
    return df.withColumn("_all_words", F.expr(f"forall(_words, w -> NOT ({strong}) OR contains(_mix, w))"))


SMALL_GB = r"\b(64|128|256|512|1024)\s*gb\b"
FAMILY_NUMBER, FOLDING = r"\b{}\s*(\d{{2,3}})\b", r"{}\s*(\d{{1,2}})"


def _subset(wanted: str, found: str, foreign: str) -> str:
    """Wanted marks are found; a product without any has none of the foreign ones."""
    return f"if(size({wanted}) > 0, size(array_except({wanted}, {found})) = 0, size({foreign}) = 0)"


def _checks() -> dict[str, str]:
    """Every check as SQL over the columns above."""
    code_found = "(_code <> '' AND contains(_compact, _code) OR length(_code_root) >= 6 AND contains(_compact, _code_root))"
    book = _first("_model", r"\bbook\s*(\d{1,2})\b")
    books = f"regexp_extract_all(_mix, {_quoted(r'\bbook\s*(\d{1,2})\b')}, 1)"
    missing = lambda marks: f"size(array_except(array_intersect({_list(marks)}, _model_runs), _mix_runs)) = 0"
    named = " AND ".join(f"(NOT contains(_model, '{w}') OR contains(_mix, '{w}'))" for w in ("macbook", "imac", "mac mini", "mac studio"))
    laptop = (f"{code_found} OR if(_samsung, ({book} = '' OR contains(_compact, concat('book', {book})) AND (size({books}) = 0 OR array_contains({books}, {book}))) AND {missing(SAMSUNG_LAPTOP_MARKS)}, true)"
              f" AND if(_apple, {missing(APPLE_LAPTOP_MARKS)} AND {named}, true)")
    kind = (f"CASE WHEN _any_accessory THEN NULL WHEN _laptop THEN 'laptop' WHEN _tablet THEN 'tablet' WHEN {_any('_mix', (*X.MOBILE_HINTS, *X.BRAND_HINTS))} THEN 'mobile' END")
    device = (f"coalesce({kind} = _device, true) AND CASE _device WHEN 'laptop' THEN _laptop AND ({laptop}) WHEN 'tablet' THEN _tablet AND NOT _laptop"
              " ELSE (NOT _apple OR contains(_mix, 'iphone') OR contains(_mix, 'apple')) AND NOT _tablet AND NOT _laptop END")

    apple_number = _first("_model", r"\biphone\s*(\d{1,2})\b")
    apple_words = lambda c: f"filter({_list(APPLE_MARKS)}, m -> rlike({c}, concat('\\\\b', m, '\\\\b')))"
    apple_marks = f"({apple_number} = '' OR rlike(_mix, concat('\\\\biphone\\\\s*', {apple_number}, '\\\\b'))) AND {_subset(apple_words('_model'), apple_words('_mix'), apple_words('_mix'))}"

    anywhere = ("ultra", "plus", "fe", "flip", "fold")
    plus = f"if({_matches('_raw', r'\b[saz][0-9]{1,3}[+]')}, array('plus'), cast(array() AS array<string>))"
    seen_anywhere = f"array_union(filter({_list(anywhere)}, m -> contains(_mix, m)), {plus})"
    wifi = lambda c: _matches(c, r"\bwi[\s\-]?fi\b")
    cell = lambda c: _any(c, ("5g", "lte", "cell"))
    word = lambda c, w: _matches(c, rf"\b{w}\b")
    size = _first("_bare", r"\b(1[4-7])\b")
    family = r"\b([sa])\s*(\d{1,3})\b"
    letter, number = f"regexp_extract(_bare, {_quoted(family)}, 1)", f"regexp_extract(_bare, {_quoted(family)}, 2)"

    def families(text: str) -> str:
        """Wanted S and A numbers and folding generations, written without gap."""
        sa = [f"forall(regexp_extract_all(_model, {_quoted(FAMILY_NUMBER.format(letter))}, 1), n -> contains({text}, concat('{letter}', n)))" for letter in "sa"]
        z = [f"({_first('_model', FOLDING.format(word))} = '' OR contains({text}, concat('{word}', {_first('_model', FOLDING.format(word))})))" for word in ("flip", "fold")]
        return " AND ".join(sa + z)

    laptop_core = "if(_device = 'laptop' AND contains(_mix, 'core ultra'), array_remove(_found, 'ultra'), _found)"
    sized = "coalesce(capacity_gb, 0) = 0 OR size({found}) = 0 OR array_contains({found}, capacity_gb)"
    in_gb = f"transform(regexp_extract_all(_mix, {_quoted(SMALL_GB)}, 1), v -> cast(v AS int))"
    detail_family = _first("_model", r"\b([saz]\d{1,3})\b")
    detail_found = _marks(_runs("_detail"), "concat(_raw, ' ', _detail)")
    detail = (f"if(_apple, ({{movistar}}), {_any('_detail', SAMSUNG_WORDS)} AND ({device}) AND {detail_family} <> '' AND contains(_detail, {detail_family}) AND {_subset('_wanted', detail_found, detail_found)})")

    phone_path = (f"CASE WHEN {_any('_model', ('iphone air', 'iphone 17 air'))} THEN contains(_path, 'iphone-air') WHEN contains(_model, '16e') THEN contains(_path, 'iphone-16e')"
                  f" WHEN {apple_number} = '' THEN contains(_path, '/shop/buy-iphone/')"
                  f" WHEN contains(_model, 'pro max') OR {_matches('_model', r'\biphone\s*\d{1,2}\s*pro\b')} THEN contains(_path, concat('iphone-', {apple_number}, '-pro'))"
                  f" ELSE contains(_path, concat('iphone-', {apple_number})) AND NOT contains(_path, concat('iphone-', {apple_number}, '-pro')) AND NOT contains(_path, 'iphone-air') END")
    paths = lambda names: " ".join(f"WHEN contains(_model, '{n}') THEN contains(_path, '{n.replace(' ', '-')}')" for n in names)
    tablet_path = f"CASE {paths(('ipad pro', 'ipad air', 'ipad mini'))} ELSE contains(_path, '/shop/buy-ipad/') AND NOT {_any('_path', ('ipad-pro', 'ipad-air', 'ipad-mini'))} END"
    mac_path = f"CASE {paths(('mac mini', 'mac studio', 'macbook air', 'macbook pro', 'imac'))} ELSE contains(_path, '/shop/buy-mac/') END"

    points_words = "filter(split(trim(regexp_replace(_model, " + _quoted(BARE["every brand"]) + ", ' ')), '[^a-z0-9]+'), w -> w NOT IN ('', '5g', 'gb'))"
    points = (f"if(_apple, int(contains(_mix, 'apple')) + int({_any('_mix', ('iphone', 'ipad', 'macbook'))}), int(contains(_mix, 'samsung')) + int(contains(_mix, 'galaxy')))"
              f" + 2 * size(filter({points_words}, w -> contains(_mix, w))) + if(coalesce(capacity_gb, 0) = 0, 0, if(contains(_mix, cast(capacity_gb AS string)), 3, 0)"
              " + CASE WHEN size(_sizes) = 0 THEN 0 WHEN array_contains(_sizes, capacity_gb) THEN 2 ELSE -3 END)")
    variants = "array_intersect(_found, array('ultra', 'plus', 'fe', 'lite', 'edge'))"
    strict = "array('ultra', 'plus', 'fe', 'flip', 'fold', 'lite')"
    checks = {
        "brand": f"if(_apple, {_any('_mix', APPLE_PRODUCTS)}, {_any('_mix', SAMSUNG_WORDS)})",
        "samsung": _any("_mix", SAMSUNG_WORDS),
        "apple wanted": "_apple",
        "apple in title": "NOT _apple OR contains(_title, 'apple')",
        "no accessory": "NOT _any_accessory",
        "no accessory but keyboards": f"if(_device = 'laptop', NOT {_any('_mix', [w for w in X.ACCESSORY_HINTS if w not in ('teclado', 'keyboard')])}, NOT _any_accessory)",
        "device": device,
        "words": "_all_words",
        "words or laptop code": f"_all_words OR _device = 'laptop' AND {code_found}",
        "samsung families": f"NOT _samsung OR {families('_compact')}",
        "families": families("replace(_mix, ' ', '')"),
        "marks": f"_apple OR {_subset('_wanted', '_found', '_found')}",
        "marks of any brand": _subset("_wanted", "_found", "_found"),
        "marks, not for laptops": f"NOT _samsung OR _device = 'laptop' OR {_subset('_wanted', '_found', variants)}",
        "marks anywhere": f"_apple OR {_subset(f'array_intersect({_list(anywhere)}, _words)', seen_anywhere, seen_anywhere)}",
        "marks but core ultra": f"_apple OR {_subset('_wanted', laptop_core, laptop_core)}",
        "marks both ways": f"size(array_except(array_intersect({strict}, _wanted), _found)) = 0 AND size(array_except(array_intersect({strict}, _linked), _wanted)) = 0",
        "5g both ways": "if(contains(_model, '5g'), contains(_mix, '5g'), NOT contains(_url, '5g'))",
        "apple marks": f"NOT _apple OR {apple_marks}",
        "capacity": sized.format(found="_sizes"),
        "capacity in gb": sized.format(found=in_gb),
        "laptop size": f"_apple OR _device <> 'laptop' OR {size} = '' OR rlike(_mix, concat('(?<![0-9])', {size}, '(?![0-9])'))",
        "tablet connectivity": f"_apple OR _device <> 'tablet' OR NOT ({wifi('_model')} AND {cell('_mix')}) AND NOT ({cell('_model')} AND {wifi('_mix')} AND NOT {cell('_mix')})",
        "phone connectivity": f"_apple OR _device <> 'mobile' OR NOT ({word('_model', '5g')} AND {word('_mix', 'lte')} AND NOT {word('_mix', '5g')}) AND NOT ({word('_model', 'lte')} AND {word('_mix', '5g')} AND NOT {word('_mix', 'lte')})",
        "one family": f"_apple OR ({letter} = '' OR rlike(_mix, concat('\\\\b', {letter}, '\\\\s*', {number}, '\\\\b'))) AND {_same_number('flip')} AND {_same_number('fold')}",
        "rentik path": f"if(_apple, {_any('_url', ('/ofertas-alquilar/iphone/', '/ofertas-alquilar/apple/'))}, contains(_url, '/ofertas-alquilar/samsung/')) AND NOT {_matches('_url', '/(apple|samsung)/*$')}",
        "one path part": f"_path NOT IN ('', '/') AND NOT {_matches('_url', r'\?[^#]*offer=')} AND NOT {_any('_path', LIST_PATHS)} AND size(filter(split(_path, '/'), p -> p <> '')) = 1",
        "apple path": f"CASE _device WHEN 'mobile' THEN {phone_path} WHEN 'tablet' THEN {tablet_path} ELSE {mac_path} END",
        "some points": f"{points} >= 2",
    }
    movistar = RULES["Movistar"]
    strictly = [f"({checks[c]})" for c in movistar.checks] + [f"NOT {_any('_url', movistar.url_ban)}"]
    return checks | {"detail": detail.replace("{movistar}", " AND ".join(strictly))}


def accept_candidates(df: DataFrame) -> DataFrame:
    """All columns of ``df`` and ``accepted``: whether a search result is the wanted product, by its retailer's rule.

    ``df``: retailer, brand, model, capacity_gb, device_type, product_code of the wanted product; text, href, title
    (the text, where null or empty) and body (of a detail page) of the result. Unknown retailers accept nothing.
    Retailers without a size check leave the exact variant to the product page.
    """
    columns = df.columns
    wide = _with_words(_folded(df.select(*(F.col(f"`{c}`") for c in columns))))
    checks = _checks()
    # a check that several rules share is one column, worked out once
    shared = [c for c in checks if sum(c in rule.checks for rule in RULES.values()) > 1]
    named = {c: f"_check{i}" for i, c in enumerate(shared)}
    wide = wide.withColumns({named[c]: F.expr(checks[c]) for c in shared})

    def decision(rule: Rule) -> str:
        parts = [_all("_url", rule.url)] if rule.url else []
        if rule.url_by_device:
            parts.append("CASE _device " + " ".join(f"WHEN '{d}' THEN {_any('_url', words)}" for d, words in rule.url_by_device.items()) + " ELSE false END")
        if rule.url_pattern:
            parts.append(_matches("_url", rule.url_pattern))
        parts += [f"NOT {_any('_url', rule.url_ban)}"] if rule.url_ban else []
        parts += [f"NOT {_any('_mix', rule.ban)}"] if rule.ban else []
        parts += [named.get(c) or f"({checks[c]})" for c in rule.checks]
        return " AND ".join(parts)

    accepted = "CASE retailer " + " ".join(f"WHEN {_quoted(name)} THEN {decision(rule)}" for name, rule in RULES.items()) + " ELSE false END"
    # a generator, so that a filter on the decision is not pushed below the columns that it is made of
    decided = F.explode(F.array(F.coalesce(F.expr(accepted), F.lit(False))))
    return wide.select(*(F.col(f"`{c}`") for c in columns), decided.alias("accepted"))

