"""DuckDB side of the matching queries: similarity scores and the matches by comparing everything."""

from __future__ import annotations

from offerscope.operators import features as X
from offerscope.operators import grouping as G
from offerscope.operators import matching as M


def common(a: str, b: str) -> str:
    """Longest common subsequence of two short strings, by one row of bits per character of ``b``."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[CAST(i + 1 AS INT)] = ch THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END)), 0)::HUGEINT"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    row = f"list_reduce(list_prepend({full}, {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({row}) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100::DOUBLE ELSE 100::DOUBLE * 2 * {common(a, b)} / (length({a}) + length({b})) END)"


def words(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))), ' ')"


def token_set(source: str, a: str, b: str) -> str:
    """CTEs that end in ``rated``: the rows of ``source`` with ``_ratio`` of the word sets ``a`` and ``b``."""
    return f""", ts1 AS (SELECT *, string_split({a}, ' ') AS wa, string_split({b}, ' ') AS wb FROM {source}),
 ts2 AS (SELECT *, array_to_string(list_filter(wa, lambda w: list_contains(wb, w)), ' ') AS core, array_to_string(list_filter(wa, lambda w: NOT list_contains(wb, w)), ' ') AS x,
  array_to_string(list_filter(wb, lambda w: NOT list_contains(wa, w)), ' ') AS y FROM ts1),
 ts3 AS (SELECT *, length(core) AS c, CASE WHEN core = '' THEN 0 ELSE 1 END AS gap, length(x) + length(y) - 2 * {common('x', 'y')} AS edits FROM ts2),
 rated AS (SELECT * EXCLUDE (wa, wb, core, x, y, c, gap, edits), CASE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN core <> '' AND (x = '' OR y = '') THEN 100::DOUBLE
  WHEN core = '' THEN 100::DOUBLE - 100::DOUBLE * edits / (length(x) + length(y))
  ELSE greatest(100::DOUBLE - 100::DOUBLE * edits / (2 * (c + gap) + length(x) + length(y)), 100::DOUBLE - 100::DOUBLE * (gap + length(x)) / (c + c + gap + length(x)),
   100::DOUBLE - 100::DOUBLE * (gap + length(y)) / (c + c + gap + length(y))) END AS _ratio FROM ts3)"""


def clean(x: str) -> str:
    out = f"lower({x})"
    for pattern, new in X.NAME_REWRITES:
        pat = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{pat}', '{new.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def without_noise(x: str) -> str:
    """RE2 has no look-ahead: what follows is put back instead."""
    for pattern in X.NOISE_NUMBERS:
        ahead = "(?=" in pattern
        pat = pattern.replace("(?=", "(") if ahead else pattern
        x = f"regexp_replace({x}, '(?i){pat}', '{chr(92) + '1' if ahead else ''}', 'g')"
    return x


def numbers(x: str) -> str:
    return f"""list_sort(list_distinct(list_filter(list_concat(regexp_extract_all({x}, '\\b[a-z]+(\\d+)\\b', 1),
 regexp_extract_all({x}, '\\b(\\d{{2,}})\\b', 1)), lambda v: NOT (v = '5' AND regexp_matches({x}, '\\b5g\\b')))))"""


def listed(x: str, chosen) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w IN ({', '.join(repr(w) for w in chosen)})))), ' ')"


SERIES = r"coalesce(nullif(regexp_extract({x}, '\bgalaxy\s+([asz])\s*\d{{1,2}}\b', 1), ''), nullif(regexp_extract({x}, '\b([asz])\s*\d{{1,2}}\b', 1), ''))"
CHIP = r"""CASE WHEN contains(lower({x}), 'mac') AND regexp_matches(lower({x}), '\bm\d{{1,2}}\b') THEN regexp_extract(lower({x}), '\b(m\d{{1,2}})\b', 1) || ' '
 || coalesce(nullif(regexp_extract(lower({x}), '\bm\d{{1,2}}\s+(pro|max|ultra)\b', 1), ''), 'base') END"""


def _features(source: str, name: str, mode: str) -> str:
    base = {"strict": "clean", "scored": without_noise("clean"), "chipless": r"trim(regexp_replace(regexp_replace(clean, '\bm\d\b', '', 'g'), '\s+', ' ', 'g'))"}[mode]
    chosen = X.STRICT_VARIANTS if mode == "chipless" else X.TIERS
    chip = "NULL::VARCHAR" if mode == "chipless" else CHIP.format(x=name)
    return f"""SELECT *, {words('clean')} AS words, {numbers('base')} AS numbers, {listed('clean', chosen)} AS tiers, {SERIES.format(x='clean')} AS series, {chip} AS chip
 FROM (SELECT *, {base} AS base FROM (SELECT *, {clean(name)} AS clean FROM {source}))"""


def _differ(a: str, b: str) -> str:
    return f"coalesce({a} <> {b}, false)"


def catalogue(title: str, target: str, mode: str, final: str) -> str:
    """``final`` over ``matched``: title row, target_id and score of the best target, every name against every target."""
    scored = mode == "scored"
    threshold = M.SCORED_THRESHOLD if scored else M.CATALOGUE_THRESHOLD
    meet = "(len(n.numbers) = 0 OR len(list_filter(t.numbers, lambda v: NOT list_contains(n.numbers, v))) = 0)" if scored else \
        f"(len(n.numbers) = 0 OR len(t.numbers) = 0 OR n.numbers = t.numbers) AND n.tiers = t.tiers AND NOT {_differ('n.series', 't.series')}"
    capacity = _differ("nullif(n.capacity_gb, 0)", "nullif(t.capacity_gb, 0)")
    penalty = M.PENALTIES
    score = f"""_ratio - CASE WHEN len(n.numbers) > 0 AND len(t.numbers) > 0 AND n.numbers <> t.numbers THEN {penalty['numbers_differ']} ELSE 0 END
  - CASE WHEN n.tiers <> t.tiers THEN {penalty['tiers']} ELSE 0 END - CASE WHEN {_differ('n.series', 't.series')} THEN {penalty['series']} ELSE 0 END
  - CASE WHEN {capacity} THEN {penalty['capacity']} ELSE 0 END - CASE WHEN regexp_matches(n.clean, '\\b(201\\d|202[0-2])\\b') THEN {penalty['old_year']} ELSE 0 END""" if scored else "_ratio"
    return f"""WITH tt AS MATERIALIZED (SELECT {title} AS name, CASE WHEN l_linenumber = 1 THEN 256 WHEN l_linenumber = 3 THEN 512 END AS capacity_gb, count(*) AS titles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 n AS MATERIALIZED ({_features('tt', 'name', mode)}),
 t AS MATERIALIZED ({_features(f"(SELECT p_partkey AS target_id, {target} AS model, CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END AS capacity_gb FROM part)", 'model', mode)}),
 nn AS (SELECT DISTINCT words, numbers, tiers, series FROM n), tn AS (SELECT DISTINCT words, numbers, tiers, series FROM t),
 couples AS MATERIALIZED (SELECT DISTINCT n.words AS nw, t.words AS tw FROM nn n JOIN tn t ON {meet}){token_set('couples', 'nw', 'tw')},
 good AS MATERIALIZED (SELECT * FROM rated WHERE _ratio >= {threshold}),
 s AS (SELECT n.name, n.capacity_gb, n.titles, t.target_id, {score} AS score FROM n JOIN good ON nw = n.words JOIN t ON tw = t.words
  WHERE {meet} AND NOT {_differ('n.chip', 't.chip')}{'' if scored else f' AND NOT {capacity}'}),
 matched AS (SELECT *, floor(score * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS rounded FROM s WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY name, capacity_gb ORDER BY score DESC, target_id) = 1)
 {final}"""


PER_TARGET = "SELECT target_id, CAST(sum(titles) AS BIGINT) AS n_titles, max(rounded) AS best, min(rounded) AS worst FROM matched GROUP BY 1"
PER_OUTCOME = "SELECT rounded >= 100 AS exact, CAST(sum(titles) AS BIGINT) AS n FROM matched GROUP BY 1"

_STOP = ", ".join(repr(w) for w in G.STOPWORDS)


def plain_name(x: str) -> str:
    """ASCII names only, as the part names are."""
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), ' ')"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"


BEST = f"""WITH w AS (SELECT p_partkey AS part, {sorted_words(plain_name("p_name || 's the new'"))} AS a FROM part),
 c AS (SELECT p_name AS name, {sorted_words('p_name')} AS b, min(p_partkey) AS o FROM part GROUP BY p_name),
 pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM w, c), r AS MATERIALIZED (SELECT a, b, {ratio('a', 'b')} AS score FROM pairs)
 SELECT part, name, floor(score * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE) AS score FROM w JOIN r USING (a) JOIN c USING (b)
 WHERE score >= {M.GROUP_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY part ORDER BY r.score DESC, o) = 1"""

# The greedy loop itself: keys in order of arrival, each absorbed by the first leader that is similar enough.
GROUPS = f"""WITH RECURSIVE p AS (SELECT {plain_name("p_brand || ' ' || p_name")} AS model_key, p_partkey FROM part),
 k AS MATERIALIZED (SELECT model_key, {sorted_words('model_key')} AS s, row_number() OVER (ORDER BY min(p_partkey), model_key) AS nr, count(*) AS n FROM p GROUP BY model_key),
 pairs AS MATERIALIZED (SELECT DISTINCT least(a.s, b.s) AS x, greatest(a.s, b.s) AS y FROM k a JOIN k b ON a.nr < b.nr),
 near AS MATERIALIZED (SELECT x, y FROM pairs WHERE {ratio('x', 'y')} >= {M.GROUP_THRESHOLD}),
 edge AS MATERIALIZED (SELECT b.nr AS nr, list(a.nr ORDER BY a.nr) AS earlier FROM k a JOIN k b ON a.nr < b.nr JOIN near ON x = least(a.s, b.s) AND y = greatest(a.s, b.s) GROUP BY b.nr),
 go(nr, leaders, leader) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT next, CASE WHEN found IS NULL THEN list_append(leaders, next) ELSE leaders END, coalesce(found, next) FROM (
   SELECT g.nr + 1 AS next, g.leaders, list_min(list_intersect(g.leaders, coalesce(e.earlier, []))) AS found FROM go g LEFT JOIN edge e ON e.nr = g.nr + 1 WHERE g.nr < (SELECT max(nr) FROM k)))
 SELECT l.model_key AS group_key, CAST(sum(k.n) AS BIGINT) AS n_products, count(*) AS n_keys FROM go JOIN k USING (nr) JOIN k l ON l.nr = go.leader GROUP BY l.model_key"""

_R6 = "floor({x} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"


def slugs(target: str, href: str) -> str:
    """Every target against every url."""
    name = "trim(regexp_replace(regexp_replace(lower(model), '^(apple|samsung)\\s+', ''), '\\d+\\s*(gb|tb)', '', 'g'))"
    slug = "trim(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(href, '/+$', ''), '[^/]*$')), '[^a-z0-9 ]', ' ', 'g'), '\\b5g\\d*\\b', '5g', 'g'))"
    variants = ", ".join(repr(v) for v in M.SLUG_VARIANTS)
    return f"""WITH t AS (SELECT p_partkey AS target_id, {name} AS m FROM (SELECT p_partkey, {target} AS model FROM part)),
 h AS (SELECT href, o, {slug} AS s FROM (SELECT {href} AS href, p_partkey AS o FROM part)),
 tw AS (SELECT *, list_distinct(regexp_split_to_array(m, '\\s+')) AS ws, {words('m')} AS a FROM t), hw AS (SELECT *, list_distinct(regexp_split_to_array(s, '\\s+')) AS vs, {words('s')} AS b FROM h),
 f AS MATERIALIZED (SELECT *, (1::DOUBLE - len(list_filter(ws, lambda w: NOT list_contains(vs, w)))::DOUBLE / len(ws))
  * greatest(0::DOUBLE, 1::DOUBLE - 0.4::DOUBLE * len(list_filter(vs, lambda v: v IN ({variants}) AND NOT list_contains(ws, v)))) AS factor FROM tw, hw WHERE len(list_intersect(ws, vs)) > 0),
 k AS (SELECT * FROM f WHERE factor * 100 >= {M.SLUG_THRESHOLD}){token_set('k', 'a', 'b')}
 SELECT target_id, href, {_R6.format(x='_ratio * factor')} AS score FROM rated WHERE _ratio * factor >= {M.SLUG_THRESHOLD}
 QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY _ratio * factor DESC, o) = 1"""


def _family(n: str, t: str) -> str:
    arms = []
    for family in X.FAMILIES:
        loose = X.LOOSE_FAMILIES.get(family)
        verdict = " OR ".join(f"contains({n}, '{w}')" for w in loose) if loose else "false"
        arms.append(f"WHEN contains({t}, '{family}') AND NOT contains({n}, '{family}') THEN {verdict}")
    return f"CASE {' '.join(arms)} ELSE true END"


def _variant(n: str, t: str) -> str:
    return (f"({listed(n, X.STRICT_VARIANTS)} <> {listed(t, X.STRICT_VARIANTS)} OR (contains({n}, 'cellular') <> contains({t}, 'cellular') AND (contains({t}, 'ipad') OR contains({t}, 'tab'))))")


_SIGNATURE = r"""CASE WHEN regexp_matches(lower({x}), '\bwi[\s-]?fi\b') AND regexp_matches(lower({x}), 'cellular|celular|\b5g\b') THEN 'wifi_cellular'
 WHEN regexp_matches(lower({x}), 'cellular|celular|\b5g\b') THEN 'cellular' WHEN regexp_matches(lower({x}), '\bwi[\s-]?fi\b') THEN 'wifi' END"""


def clashes(target: str, title: str) -> str:
    a, b = _SIGNATURE.format(x="model"), _SIGNATURE.format(x="title")
    return f"""WITH p AS (SELECT DISTINCT {target} AS model, {title} AS title FROM lineitem JOIN part ON l_partkey = p_partkey),
 c AS (SELECT *, {clean('title')} AS n, {clean('model')} AS t, {a} AS sa, {b} AS sb FROM p)
 SELECT model, title, coalesce(sa = 'wifi' AND sb IN ('cellular', 'wifi_cellular') OR sa IN ('cellular', 'wifi_cellular') AND sb = 'wifi', false) AS clash,
 {_family('n', 't')} AS family, {_variant('n', 't')} AS variant FROM c"""


_ACCESSORY = "(regexp_matches(lower(title), '" + "|".join(X.ACCESSORY_WORDS) + "') OR regexp_matches(lower(title), '" + X.FOR_DEVICE.replace("\\", "\\") + "'))"


def cards(target: str, title: str) -> str:
    """Every search card of a query: vetoes, penalties, the searched code."""
    penalty = M.PENALTIES
    both, subset = "(len(nn) > 0 AND len(tn) > 0)", "(len(list_filter(tn, lambda v: NOT list_contains(nn, v))) = 0)"
    score = "_ratio"
    for hit, name in ((f"{both} AND NOT {subset}", "numbers_subset"), (f"{both} AND {subset} AND nn <> tn", "numbers_differ"), ("nt <> tt", "tiers"), (_differ("ns", "tser"), "series"),
                      (_differ("nc", "tc"), "chip"), (r"regexp_matches(n, '\b(201\d|202[0-2])\b')", "old_year")):
        score = f"greatest(0::DOUBLE, {score} - CASE WHEN {hit} THEN {penalty[name]} ELSE 0 END)"
    size = "list_max(list_transform(regexp_extract_all(title, '(?i)(\\d+\\s*(?:gb|tb))', 1), lambda h: CAST(regexp_extract(h, '^\\d+') AS INT) * CASE WHEN lower(h) LIKE '%tb' THEN 1024 ELSE 1 END))"
    feature = lambda x, name, p: f"{numbers(without_noise(x))} AS {p}n, {listed(x, X.TIERS)} AS {p}t, {SERIES.format(x=x)} AS {p}s, {CHIP.format(x=name)} AS {p}c"
    return f"""WITH p AS (SELECT l_partkey || '-' || l_suppkey || '-' || l_orderkey AS query_id, l_linenumber - 1 AS place, {title} AS title, 'S' || l_partkey AS query, l_suppkey % 2 = 0 AS code_query,
  {target} AS model, CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 512 END AS target_capacity, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
 ok AS (SELECT *, {clean('title')} AS n, {clean('model')} AS t, {size} AS cap FROM p WHERE price > 0 AND NOT {_ACCESSORY} AND NOT regexp_matches(lower(title), '{'|'.join(X.NON_NEW)}')
  AND (NOT code_query OR contains(lower(title), 'samsung'))),
 v AS (SELECT * FROM ok WHERE NOT {_differ('nullif(cap, 0)', 'nullif(target_capacity, 0)')} AND {_family('n', 't')} AND NOT {_variant('n', 't')}),
 f AS MATERIALIZED (SELECT *, {feature('n', 'title', 'n')}, {feature('t', 'model', 't').replace(' AS ts,', ' AS tser,')}, {words('n')} AS a, {words('t')} AS b FROM v){token_set('f', 'a', 'b')},
 s AS (SELECT query_id, place, title, CASE WHEN code_query AND query <> '' AND contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(query), '[^a-z0-9]', '', 'g')) THEN 100::DOUBLE ELSE {score} END AS score FROM rated)
 SELECT query_id, place, title, {_R6.format(x='score')} AS score FROM s WHERE score >= {M.CATALOGUE_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, place) = 1"""


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _n(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, '{pattern}', 1)"


def _runs(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({x}, '([a-z])(\\d)', '\\1 \\2', 'g'), '(\\d)([a-z])', '\\1 \\2', 'g'), '[^a-z0-9+]+'), lambda t: t <> '')"


def _mark_list(tokens: str, raw: str) -> str:
    return f"list_concat(list_filter(['ultra', 'plus', 'fe', 'flip', 'fold', 'edge', 'lite'], lambda m: list_contains({tokens}, m)), CASE WHEN {_re(raw, '[^a-z0-9][saz][0-9]{1,3}[+]')} THEN ['plus'] ELSE [] END)"


def _fits(wanted: str, found: str, foreign: str) -> str:
    return f"CASE WHEN len({wanted}) > 0 THEN len(list_filter({wanted}, lambda m: NOT list_contains({found}, m))) = 0 ELSE len({foreign}) = 0 END"


def accepted(levels) -> str:
    """Every retailer's decision written out on its own."""
    source = "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
    for level in levels:
        source = f"(SELECT *, {', '.join(f'{sql} AS {c}' for c, sql in level.items())} FROM {source})"
    accessory = _has("mix", *X.ACCESSORY_HINTS)
    products, samsung = _has("mix", "apple", "iphone", "ipad", "macbook", "imac", "mac mini", "mac studio"), _has("mix", "samsung", "galaxy")
    brand = f"CASE WHEN apple THEN {products} ELSE {samsung} END"
    no = lambda words, missing: f"list_filter({words}, lambda w: w NOT IN ({', '.join(repr(m) for m in ('', '5g', 'gb', *missing))}))"
    connect = ("wifi", "cell", "cellular", "wificell", "wi", "fi")
    strong = lambda words: f"len(list_filter({words}, lambda w: (length(w) >= 4 OR {_re('w', '[0-9]')}) AND NOT contains(mix, w))) = 0"
    own = f"CASE WHEN apple THEN {_runs('family')} ELSE {_runs('plain')} END"
    apple_words = lambda c: f"list_filter(['pro', 'max', 'plus', 'mini', 'air'], lambda k: regexp_matches({c}, '\\b' || k || '\\b'))"
    apple_marks = f"(NOT apple OR (number = '' OR regexp_matches(mix, '\\biphone\\s*' || number || '\\b')) AND {_fits('aw', 'af', 'af')})"
    marks = f"(apple OR {_fits('wm', 'fm', 'fm')})"
    grover_words = "list_filter(regexp_split_to_array(CASE WHEN apple THEN family ELSE plain END, '[^a-z0-9]+'), lambda w: w NOT IN ('', '5g', 'gb') AND NOT (apple AND (w IN ('wifi', 'cell', 'cellular', 'wificell', 'wi', 'fi') OR regexp_matches(w, '^m\\d+$'))))"
    grover_found = "list_concat(list_filter(['ultra', 'plus', 'fe', 'flip', 'fold'], lambda m: contains(mix, m)), CASE WHEN regexp_matches(raw, '[^a-z0-9][saz][0-9]{1,3}[+]') THEN ['plus'] ELSE [] END)"
    grover_wanted = "list_filter(['ultra', 'plus', 'fe', 'flip', 'fold'], lambda m: list_contains(gw, m))"
    code = "(coalesce(code, '') <> '' AND contains(compact, code) OR length(root) >= 6 AND contains(compact, root))"
    movistar_url = f"CASE device WHEN 'mobile' THEN {_has('u', '/moviles/')} WHEN 'tablet' THEN {_has('u', '/tablet')} ELSE {_has('u', '/portatil', '/ordenador', '/laptop')} END"
    sizes = "list_concat(list_transform(regexp_extract_all(mix, '\\b(64|128|256|512|1024|2048)\\s*gb\\b', 1), lambda v: CAST(v AS INT)), list_transform(regexp_extract_all(mix, '\\b(1|2|4)\\s*tb\\b', 1), lambda v: CAST(v AS INT) * 1024))"
    gb = "list_transform(regexp_extract_all(mix, '\\b(64|128|256|512|1024)\\s*gb\\b', 1), lambda v: CAST(v AS INT))"
    sized = lambda found: f"(capacity_gb IS NULL OR len({found}) = 0 OR list_contains({found}, capacity_gb))"
    together = lambda c: (f"len(list_filter(regexp_extract_all(m, '\\bs\\s*(\\d{{2,3}})\\b', 1), lambda n: NOT contains({c}, 's' || n))) = 0 AND len(list_filter(regexp_extract_all(m, '\\ba\\s*(\\d{{2,3}})\\b', 1), lambda n: NOT contains({c}, 'a' || n))) = 0"  # noqa: E731
                          f" AND ({_n('m', 'flip *(\\d{1,2})')} = '' OR contains({c}, 'flip' || {_n('m', 'flip *(\\d{1,2})')}))")
    movistar = f"{movistar_url} AND NOT {_has('u', 'pack-ahorro', 'watch', 'smart-tv', 'reacondicionado')} AND {brand} AND device_ok AND {strong(no('ow', ()))} AND {marks} AND {apple_marks}"
    media_found = "CASE WHEN device = 'laptop' AND contains(mix, 'core ultra') THEN list_filter(fm, lambda x: x <> 'ultra') ELSE fm END"
    wifi, cell = "regexp_matches({c}, '\\bwi[\\s-]?fi\\b')", "regexp_matches({c}, '5g|lte|cell')"
    letter, digits, size = _n("plain", "\\b([sa])\\s*\\d{1,3}\\b"), _n("plain", "\\b[sa]\\s*(\\d{1,3})\\b"), _n("plain", "\\b(1[4-7])\\b")
    flip = _n("plain", "\\bflip\\s*(\\d{1,2})\\b")
    media = (f"contains(u, '/product/') AND contains(u, 'mediamarkt') AND {brand} AND NOT {_has('mix', 'reacondicionado', 'reacondic', 'seminuevo', 'renovado', 'usado', 'segunda mano')}"
             f" AND NOT CASE WHEN device = 'laptop' THEN {_has('mix', *[w for w in X.ACCESSORY_HINTS if w not in ('teclado', 'keyboard')])} ELSE {accessory} END AND device_ok"
             f" AND CASE WHEN apple THEN {strong(no('ow', ()))} ELSE {strong(no('ow', ('wifi', 'wi', 'fi', 'lte', 'cell', 'cellular')))} END AND {apple_marks}"
             f" AND (apple OR (device <> 'laptop' OR {size} = '' OR regexp_matches(mix, '(^|[^0-9])' || {size} || '([^0-9]|$)'))"
             f" AND (device <> 'tablet' OR NOT ({wifi.format(c='m')} AND {cell.format(c='mix')}) AND NOT ({cell.format(c='m')} AND {wifi.format(c='mix')} AND NOT {cell.format(c='mix')}))"
             f" AND (device <> 'mobile' OR NOT ({_re('m', '\\b5g\\b')} AND {_re('mix', '\\blte\\b')} AND NOT {_re('mix', '\\b5g\\b')}))"
             f" AND ({letter} = '' OR regexp_matches(mix, '\\b' || {letter} || '\\s*' || {digits} || '\\b')) AND ({flip} = '' OR regexp_matches(mix, '\\bflip\\s*' || {flip} || '\\b')) AND {_fits('wm', media_found, media_found)})")
    apple_path = ("CASE device WHEN 'mobile' THEN CASE WHEN number = '' THEN contains(path, '/shop/buy-iphone/') WHEN regexp_matches(m, 'pro max|\\biphone\\s*\\d{1,2}\\s*pro\\b') THEN contains(path, 'iphone-' || number || '-pro')"
                  " ELSE contains(path, 'iphone-' || number) AND NOT contains(path, 'iphone-' || number || '-pro') AND NOT contains(path, 'iphone-air') END"
                  " WHEN 'tablet' THEN CASE WHEN contains(m, 'ipad pro') THEN contains(path, 'ipad-pro') WHEN contains(m, 'ipad air') THEN contains(path, 'ipad-air') WHEN contains(m, 'ipad mini') THEN contains(path, 'ipad-mini') ELSE contains(path, '/shop/buy-ipad/') END"
                  " ELSE CASE WHEN contains(m, 'macbook air') THEN contains(path, 'macbook-air') WHEN contains(m, 'macbook pro') THEN contains(path, 'macbook-pro') ELSE contains(path, '/shop/buy-mac/') END END")
    points_words = no("regexp_split_to_array(regexp_replace(m, '\\b(samsung|galaxy|apple)\\b', ' ', 'g'), '[^a-z0-9]+')", ())
    points = (f"(CASE WHEN apple THEN contains(mix, 'apple')::INT + {_has('mix', 'iphone', 'ipad', 'macbook')}::INT ELSE contains(mix, 'samsung')::INT + contains(mix, 'galaxy')::INT END"
              f" + 2 * len(list_filter({points_words}, lambda w: contains(mix, w))) + CASE WHEN capacity_gb IS NULL THEN 0 ELSE CASE WHEN contains(mix, CAST(capacity_gb AS VARCHAR)) THEN 3 ELSE 0 END"
              f" + CASE WHEN len(sizes) = 0 THEN 0 WHEN list_contains(sizes, capacity_gb) THEN 2 ELSE -3 END END)")
    strict = lambda a, b: f"len(list_filter({a}, lambda x: x IN ('ultra', 'plus', 'fe', 'flip', 'fold', 'lite') AND NOT list_contains({b}, x))) = 0"
    detail_family = _n("m", "\\b([saz]\\d{1,3})\\b")
    rules = {
        "Amazon": f"regexp_matches(u, '//[^/?#]*amazon[.].*/dp/[a-z0-9]{{10}}') AND {brand} AND (NOT apple OR contains(title_n, 'apple')) AND NOT {_has('mix', *X.SECOND_HAND)} AND NOT {accessory} AND device_ok"
                  f" AND (CASE WHEN apple THEN {strong(no('bw', connect))} ELSE {strong(no('bw', ()))} END OR device = 'laptop' AND {code}) AND (apple OR {together('compact')})"
                  f" AND (apple OR device = 'laptop' OR {_fits('wm', 'fm', 'list_filter(fm, lambda x: x NOT IN (' + repr('flip') + ', ' + repr('fold') + '))')}) AND {apple_marks} AND {sized('sizes')}",
        "Grover": f"contains(u, 'grover.com') AND contains(u, '/products/') AND {brand} AND NOT {accessory} AND device_ok"
                  f" AND len(list_filter(gw, lambda w: (length(w) >= 4 OR regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^[0-9]+$')) AND NOT contains(mix, w))) = 0"
                  f" AND (apple OR {_fits(grover_wanted, grover_found, grover_found)}) AND {apple_marks} AND {sized(gb)}",
        "Movistar": movistar,
        "Movistar detail": f"CASE WHEN apple THEN {movistar} ELSE {movistar_url} AND {_has('detail', 'samsung', 'galaxy')} AND device_ok AND {detail_family} <> '' AND contains(detail, {detail_family}) AND {_fits('wm', 'dm', 'dm')} END",
        "Media Markt": media,
        "Rentik": f"contains(u, 'rentik.com') AND CASE WHEN apple THEN {_has('u', '/ofertas-alquilar/iphone/', '/ofertas-alquilar/apple/')} ELSE contains(u, '/ofertas-alquilar/samsung/') END AND NOT regexp_matches(u, '/(apple|samsung)/*$')"
                  f" AND NOT {_has('u', 'watch', 'reacondicionados', 'gaming')} AND {brand} AND NOT {accessory} AND device_ok AND CASE WHEN apple THEN {strong(no('ow', connect))} ELSE {strong(no('ow', ()))} END AND {marks} AND {apple_marks}",
        "Fnac": f"contains(u, 'fnac.es') AND regexp_matches(u, '/a\\d+') AND NOT {_has('u', 'watch', 'tablet', 'tab-', 'smart-tv', 'reacondicionado', 'fundas', 'carcasa', 'protector')} AND {samsung} AND {strong(no('pw', ()))} AND {_fits('wm', 'fm', 'fm')}",
        "PcComponentes": f"contains(u, 'pccomponentes.com') AND path NOT IN ('', '/') AND NOT {_has('path', '/search', '/buscar', '/smartphone-moviles', '/tablets')} AND NOT regexp_matches(ltrim(path, '/'), '/.') AND {samsung}"
                         f" AND NOT {_has('mix', 'reacondicionado', 'funda', 'carcasa', 'protector', 'cargador', 'auriculares')} AND {strong(no('pw', ()))}",
        "Apple Oficial": f"apple AND NOT {accessory} AND {brand} AND device_ok AND {apple_path}",
        "Samsung Oficial": f"contains(u, 'samsung.com/es') AND contains(u, '/buy/') AND CASE device WHEN 'tablet' THEN contains(u, '/tablets/') WHEN 'laptop' THEN {_has('u', '/computers/', '/laptops/', '/galaxy-book/')} ELSE contains(u, '/smartphones/') END"
                           f" AND device_ok AND {points} >= 2 AND {strict('wm', 'fm')} AND {strict('um', 'wm')} AND CASE WHEN contains(m, '5g') THEN contains(mix, '5g') ELSE NOT contains(u, '5g') END AND {together('blankless')}",
    }
    laptop = _has("mix", *X.LAPTOP_HINTS) + " OR " + samsung + " AND " + _re("mix", "\\bbook\\s*\\d?\\b")
    tablet = _has("mix", "ipad", "tablet") + " OR " + _re("mix", "\\btab(let|lets)?\\b")
    book, books = _n("m", "\\bbook\\s*(\\d{1,2})\\b"), "regexp_extract_all(mix, '\\bbook\\s*(\\d{1,2})\\b', 1)"
    missing = lambda words: f"len(list_filter({words}, lambda x: list_contains(mr, x) AND NOT list_contains(xr, x))) = 0"
    laptop_ok = (f"({code} OR CASE WHEN apple THEN {missing(['pro', 'air', 'mini', 'max', 'studio'])} AND (NOT contains(m, 'macbook') OR contains(mix, 'macbook'))"
                 f" ELSE ({book} = '' OR contains(compact, 'book' || {book}) AND (len({books}) = 0 OR list_contains({books}, {book}))) AND {missing(['pro', 'ultra', '360'])} END)")
    device_ok = (f"coalesce(CASE WHEN {accessory} THEN NULL WHEN is_laptop THEN 'laptop' WHEN is_tablet THEN 'tablet' WHEN {_has('mix', *X.MOBILE_HINTS, *X.BRAND_HINTS)} THEN 'mobile' END = device, true)"
                 f" AND CASE device WHEN 'laptop' THEN is_laptop AND {laptop_ok} WHEN 'tablet' THEN is_tablet AND NOT is_laptop ELSE (NOT apple OR {_has('mix', 'iphone', 'apple')}) AND NOT is_tablet AND NOT is_laptop END")
    columns = "retailer, brand, model, capacity_gb, device_type, product_code, text, href, title, body"
    arms = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in rules.items())
    return f"""WITH c AS (SELECT DISTINCT {columns} FROM {source}),
 a AS (SELECT *, brand = 'Apple' AS apple, device_type AS device, lower(model) AS m, lower(href) AS u, lower(coalesce(product_code, '')) AS raw_code, lower(coalesce(nullif(title, ''), text)) AS title_n,
  lower(text || CASE WHEN retailer = 'Movistar detail' AND brand = 'Apple' THEN ' ' || body ELSE '' END || ' ' || href) AS mix, lower(text || ' ' || href || ' ' || body) AS detail FROM c),
 b AS (SELECT *, mix AS raw, regexp_replace(mix, '[^a-z0-9]', '', 'g') AS compact, replace(mix, ' ', '') AS blankless, regexp_replace(raw_code, '[^a-z0-9]', '', 'g') AS code,
  regexp_replace(regexp_extract(raw_code, '^[^-_/]*'), '[^a-z0-9]', '', 'g') AS root, regexp_replace(m, '\\b(apple|iphone|ipad|macbook|imac|mac)\\b', ' ', 'g') AS family, regexp_replace(m, '\\b(samsung|galaxy)\\b', ' ', 'g') AS plain,
  regexp_replace(m, '\\b(samsung|galaxy|apple)\\b', ' ', 'g') AS bare, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, {_runs('m')} AS mr, {_runs('mix')} AS xr, {_runs('u')} AS ur, {_runs('detail')} AS dr,
  {laptop} AS is_laptop, {tablet} AS is_tablet, {_n('m', '\\biphone\\s*(\\d{1,2})\\b')} AS number FROM a),
 d AS (SELECT *, {own} AS ow, {_runs('plain')} AS pw, {_runs('bare')} AS bw, {grover_words} AS gw, {_mark_list('mr', 'm')} AS wm, {_mark_list('xr', 'mix')} AS fm, {_mark_list('ur', 'u')} AS um, {_mark_list('dr', 'detail')} AS dm,
  {apple_words('m')} AS aw, {apple_words('mix')} AS af, {sizes} AS sizes FROM b),
 e AS (SELECT *, {device_ok} AS device_ok FROM d)
 SELECT {columns}, CASE retailer {arms} ELSE false END AS accepted FROM e"""


def page_targets(url: str, model: str) -> str:
    """Every page against every target, rule by rule."""
    digits = lambda x: f"array_to_string(list_sort(list_distinct(regexp_extract_all({x}, '\\d+'))), ' ')"
    return f"""WITH p AS (SELECT page_id, contains(url, '/buy-ipad/') AS ipad, {digits('slug')} AS num, {listed('slug', X.TIERS)} AS tiers FROM (
  SELECT p_partkey AS page_id, {url} AS url, replace(regexp_extract({url}, '[^/]*$'), '-', ' ') AS slug FROM part)),
 t AS (SELECT target_id, contains(n, 'ipad') AS t_ipad, {digits('n')} AS t_num, {listed('n', X.TIERS)} AS t_tiers FROM (SELECT p_partkey AS target_id, {clean(model)} AS n FROM part)),
 exact AS (SELECT page_id, target_id, 'exact' AS rule FROM p JOIN t ON num = t_num AND tiers = t_tiers AND (NOT ipad OR t_ipad)),
 loose AS (SELECT page_id, target_id, 'fallback' AS rule FROM p JOIN t ON (NOT ipad OR t_ipad) AND (tiers = '' OR len(list_filter(string_split(tiers, ' '), lambda w: NOT list_contains(string_split(t_tiers, ' '), w))) = 0)
  WHERE page_id NOT IN (SELECT page_id FROM exact))
 SELECT page_id, rule, count(*) AS n, min(target_id) AS least, max(target_id) AS greatest, CAST(sum(target_id) AS BIGINT) AS total FROM (SELECT * FROM exact UNION ALL SELECT * FROM loose) GROUP BY ALL"""
