"""Manifest, prefix trie and language identification against plain methods."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from offerscope.llm import langid, merkle, ordered, prefix_trie


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# positions

def test_positions_and_running_sums(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaaaab"), i, rnd.randint(-5, 9)) for i in range(3000)]
    rnd.shuffle(rows)
    numbered = ordered.number_rows(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), "g", ["k"], "test-rows")
    summed = ordered.running_sums(numbered, "g", "_pos", ["v"], block=64)
    want, total, count = [], collections.Counter(), collections.Counter()
    for g, k, v in sorted(rows):
        total[g] += v
        want.append((g, k, count[g], total[g]))
        count[g] += 1
    assert sorted((r.g, r.k, r._pos, r.v) for r in summed.collect()) == want
    assert all(r._n == count[r.g] for r in numbered.collect())


# manifest

def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_tree(digests):
    """Root, and per digest the (left, right) siblings of every level."""
    ways, under, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        runs = [range(a, min(a + 3, len(level))) for a in range(0, len(level), 3)]
        for run in runs:
            for j in run:
                for i in under[j]:
                    ways[i].append(([level[x] for x in run if x < j], [level[x] for x in run if x > j]))
        under = [[i for j in run for i in under[j]] for run in runs]
        level = [h(*(level[j] for j in run)) for run in runs]
    return level[0], ways


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0, plain_leaf(row, row[4])), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: x[0])
    trees = [plain_tree([key[2] for key, _ in groups[name]]) for name in names]
    root, tops = plain_tree([subroot for subroot, _ in trees])
    for name, (subroot, ways), top in zip(names, trees, tops, strict=True):
        for ((_, _, leaf), row), way in zip(groups[name], ways, strict=True):
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = plain_leaf(row, row[4].replace("\n", ""))
            for left, right in way + top:
                node = h(*left, node, *right)
            yield row[0], leaf, subroot, root, h(*(x for left, right in way + top for x in left + right)), node, node == root


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op13_merkle_manifest(df.sparkSession, str(tmp_path))


def test_manifest(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["hot", "hot", "é", "z", "", None]), rnd.choice(["en", None]), rnd.choice([3, None]), rnd.choice(["a\nb", "", None, "ü", "\n"])) for i in range(400)]
    rows += [(7, "hot", "en", 1, "same")] * 5 + [(None, "hot", None, None, None), (None, None, None, None, None), (9, "one", "en", 1, "long\n" * 300_000), (10, "two", "fr", 2, "a"), (11, "two", "fr", 2, "a")]
    rnd.shuffle(rows)
    got = manifest_of(spark.createDataFrame(rows, MANIFEST), tmp_path).collect()
    assert in_order(got) == in_order(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    rows = [(2, "s", None, None, "x")]
    assert in_order(manifest_of(spark.createDataFrame(rows, MANIFEST), tmp_path / "one").collect()) == in_order(plain_manifest(rows))
    assert manifest_of(spark.createDataFrame([], MANIFEST), tmp_path / "none").collect() == []


def test_manifest_with_clashing_columns(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, MANIFEST)
    more = df.selectExpr("*", "1 AS _pos", "2 AS _group", "3 AS leaf", "4 AS root", "5 AS _n", "6 AS _node", "7 AS _at")
    plain = in_order(merkle.manifest(df).collect())
    assert in_order(merkle.manifest(more).collect()) == plain and all(r[-1] for r in plain)


# prefix trie

def plain_trie(rows):
    """rows: conv_id, turn, role, text."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt, nodes, children, below = {}, collections.defaultdict(list), collections.defaultdict(list), {}
    for c in sorted(own):
        head = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = own.get(base, [])[:head] + own[c][head:]
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below[k] = (sum(below[x][0] for x in children[k]) or 1, sum(below[x][1] for x in children[k]) + (len(nodes[k]) - 1) * words)
        ends = ",".join(str(c) for c in nodes[k] if len(rebuilt[c]) == len(k))
        yield nodes[k][0], len(k), nodes[k[:-1]][0] if k else None, len(nodes[k]), len(children[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest(), words


TURNS = "conv_id long, turn long, role string, text string"


def odd_turns():
    rnd = random.Random(7)
    rows = [(rnd.randint(-45, 90), rnd.choice([None, *range(6)]), rnd.choice(["u", "a", None]), rnd.choice(["x", "x y", "", None, " z\x0b w "])) for _ in range(500)]
    rows += [(200, i, "u", "same") for i in range(250)]  # half as many turns as all others have
    rows += [(c, t, "u", f"common {t}") for c in range(300, 400) for t in range(2)] + [(None, 0, "u", "t"), (500, 0, "u", "long " * 200_000), (520, 0, "u", "long " * 200_000)]
    rnd.shuffle(rows)
    return rows


def test_prefix_trie(spark):
    rows = odd_turns()
    want = in_order(plain_trie(rows))
    assert in_order(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()) == want
    assert any(r[3] > 1 and r[7] != hashlib.sha256().hexdigest() for r in want)


def test_equal_fingerprints_of_different_turns_are_found(spark):
    """With a tiny modulus nearly all fingerprints collide; the check of stored turns must notice."""
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS)
    turns = prefix_trie.stored_turns(df)
    rebuilt = prefix_trie.rebuilt_rows(turns, 0, 5)
    nodes = rebuilt.groupBy(*prefix_trie._NODE).agg(prefix_trie.F.count("_at").alias("_refs"))
    assert not prefix_trie.verified(rebuilt, nodes, turns)
    assert in_order(prefix_trie.prefix_trie(df, modulus=5).collect()) == in_order(plain_trie(rows))


def test_prefix_trie_of_nothing_and_with_clashing_columns(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (21, 3, "u", "b")]
    df = spark.createDataFrame(rows, TURNS)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []
    more = df.selectExpr("*", "1 AS depth", "2 AS _at", "3 AS words", "4 AS _mark", "5 AS s0")
    assert in_order(prefix_trie.prefix_trie(more).collect()) == in_order(plain_trie(rows))


def test_fingerprints_compose():
    p, base = prefix_trie.P, prefix_trie.bases(0)[0]
    rnd = random.Random(8)
    xs = [rnd.randrange(1, p) for _ in range(40)]
    power = prefix_trie.powers(base, np.arange(40), p)
    assert [int(v) for v in power] == [pow(base, i, p) for i in range(40)]
    whole = sum(x * pow(base, i, p) for i, x in enumerate(xs)) % p
    head = sum(x * pow(base, i, p) for i, x in enumerate(xs[:13])) % p
    suffix = sum(x * pow(base, i, p) for i, x in enumerate(xs[13:])) % p
    assert (head + pow(base, 13, p) * suffix) % p == whole


# language

@pytest.mark.parametrize("classes, bits, apart", [(0, 0, 0), (1, 0, 0), (2, 1, 1), (4, 7, 4), (6, 31, 16)])
def test_codewords(classes, bits, apart):
    code = langid.codebook(classes)
    assert code.shape == (classes, bits) and langid.least_distance(code) == apart
    assert all(abs(column.sum()) < classes for column in code.T)


def test_many_codewords():
    code = langid.codebook(40)
    assert langid.least_distance(code) >= 12 and set(np.unique(code)) == {-1, 1}


def plain_runs(text):
    letters = re.sub(r"\0+", "\0", "\0" + "".join(c.lower() if c.isalpha() else "\0" for c in text) + "\0")
    return [letters[i - n + 1:i + 1] for n in (1, 2, 3) for i in range(max(n - 1, 1), len(letters))]


def test_grams(monkeypatch):
    texts = ["a", "Ab", "  hé ß12x", "日本 語", "no. LETTER..at the end!!", "x" * 50 + "\n" + "yz " * 30, "..", "", "1a"]
    runs = [plain_runs(t) for t in texts]
    whole = [np.concatenate([np.zeros(0, dtype=np.int32), *langid.grams(t)]) for t in texts]
    for text, run, got in zip(texts, runs, whole, strict=True):
        assert len(got) == (len(run) if any(c.isalpha() for c in text) else 0), text
    seen = {}
    for text, run, got in zip(texts, runs, whole, strict=True):
        if len(got):  # blocks come by length of run
            assert sorted(got) == sorted(seen.setdefault(r, g) for r, g in zip(run, got, strict=True)), text
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "BLOCK_CHARS", size)
        for text, got in zip(texts, whole, strict=True):
            assert sorted(np.concatenate([np.zeros(0, dtype=np.int32), *langid.grams(text)])) == sorted(got), (size, text)


def test_a_wrong_bit_is_corrected():
    model = langid.Model(["de", "en", "es", "fr"], {})
    for i, lang in enumerate(model.langs):
        for bit in range(model.code.shape[1]):
            margins = model.code[i] * 3.0
            margins[bit] *= -1
            assert model.decode(margins)[0] == lang
    assert model.decode(np.zeros(7))[2], "no evidence is ambiguous"


def test_weights_are_log_odds_of_counts(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abab", "x"), ("ba", "x"), ("cc", "y"), ("ca", "y")] * 20)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learnt = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts = {lang: collections.Counter(g for r in learnt if r.lang == lang for g in plain_runs(r.text)) for lang in "xy"}
    grams = set(counts["x"]) | set(counts["y"])
    share = {lang: {g: (counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * len(grams)) for g in grams} for lang in "xy"}
    want = sorted(float(np.log(share["x"][g] / share["y"][g])) for g in grams)
    assert np.allclose(sorted(model.weights[:-1, 0]), want, atol=1e-5) and len(model.seen) == len(grams)


def test_language_of_held_out_documents(spark):
    result = langid.op12_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = result.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_language_of_odd_rows(spark, tmp_path):
    words = {"aa": ["alpha", "gamma", "mama"], "bb": ["öß", "ükö", "töt"], "cc": ["xyz", "zyx", "wxw"]}
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(words[lang], k=8)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    odd = [(None, "alpha gamma", "aa"), (200, None, "aa"), (201, "", "bb"), (202, "12 !?", "cc"), (203, "日本語", None), (204, "ALPHA " * 400_000, None), (205, "öß ükö", None), (205, "öß ükö", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1 AS score")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op12_language_id(spark, str(tmp_path)).collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd) and [r.held_out for r in got if r.doc_id is None] == [None]
    assert [of[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and of[200].score == 0
    assert of[203].lang_pred in words and of[203].ambiguous and of[204].lang_pred == "aa" and of[205].lang_pred == "bb"
    assert all(of[i].lang_pred == lang for i, _, lang in rows)

    # languages of held-out rows are no input, whatever they say
    lied = df.withColumn("lang", prefix_trie.F.when(langid.held_out(), "zz").otherwise(prefix_trie.F.col("lang")))
    again = langid.predict(df, langid.fit(lied)).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in again) == sorted((str(r.doc_id), r.lang_pred, r.score) for r in got)


@pytest.mark.parametrize("langs", [[], ["aa"]])
def test_fewer_languages_than_bits_need(spark, langs):
    df = spark.createDataFrame([(i, "some text", lang) for i, lang in enumerate((langs or [None]) * 9)], "doc_id long, text string, lang string")
    got = {(r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()}
    assert got == ({("aa", 1.0)} if langs else {("und", 0.0)})
    assert langid.predict(df.limit(0), langid.fit(df.limit(0))).collect() == []
