"""Operators on documents, conversations and vectors against plain methods."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import oracle
import pytest

from offerscope.llm import bagminhash, chat, queries, repeats, ring, spotsigs, toxicity, va_file

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "a b"), (5, "a  b"), (6, "long word " * 20_000), (6, "x"), (6, "x")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, sf, con):
    assert oracle.compare(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name]) is None


# chat

def test_render_is_reversible_and_free_of_control_strings():
    rnd = random.Random(1)
    for _ in range(5000):
        role, text = ("".join(rnd.choice(["\\", "#", "### ", "</turn>", "<", "/turn>", ":", ": ", "a", "\n"]) for _ in range(rnd.randint(0, 7))) for _ in "ab")
        formatted, start, end = chat.render(role, text)
        assert chat.read_back(formatted) == (role, text)
        assert chat.unescape(formatted[start:end]) == text
        assert "</turn>" not in formatted[:-len(chat.CLOSE)] and "##" not in formatted[3:]


def test_events_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "he"), (1, 2, 2, "delta", None, "llo"),
        (1, 3, 3, "message", "user", "old"), (1, 2, 4, "regenerate", None, "bet"), (1, 2, 5, "delta", None, "ter"),
        (1, 3, 6, "message", "user", "new"), (1, 1, 7, "edit", None, "hey"), (1, 4, 8, "delta", None, "nothing is open"),
        (2, 1, 0, "message", "user", "gone"), (2, 1, 1, "retract", None, None), (2, 2, 2, "edit", None, "not open"),
        (None, 1, 0, "message", None, None)]
    random.Random(2).shuffle(log)
    turns = chat.format_events(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    got = sorted((str(r.conv_id), r.turn, *chat.read_back(r.formatted)) for r in turns)
    assert got == [("1", 1, "user", "hey"), ("1", 2, "assistant", "better"), ("1", 3, "user", "new"), ("None", 1, "", "")]


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "### x: </turn>\\ é😀" * 400), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
            (1, None, "system", "s"), (2, 0, None, ""), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], df.schema)
    got = chat.digests(chat.format_events(chat.messages_as_events(df.union(extra))))
    assert oracle.compare(got, con, chat.ORACLE["op3_chat_format"]) is None
    assert chat.digests(chat.format_events(chat.messages_as_events(df.limit(0)))).count() == 0


# vectors

def test_top_k(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.1, -0.2, 0.37, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 340)] + [(0, [0.5] * 6), (400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (500, [9.0, 9.0])]
    vectors = va_file.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    usable = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for q, v in usable:
        if q % 100 == 0:
            scored = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:10], 1))
    assert collections.Counter(tuple(r) for r in va_file.top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()) == want
    assert va_file.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_query_groups(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    vectors = va_file.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = sorted(map(tuple, va_file.top_k(vectors, vectors, 3).collect()))
    monkeypatch.setattr(va_file, "QUERY_ROWS", 40)
    assert sorted(map(tuple, va_file.top_k(vectors, vectors, 3).collect())) == whole


# sharding

def ring_by_hand(rows, shards):
    """Rows one by one: home shards first, then the overflow one node further at a time."""
    arc_of, owners = ring.arcs(shards)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    afloat, at, step = list(range(len(rows))), {}, 0
    while afloat:
        still = []
        for i in afloat:
            shard = owners[(rows[i] + step) % len(owners)]
            if room[shard]:
                room[shard] -= 1
                at[i] = shard
            else:
                still.append(i)
        afloat, step = still, step + 1
    return collections.Counter((rows[i], s) for i, s in at.items())


@pytest.mark.parametrize("copies", [0, 400])
def test_ring(spark, copies):
    rows = ODD + [(i, f"text {i}") for i in range(10, 500)] + [(i, "hot") for i in range(copies)]
    got = ring.shard_rows(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    arcs = spark.createDataFrame(rows, SCHEMA).selectExpr("pmod(xxhash64(cast(coalesce(text, '') as binary)), %d) as c" % ring.CELLS).collect()
    arc_of, _ = ring.arcs(7)
    by_arc = ring_by_hand(sorted(arc_of[r.c] for r in arcs), 7)
    want = collections.Counter()
    for (_, shard), n in by_arc.items():
        want[shard] += n
    assert want == collections.Counter(r.shard for r in got)
    homes = sum(r.shard == r.home_shard for r in got)
    _, owners = ring.arcs(7)
    assert homes == sum(n for (arc, shard), n in by_arc.items() if shard == owners[arc])
    assert ring.shard_rows(spark.createDataFrame([], SCHEMA), 7).count() == 0


@pytest.mark.parametrize("copies", [0, 1200])
def test_cuts_of_an_arc_split_one_text_each(spark, copies):
    rows = [(i, f"text {i // 2}") for i in range(6000)] + [(i, "hot") for i in range(copies)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = ring.shard_rows(docs, 7).collect()
    assert len(got) == len(rows)
    arc_of, _ = ring.arcs(7)
    cells = docs.distinct().selectExpr("crc32(cast(text as binary)) as crc", "pmod(xxhash64(cast(text as binary)), %d) as c" % ring.CELLS).collect()
    arc = {r.crc: arc_of[r.c] for r in cells}
    by_text, by_arc = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
        by_arc[arc[r.text_crc32]].add(r.shard)
    cuts = sum(len(v) - 1 for v in by_arc.values())
    split = sum(len(v) > 1 for v in by_text.values())
    assert 0 < cuts and split <= cuts


# fingerprints

def test_edited_texts(spark, sf):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for rows in (ODD, documents, [(5, "only one")], [(10**12, "the a b"), (-3, "é" * 9)]):
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = collections.Counter()
        for i, (key, text) in enumerate(order):
            text, following = text or "", order[(i + 1) % len(order)][1] or ""
            half = len(text) // 2
            want[key, len(text), hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()] += 1
        got = spotsigs.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        for r in got:
            assert r.near_edited == spotsigs.pruned_jaccard(spotsigs.decode(r.fingerprint), spotsigs.decode(r.edited_fingerprint))
    assert spotsigs.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [[(i, f"{i} text") for i in range(3000)] + [(10**12, "far")], [(7 if i % 3 else i, f"{i} text") for i in range(3000)] + [(None, "x")]])
def test_ranges_are_even(spark, rows):
    got = spotsigs.with_next(spark.createDataFrame(rows, SCHEMA), 8).collect()
    own, halo = collections.Counter(r["_range"] for r in got if not r["_halo"]), collections.Counter(r["_range"] for r in got if r["_halo"])
    assert sum(own.values()) == len(rows) and len(own) == 8 and max(own.values()) < len(rows) / 4
    assert halo == dict.fromkeys(own, 1)


def test_spots_and_pruning():
    spots = spotsigs.Spots()
    text = "the red fox is in a deep wood and the old owl was at home " * 12
    anchored = spots.of(text)
    assert (spots.of("The, RED fox! is in a deep wood and the old owl was at home. " * 12)[0] == anchored[0]).all()
    rnd = random.Random(5)
    for _ in range(300):
        a, b = (np.unique(np.array([rnd.randint(0, 40) for _ in range(rnd.randint(1, 60))], np.uint32), return_counts=True) for _ in "ab")
        x, y = (collections.Counter(dict(zip(s[0].tolist(), s[1].tolist()))) for s in (a, b))
        exact = sum((x & y).values()) / sum((x | y).values())
        assert spotsigs.pruned_jaccard(a, b) == exact
        for threshold in (0.3, 0.8):
            assert spotsigs.pruned_jaccard(a, b, threshold) == (exact if exact >= threshold else 0) or exact < threshold
            if exact >= threshold:
                parts = [spotsigs.size_partition(int(s[1].sum()), threshold) for s in (a, b)]
                assert abs(parts[0] - parts[1]) <= 1


def test_one_changed_word_changes_its_own_chains_only():
    spots, rnd, anchors = spotsigs.Spots(), random.Random(9), sorted(spotsigs.ANCHORS)
    for n_anchors in (*range(13), 40, 150):
        for length in (40, 300):
            words = [f"w{rnd.randint(0, 10**6)}" for _ in range(length)]
            for at in rnd.sample(range(length - 1), min(n_anchors, length // 2)):
                words[at] = rnd.choice(anchors)
            own = spots.of(" ".join(words))
            before = collections.Counter(dict(zip(*map(np.ndarray.tolist, own))))
            assert sum(before.values()) >= length // 4
            for at in range(0, length, 7):
                for new in ([], ["other"], ["the"], [words[at], "more"]):
                    found = spots.of(" ".join(words[:at] + new + words[at + 1:]))
                    after = collections.Counter(dict(zip(*map(np.ndarray.tolist, found))))
                    assert len(before - after) <= 2 * spotsigs.CHAIN and len(after - before) <= 2 * spotsigs.CHAIN
                    if length == 300:
                        assert spotsigs.pruned_jaccard(own, found) > 0.8


# repeats

def repeats_by_hand(rows, window):
    count, split = collections.Counter(), [(d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = collections.Counter()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out[d, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [1, 5, 6, 35])
def test_repeats(spark, sf, window, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    rnd = random.Random(window)
    pool = [[rnd.choice("abcdefgh") for _ in range(90)] for _ in range(5)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            start = rnd.randint(0, 20)
            words += rnd.choice(pool)[start:start + rnd.randint(1, 2 * window)] + [rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 6))]
        rows.append((i % 50, rnd.choice([" ", "\n", "   ", "  "]).join(words)))
    rows += rows[:5] + ODD
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), window, keep_text=False).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_hand(rows, window)
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA), window).count() == 0


def test_repeats_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = repeats.op8_substring_dedup(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_hand(rows, 35)


# near duplicates

def classes_by_hand(rows):
    texts = sorted({t or "" for _, t in rows})

    def multiset(text):
        w = text.split()
        n = min(5, len(w))
        return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()

    bags, parent, where = [multiset(t) for t in texts], list(range(len(texts))), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, bag in enumerate(bags):
        for s in bag:
            where[s].append(i)
    for i, j in {(v[x], v[y]) for v in where.values() for x in range(len(v)) for y in range(x)}:
        if 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
            parent[find(i)] = find(j)
    groups, at = collections.defaultdict(list), {t: i for i, t in enumerate(texts)}
    for d, t in rows:
        groups[find(at[t or ""])].append(d)
    out = collections.Counter()
    for ids in groups.values():
        least = min((d for d in ids if d is not None), default=None)
        out.update((d, least, len(ids)) for d in ids)
    return out


def near_copies(rnd, n):
    words = "the of a be cee dee eff gee".split()
    base = [[rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(6, 120))] for _ in range(10)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
        yield i, rnd.choice([" ", "\n"]).join(w)


def test_classes(spark):
    rows = list(near_copies(random.Random(6), 300))
    rows += [(1000 + i, t) for i, t in ODD if i] + [(None, "a b")] + rows[:4]
    got = bagminhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes_by_hand(rows)
    assert bagminhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_of_links(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 5000), (4000, 5000)]
    random.Random(7).shuffle(links)
    got = {r._key: r._root for r in bagminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 5000: 1000, 4000: 1000}


def test_signatures_are_unbiased():
    for a, b in (({i: 1 for i in range(200)}, {i: 1 for i in range(40, 240)}), ({i: 1 + i % 7 for i in range(60)}, {i: 1 + i % 5 for i in range(60)})):
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        found = []
        for salt in range(40):
            made = []
            for bag in (a, b):
                elements = bagminhash.mix64(np.array(list(bag), dtype=np.uint64) + np.uint64(salt * 1_000_003))
                made.append(bagminhash.signature(elements, np.array(list(bag.values()))))
            found.append((made[0] == made[1]).mean())
        assert abs(np.mean(found) - exact) < 0.02


# toxicity

def test_every_sampled_row_gets_all_passes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_FEATURES", 500, raising=False)  # the former bound, reached by few rows
    rnd = random.Random(10)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["vile" if i % 3 == 0 else "kind", *"abcdefgh"]) for _ in range(60))) for i in range(150)] + [(150, "")], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(151)], "doc_id long, quality int, toxic int")
    rows = sorted(toxicity.training_sample(docs, labels).collect(), key=lambda r: r["_order"])
    model, features = toxicity.Ftrl(), toxicity.Features()
    for _ in range(toxicity.EPOCHS):
        for r in rows:
            model.learn(features.present(r["_text"]), r["_label"])
    at, weights = toxicity.collect_weights(toxicity.train(docs, labels))
    want = model.nonzero()
    assert at.tolist() == want[0].tolist() and np.allclose(weights, want[1])


def test_toxicity(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "Scum!", "rotten"]))
        docs.append((i, " ".join(words), i))
        labels.append((i, 0, int(toxic)))
    docs += [(900, None, 0), (None, "w1", 0), (901, "", 0), (5, docs[5][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    table = spark.createDataFrame(labels + [(0, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    weights = toxicity.collect_weights(toxicity.train(df, table))
    assert 0 < len(weights[0]) < 3000
    rows = toxicity.score(df, weights).withColumn("held_out", toxicity.held_out()).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    judged = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(judged) / len(judged) > 0.95
    none = toxicity.collect_weights(toxicity.train(df, table.limit(0)))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(df.limit(0), weights).count() == 0
