"""Byte-level BPE, packing and token counts against the libraries and plain methods."""

import base64
import collections
import hashlib
import json
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from offerscope.llm import bpe, packing, wordpiece

PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "日本", "😀", "1", "23", "'s", "'", "ll", "!", "Ab", "the", "​", "aaaa", " x", "<|endoftext|>"]
ROWS = [(1, None), (2, ""), (3, "the " * 30_000), (4, "aaaa" * 5000), (5, "  é日本 \n\n 'll x's  "), (5, "same"), (5, "same"), (None, "<|endoftext|> \\ x")]
SCHEMA = "doc_id long, text string"


def made_up(rnd: random.Random) -> str:
    return "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))


@pytest.fixture(scope="module")
def multi():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        data = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return data, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(multi):
    data, ranks, library = multi
    encoder, rnd, tokens = bpe.Encoder(bpe.parse_ranks(data), public_tokenizers.PATTERN), random.Random(1), list(ranks)
    for i in range(6000):
        text = made_up(rnd) if i % 2 else b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6))).decode("utf-8", "ignore")
        assert encoder.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_transducer_forgets_states_and_stays_right(multi, monkeypatch):
    data, _, library = multi
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    encoder, rnd = bpe.Encoder(bpe.parse_ranks(data), public_tokenizers.PATTERN), random.Random(2)
    for _ in range(500):
        text = made_up(rnd)
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_utf8_machine_in_any_cuts():
    rnd = random.Random(3)
    for _ in range(3000):
        data = bytes(rnd.choice([rnd.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 65]) for _ in range(rnd.randint(0, 12)))
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            step = rnd.randint(1, 3)
            out += machine.feed(data[at:at + step])
            at += step
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_encode_decode_rows(spark, multi):
    data, _, library = multi
    got = bpe.encode_decode(spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("doc_id", "n_chars"), data, public_tokenizers.PATTERN, keep=("n_chars",)).collect()
    want = collections.Counter()
    for key, text in ROWS:
        ids = library.encode_ordinary(text or "")
        want[key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert collections.Counter((r.n_chars, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_decode(spark.createDataFrame([], SCHEMA), data, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        return file.read(), library


def test_ids_equal_library(byte_bpe):
    definition, library = byte_bpe
    own, rnd = packing.Tokenizer(definition, public_tokenizers.PATTERN), random.Random(4)
    for i in range(4000):
        text = made_up(rnd) if i % 2 else library.decode([rnd.randrange(50256) for _ in range(rnd.randint(1, 6))])
        assert own.encode(text, 1).tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text)


def test_added_tokens_equal_library_by_default(spark):
    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        own = packing.Tokenizer(file.read(), public_tokenizers.PATTERN, encode_special_tokens=False)
    made = ["".join(rnd.choice([*PIECES, "<|endoftext|>", "<|endoftext|>", "<|endof", "|>"]) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    for text in ["a<|endoftext|> b", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  b", *made]:
        assert own.encode(text, 1).tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text)
    assert own.encode("a<|endoftext|> b", 1).tolist() == [64, 50256, 275, 1]
    rows = packing.pack_documents(spark.createDataFrame([(1, "a<|endoftext|> b"), (2, None)], SCHEMA).coalesce(1), with_ids=True).collect()
    for key, ids in ((1, [64, 50256, 275, 1]), (2, [1])):
        assert [i for _, part in sorted((r.start, r.ids) for r in rows if r.doc_id == key) for i in part] == ids
        assert {r.doc_tokens for r in rows if r.doc_id == key} == {len(ids)}


def test_overlapping_added_tokens_equal_library(byte_bpe):
    definition = json.loads(byte_bpe[0])
    flags = dict(single_word=False, lstrip=False, rstrip=False, normalized=False, special=True)
    definition["added_tokens"] += [dict(id=50257 + i, content=c, **flags) for i, c in enumerate(["xyx", "xyxyx", "yx<|", "<|endof"])]
    for setting in (False, True):
        own = packing.Tokenizer(json.dumps(definition), public_tokenizers.PATTERN, setting)
        library = Tokenizer.from_str(json.dumps(definition))
        library.encode_special_tokens = setting
        rnd = random.Random(9)
        for _ in range(2000):
            text = "".join(rnd.choice(["x", "y", "xy", " ", "<|", "<|endof", "<|endoftext|>", "a"]) for _ in range(rnd.randint(0, 9)))
            assert own.encode(text, 1).tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text)
    definition["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        packing.Tokenizer(json.dumps(definition), public_tokenizers.PATTERN, False)


def test_closest_fill_is_optimal():
    rnd = random.Random(5)
    for _ in range(300):
        counts, room = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}, rnd.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        used = packing.closest_fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("window", [64, 2048])
def test_plan_loses_and_doubles_nothing(window):
    rnd = random.Random(6)
    for _ in range(100):
        sizes = [rnd.choice([rnd.randint(1, rnd.choice([3000, 40])), 70]) for _ in range(rnd.randint(0, 300))]
        by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for document, start, length, sequence, offset in packing.plan_block(sizes, window, 0):
            by_document[document].append((start, length))
            by_sequence[sequence].append((offset, length))
        for document, size in enumerate(sizes):
            at = 0
            for start, length in sorted(by_document[document]):
                assert start == at and length > 0
                at += length
            assert at == size
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == window or at & (at - 1) == 0


def test_packed_rows(spark, byte_bpe, monkeypatch):
    definition, library = byte_bpe
    monkeypatch.setattr(packing, "BLOCK_IDS", 3000)
    rows = packing.pack(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), definition, public_tokenizers.PATTERN).collect()
    ids = collections.Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in ROWS)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and r.length == len(r.ids)
    assert sum(r.length for r in rows) == sum(len(x) * n for x, n in ids.items())
    texts = {k: v for k, v in ROWS if k in (1, 2, 3, 4, None)}
    for key, text in texts.items():
        parts = sorted((r.start, r.ids) for r in rows if r.doc_id == key)
        assert tuple(i for _, part in parts for i in part) == tuple(library.encode(text or "", add_special_tokens=False).ids) + (1,)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))]
    assert packing.pack(spark.createDataFrame([], SCHEMA), definition, public_tokenizers.PATTERN).count() == 0


def greedy(word: str, first: set, inner: set) -> int | None:
    at, n = 0, 0
    while at < len(word) or n == 0:
        known = inner if n else first
        end = next((e for e in range(len(word), at - (n == 0), -1) if word[at:e] in known), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy():
    rnd = random.Random(7)
    for trial in range(60):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 14))}
        vocabulary = [("▁" if rnd.random() < 0.5 else "") + p for p in pieces] + (["▁"] if trial % 3 == 0 else [])
        first, inner = {p[1:] for p in vocabulary if p[0] == "▁"}, {p for p in vocabulary if p[0] != "▁"}
        automaton = wordpiece.LongestMatch(vocabulary)
        for _ in range(200):
            word = "".join(rnd.choice("abcd"[:3 + (trial % 5 == 0)]) for _ in range(rnd.randint(1, 9)))
            assert automaton.count(word) == greedy(word, first, inner), (word, vocabulary)


def test_token_counts(spark, sf):
    vocabulary = wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    first, inner = {p[1:] for p in vocabulary if p[0] == "▁"}, {p for p in vocabulary if p[0] != "▁"}

    def want(text):
        found = [greedy(w, first, inner) for w in (text or "").split()]
        return len(found), sum(1 if n is None else n for n in found), sum(n is None for n in found)

    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    for rows in (ROWS, documents):
        got = collections.Counter(tuple(r) for r in wordpiece.count_tokens(spark.createDataFrame(rows, SCHEMA), vocabulary).collect())
        assert got == collections.Counter((key, *want(text)) for key, text in rows)
    assert wordpiece.count_tokens(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0
