"""Packing token sequences into windows by minimum bin slack.

Every document is cut into full windows and one remainder. Remainders of a block of documents are
counted by length, and windows are filled one pattern at a time: the longest remaining length is fixed,
and a subset-sum over bitsets finds which multiset of the other remaining lengths comes closest to the
capacity. Back-tracking gives how often each length is used, and the pattern is repeated as long as
its lengths last, so the work depends on the number of distinct lengths only. A pattern that leaves more
than ``slack`` tokens free is not used: what then remains is laid end to end and cut at the windows, and
the last part is cut at powers of two, which need no padding. No id is lost or doubled.

A block is what one task has read, up to ``block_ids`` ids: packing is a map without shuffle, a lost task
is packed again the same way, and memory is bounded by a block. Sequence ids carry the number of the
partition, which is stable because the input is read in the same splits again.

Defined results: a null text counts as empty and still has its end id; repeated rows are packed each on
its own; no document yields no piece at all.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, batches_of, table, texts_of

WINDOW = 2048
BLOCK_IDS = 8_000_000


class Tokenizer:
    """Ids of a tokenizers file of byte-level BPE.

    The merges become ranks for tiktoken, which yields the same ids several times faster; tests hold them
    against the tokenizers library. The file's added tokens are found in the text before it is split, the
    leftmost and there the longest. ``encode_special_tokens`` is the library's setting of this name: they are
    then text like any other. The library's own default is False, which the queries use.
    """

    def __init__(self, definition: str, pattern: str, encode_special_tokens: bool = True):
        import json

        import tiktoken

        visible = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        file = json.loads(definition)
        model = file["model"]
        vocabulary = model["vocab"]
        singles = sorted((t for t in vocabulary if len(t) == 1), key=vocabulary.get)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks, ids = {}, []
        for token in singles + merged:
            spelt = bytes(byte_of[c] for c in token)
            if spelt not in ranks:
                ranks[spelt] = len(ids)
                ids.append(vocabulary[token])
        self.encoding = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, dtype="<u4")
        added = file.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in added):
            raise ValueError("added tokens other than special ones that are found as they are")
        self.added = {} if encode_special_tokens else {t["content"]: t["id"] for t in added}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode(self, text: str, end: int) -> np.ndarray:
        parts = self.splitter.split(text) if self.splitter else [text]  # text and added tokens in turn
        if len(parts) > 1:
            ordinary = [self.encode(part, end)[:-1] for part in parts[::2]]
            found = [np.array([self.added[part]], dtype="<u4") for part in parts[1::2]] + [np.array([end], dtype="<u4")]
            return np.concatenate([x for pair in zip(ordinary, found, strict=True) for x in pair])
        out = np.empty(len(ranked := self.encoding.encode_to_numpy(text, disallowed_special=())) + 1, dtype="<u4")
        np.take(self.ids, ranked, out=out[:-1])
        out[-1] = end
        return out


@lru_cache(maxsize=2)
def _tokenizer(definition: str, pattern: str, encode_special_tokens: bool) -> Tokenizer:
    return Tokenizer(definition, pattern, encode_special_tokens)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Which of the counted lengths fill ``room`` best: bitset subset-sum, counts by back-tracking."""
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:  # multiples by doubling: any count up to the limit is a sum of these
            taken = min(times, left)
            grown = reach | (reach << (length * taken)) & limit
            if grown != reach:
                steps.append((length, taken, reach))
                reach = grown
            left, times = left - taken, times * 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, taken, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + taken
            at -= length * taken
    return used


def patterns(counts: dict[int, int], window: int, slack: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(lengths with their count, repetitions) of the windows filled, and the counts left over."""
    counts = {k: v for k, v in counts.items() if v}
    out, left_over = [], {}
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = closest_fill({k: v for k, v in counts.items() if v and k <= window - longest}, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        if window - sum(k * n for k, n in used.items()) > slack:
            left_over[longest] = counts.pop(longest)
            continue
        times = min(counts[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out, left_over


def powers_of_two(tokens: int) -> list[int]:
    return [1 << bit for bit in range(tokens.bit_length() - 1, -1, -1) if tokens >> bit & 1]


def plan_block(sizes: list[int], window: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a block of documents."""
    out, sequence = [], 0
    rests: dict[int, list[tuple[int, int]]] = {}
    for document, size in enumerate(sizes):
        for start in range(0, size - window + 1, window):
            out.append((document, start, window, sequence, 0))
            sequence += 1
        if rest := size % window:
            rests.setdefault(rest, []).append((document, size - rest))
    filled, left_over = patterns({k: len(v) for k, v in rests.items()}, window, slack)
    for used, times in filled:
        for _ in range(times):
            offset = 0
            for length, count in used.items():
                for document, start in (rests[length].pop() for _ in range(count)):
                    out.append((document, start, length, sequence, offset))
                    offset += length
            sequence += 1
    rest = [(document, start, length) for length in left_over for document, start in rests[length]]
    total = sum(x[2] for x in rest)
    rooms = [window] * (total // window) + powers_of_two(total % window)
    room, offset = 0, 0
    for document, start, length in rest:
        while length:
            taken = min(length, rooms[room] - offset)
            out.append((document, start, taken, sequence, offset))
            start, length, offset = start + taken, length - taken, offset + taken
            if offset == rooms[room]:
                room, offset, sequence = room + 1, 0, sequence + 1
    return out


def pack(df: DataFrame, definition: str, pattern: str, end: int = 1, window: int = WINDOW, slack: int = 0, text: str = "text",
         keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, encode_special_tokens: bool = True) -> DataFrame:
    """One row per piece: ``keep`` columns, start, length, ids (unless left out), ids_crc32, doc_tokens, sequence_id, offset.

    ``slack`` is how many tokens of padding a window of whole remainders may have; the tokenizer file is
    broadcast, its size does not depend on the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(definition)
    narrow = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))

    def packed(batches: Batches):
        tokenizer = _tokenizer(shared.value, pattern, encode_special_tokens)
        base = TaskContext.get().partitionId() << 36
        rows: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []
        held = first = 0

        def flush():
            nonlocal rows, ids, held, first
            pieces = plan_block([len(x) for x in ids], window, slack)
            if pieces:
                kept = pa.Table.from_batches(rows).combine_chunks()
                document, start, length, sequence, offset = (list(x) for x in zip(*pieces, strict=True))
                cuts = [ids[d][s:s + n] for d, s, n in zip(document, start, length, strict=True)]
                taken = kept.take(pa.array(document, type=pa.int64()))
                out = {c: (taken.column(c).combine_chunks(), None) for c in keep}
                out |= {"start": (start, pa.int64()), "length": (length, pa.int64())}
                if with_ids:
                    out["ids"] = ([c.astype(np.int32) for c in cuts], pa.list_(pa.int32()))
                out |= {"ids_crc32": ([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()), "doc_tokens": ([len(ids[d]) for d in document], pa.int64()),
                        "sequence_id": ([base + first + x for x in sequence], pa.int64()), "offset": (offset, pa.int64())}
                whole = batches_of(out)
                for at in range(0, whole.num_rows, 10_000):
                    yield whole.slice(at, 10_000)
                first += max(sequence) + 1
            rows, ids, held = [], [], 0

        for batch in batches:
            columns, begun = batch.select(list(keep)), 0
            for at, value in enumerate(texts_of(batch, "_text")):
                ids.append(tokenizer.encode(value, end))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    rows.append(columns.slice(begun, at + 1 - begun))
                    begun = at + 1
                    yield from flush()
            if begun < batch.num_rows:
                rows.append(columns.slice(begun))
        yield from flush()

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(packed, f"{kinds}, start long, length long, {'ids array<int>, ' if with_ids else ''}ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, with_ids: bool) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return pack(docs, definition, public_tokenizers.PATTERN, with_ids=with_ids, encode_special_tokens=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op4_packing": op4_packing}
