"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Encoding. The last token of every prefix of a piece of text is unique, and a token sequence is what
the merges produce exactly if each adjacent pair of tokens is. While bytes are read, several
tokenisations are therefore open at once: one for each earlier position from which the bytes since then
still spell the beginning of a token. A state of the transducer is that set of alternatives, each with
its place in the vocabulary trie, its last token and the tokens it has not yet agreed on with the
others. What all alternatives share is emitted at once, so the lookahead is bounded by what a token can
span. States and transitions are made when first needed and remembered.

Decoding. Tokens become bytes; an incremental UTF-8 machine holds back the bytes of a code point that
is not complete yet and replaces ill-formed sequences as Python's "replace" does.

Defined results: null is encoded as the empty text (no ids); texts of any length are encoded whole;
each row is encoded on its own.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, Memo, batches_of, split_chunks, table, texts_of

MAX_STATES = 150_000
MAX_PAIRS = 1_000_000
DECODE_IDS = 8192


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on every line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_NONE = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain rank-ordered merging of a few bytes; the transducer is built from it."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    joined = [ranks.get(piece[i:i + 2], _NONE) for i in range(len(piece) - 1)]
    while joined:
        least = min(joined)
        if least == _NONE:
            break
        at = joined.index(least)
        parts[at] += parts.pop(at + 1)
        del joined[at]
        if at:
            joined[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
        if at < len(joined):
            joined[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.grows = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                found = self.child.get(key)
                if found is None:
                    found = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(0)
                    self.grows[node] = 1
                node = found
            self.token[node] = rank
        self.follows = Memo(lambda pair: merge(self.spelling[pair >> 32] + self.spelling[pair & 0xFFFFFFFF], ranks) == [pair >> 32, pair & 0xFFFFFFFF], MAX_PAIRS)
        self.sets, self.set_numbers, self.set_moves = [(0,)], {(0,): 0}, {}
        self._forget()

    def _forget(self) -> None:
        start = (0, (-1,), ((),))
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def _set_move(self, key: int) -> tuple[int, list[int], list[tuple[int, int]]]:
        """From a set of open trie nodes by a byte: the set reached, which nodes lived on, and the tokens
        (longest first, with the node each came from) that end here."""
        kept, nodes, ends = [], [], []
        for at, node in enumerate(self.sets[key >> 8]):
            following = self.child.get(node << 8 | key & 255)
            if following is None:
                continue
            if self.grows[following]:
                kept.append(at)
                nodes.append(following)
            token = self.token[following]
            if token >= 0 and merge(self.spelling[token], self.ranks) == [token]:
                ends.append((at, token))
        reached = (*nodes, 0)
        number = self.set_numbers.get(reached)
        if number is None:
            number = self.set_numbers[reached] = len(self.sets)
            self.sets.append(reached)
        move = self.set_moves[key] = (number, kept, ends)
        return move

    def _move(self, key: int) -> tuple[int, tuple[int, ...]]:
        """Transition of the transducer: among the tokens that end here just one continues its alternative."""
        nodes, lasts, pending = self.states[key >> 8]
        set_key = nodes << 8 | key & 255
        nodes, kept, ends = self.set_moves.get(set_key) or self._set_move(set_key)
        follows = self.follows
        for at, token in ends:
            last = lasts[at]
            if last < 0 or follows[last << 32 | token]:
                break
        chosen = (*pending[at], token)
        if kept:
            open_ones = [pending[i] for i in kept]
            open_ones.append(chosen)
            low, out = min(open_ones), max(open_ones)
            shared, most = 0, len(low)
            while shared < most and low[shared] == out[shared]:
                shared += 1
            if shared:
                open_ones = [x[shared:] for x in open_ones]
                out = out[:shared]
            else:
                out = ()
            state = (nodes, (*[lasts[i] for i in kept], token), tuple(open_ones))
        else:
            state, out = (nodes, (token,), ((),)), chosen
        into = self.numbers.get(state)
        if into is None:
            into = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[key] = (into, out)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is itself a token stays whole, however it would merge."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._forget()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key) or self._move(key)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self.states[state][2][-1]
        return out


class Encoder:
    """Encodes texts; a pattern cuts them into pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces = Memo(lambda piece: array("I", self.transducer.encode(piece.encode("utf-8", "replace"))).tobytes())
        self.chunks = Memo(lambda chunk: self._encode(" " + chunk))

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        chunks = split_chunks(text)
        packed = self._encode(chunks[0]) + b"".join(map(self.chunks.__getitem__, chunks[1:]))
        return np.frombuffer(packed, dtype=np.uint32)


def _well_formed(lead: int) -> tuple[int, int, int]:
    """Continuation bytes after a lead byte and the range of the first of them; -1 if it cannot lead."""
    if lead < 0x80:
        return 0, 0, 0
    if 0xC2 <= lead <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return -1, 0, 0


_LEADS = [_well_formed(lead) for lead in range(256)]


class Utf8Machine:
    """Text from bytes that arrive in any cuts. State: the bytes of the open code point."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """Bytes at the end that begin a code point and may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            need, low, high = _LEADS[data[-back]]
            if data[-back] & 0xC0 == 0x80:
                continue
            return back if need >= back and (back == 1 or low <= data[-back + 1] <= high) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        tail = self._open_tail(data)
        self.open = data[len(data) - tail:]
        body = data[:len(data) - tail]
        try:
            return body.decode("utf-8")
        except UnicodeDecodeError:
            return self._step_through(body)

    @staticmethod
    def _step_through(data: bytes) -> str:
        """The machine byte by byte: an ill-formed beginning is one replacement, its breaker is read anew."""
        out: list[str] = []
        held, need, low, high = b"", 0, 0x80, 0xBF
        for value in data:
            if need:
                if low <= value <= high:
                    held, need, low, high = held + bytes([value]), need - 1, 0x80, 0xBF
                    if not need:
                        out.append(held.decode("utf-8"))
                    continue
                out.append("�")
            need, low, high = _LEADS[value]
            held = bytes([value])
            if need <= 0:
                out.append(chr(value) if need == 0 else "�")
                need = 0
        if need:
            out.append("�")
        return "".join(out)

    def finish(self) -> str:
        left, self.open = self.open, b""
        return "�" if left else ""


class Decoder:
    """Streaming decoder: ids in any cuts to text, with the bytes of every step at hand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.spelling = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelling[rank] = token
        self.machine = Utf8Machine()

    def feed(self, ids: list[int]) -> str:
        return self.machine.feed(b"".join(map(self.spelling.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.finish()


@lru_cache(maxsize=2)
def _worker_tools(data: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    ranks = parse_ranks(data)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_decode(df: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  with_ids: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, ids (unless left out), and the hash of the ids and of the decoded text.

    A map without shuffle. The rank file is broadcast; its size does not depend on the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(rank_file)
    narrow = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))

    def encoded(batches: Batches):
        encoder, decoder = _worker_tools(shared.value, pattern)
        decimals = list(map(str, range(len(decoder.spelling))))
        for batch in batches:
            counts, id_hashes, text_hashes, all_ids = [], [], [], []
            for value in texts_of(batch, "_text"):
                ids = encoder.encode(value).tolist()
                decoded = hashlib.sha256()
                for start in range(0, len(ids), DECODE_IDS):
                    decoded.update(decoder.feed(ids[start:start + DECODE_IDS]).encode())
                decoded.update(decoder.finish().encode())
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                text_hashes.append(decoded.hexdigest())
                if with_ids:
                    all_ids.append(ids)
            out = {c: (batch.column(c), None) for c in keep} | {"n_tokens": (counts, pa.int64())}
            if with_ids:
                out["ids"] = (all_ids, pa.list_(pa.int32()))
            yield batches_of(out | {"ids_sha256": (id_hashes, pa.string()), "decoded_sha256": (text_hashes, pa.string())})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(encoded, f"{kinds}, n_tokens long, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
