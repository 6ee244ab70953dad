"""Substring dedup by level-wise doubling.

A window of ``window`` words can only be repeated if its halves are. Level one looks at windows of half
the length, and of those only at the anchors: in each full window the half-length window with the least
hash. Equal full windows have the same anchor at the same place, so nothing is missed. Anchors that occur
once are dropped; the survivors alone are extended to twice the length, that is to the full windows
that have this anchor, and those that still occur elsewhere remove the words they cover.

Before each shuffle a task resolves what it has seen itself: of a hash that it met at several places one
row is sent and marked, so a passage shared by any number of documents costs a row per task. Occurrences
are (text, position): copies of a whole text do not make its windows repeated at level one, they are
recognised by their number instead.

Hashes have 64 bits, two independent ones must agree for a window. Texts are shuffled once and that
exchange is read twice.

Defined results: words are maximal runs of characters other than U+0020 and U+0009 to U+000D; a null text
has none; texts shorter than a window lose nothing; equal texts lose everything if they have a window;
rows with equal or null ids are documents of their own; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.common import Batches, Memo, batches_of, materialize, mix64, packed, table, unpacked

WINDOW = 35
BLOCK = 1_000_000
_BASES = {1: 0x9E3779B97F4A7C15, 2: 0xD1342543DE82EF95}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the level's base and of its inverse, modulo 2**64."""
    held = _POWERS.get(level)
    if held is None or len(held[0]) < n:
        size, base = max(n, 4096) * 2, _BASES[level]
        factors = [np.full(size, b % 2**64, dtype=np.uint64) for b in (base, pow(base, -1, 2**64))]
        for f in factors:
            f[0] = 1
        held = _POWERS[level] = (np.cumprod(factors[0]), np.cumprod(factors[1]))
    return held


def window_hashes(codes: np.ndarray, length: int, level: int) -> np.ndarray:
    """Hash of every run of ``length`` codes, by differences of polynomial prefix sums."""
    n = len(codes)
    up, down = _powers(level, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:n])])
    return mix64((sums[length:] - sums[:n - length + 1]) * down[:n - length + 1])


class Words:
    def __init__(self):
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))


def anchors(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor, and the first and last full window it stands for."""
    half = -(-window // 2)
    hashes = window_hashes(codes, half, 1)
    inside = window - half + 1
    at = np.arange(len(codes) - window + 1) + np.lib.stride_tricks.sliding_window_view(hashes, inside).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], hashes[at[first]], first, last


class Block:
    """Occurrences of hashes seen by a task."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray, key: int, places: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.keys.append(np.full(len(hashes), key, dtype=np.int64))
        self.places.append(places)
        self.size += len(hashes)

    def rows(self, with_known: bool):
        """One row per hash, marked if the task has met it more than once; if asked for, the further
        occurrences follow, each under a hash of its own."""
        if not self.size:
            return
        hashes, keys, places = (np.concatenate(x) for x in (self.hashes, self.keys, self.places))
        order = np.argsort(hashes, kind="stable")
        hashes, keys, places = hashes[order], keys[order], places[order].astype(np.int64)
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        several = np.diff(np.concatenate([np.flatnonzero(new), [len(hashes)]])) > 1
        part, owner, state = hashes[new], keys[new], places[new] * 4 + several
        if with_known and not new.all():
            rest, rest_places = keys[~new], places[~new]
            part = np.concatenate([part, mix64(rest.view(np.uint64) ^ mix64(rest_places.astype(np.uint64)))])
            owner, state = np.concatenate([owner, rest]), np.concatenate([state, rest_places * 4 + 2])
        self.__init__()
        for start in range(0, len(part), 20_000):
            cut = slice(start, start + 20_000)
            yield batches_of({"_part": (part[cut].view(np.int64), pa.int64()), "_key": (owner[cut], pa.int64()), "_state": (state[cut], pa.int64())})


_ROWS = "_part long, _key long, _state long"


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``_repeated``: whether their hash has another occurrence anywhere."""
    group = Window.partitionBy("_part")
    mark, occurrence = F.col("_state").bitwiseAND(3), F.xxhash64("_key", F.shiftright("_state", 2))
    repeated = (mark > 0) | (F.max(mark).over(group) == 1) | (F.min(occurrence).over(group) != F.max(occurrence).over(group))
    return rows.withColumn("_repeated", repeated)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def surviving_anchors(keyed: DataFrame, text: str, window: int) -> DataFrame:
    """Level one: _key and the positions of anchors that occur elsewhere, -1 for texts with copies."""

    def found(batches: Batches):
        words, block, seen = Words(), Block(), set()
        for batch in batches:
            for key, value in zip(batch.column("_key").to_pylist(), _texts(batch, text), strict=True):
                split = value.split()
                if len(split) < window or key in seen:
                    continue
                if len(seen) < BLOCK:  # only spares work: occurrences of copies are the same
                    seen.add(key)
                at, hashes, _, _ = anchors(words.codes(split), window)
                block.add(hashes, key, at)
                if block.size >= BLOCK:
                    yield from block.rows(True)
        yield from block.rows(True)

    rows = keyed.select("_key", text).mapInArrow(found, _ROWS)
    singles = _judged(rows).where("_repeated").select("_key", F.shiftright("_state", 2).cast("int").alias("_at"))
    copies = keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key", F.lit(-1).alias("_at"))
    return singles.unionByName(copies).groupBy("_key").agg(F.collect_set("_at").alias("_at"))


def unique_windows(survivors: DataFrame, text: str, window: int) -> DataFrame:
    """Level two: _key and the full windows of surviving anchors that occur nowhere else."""

    def extended(batches: Batches):
        words, block, seen = Words(), Block(), set()
        for batch in batches:
            for key, value, places in zip(batch.column("_key").to_pylist(), _texts(batch, text), batch.column("_at").to_pylist(), strict=True):
                split = value.split()
                if len(split) < window or key in seen:
                    continue
                if len(seen) < BLOCK:
                    seen.add(key)
                starts, codes = _candidates(words, split, places, window)
                block.add(window_hashes(codes, window, 2)[starts], key, starts)
                if block.size >= BLOCK:
                    yield from block.rows(False)
        yield from block.rows(False)

    judged = _judged(survivors.mapInArrow(extended, _ROWS))
    return judged.where("NOT _repeated").select("_key", F.shiftright("_state", 2).cast("int").alias("_start")).groupBy("_key").agg(
        F.collect_set("_start").alias("_unique"))


def _candidates(words: Words, split: list[bytes], places: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Full windows whose anchor survived, and the codes of the words."""
    codes = words.codes(split)
    at, _, first, last = anchors(codes, window)
    kept = np.flatnonzero(np.isin(at, np.array(places)))
    if -1 in places:  # every window of a copied text is one of the corpus
        kept = np.arange(len(at))
    return np.concatenate([np.arange(first[i], last[i] + 1) for i in kept] or [np.empty(0, np.int64)]), codes


def covered(words: Words, split: list[bytes], places: list[int] | None, unique: list[int] | None, window: int) -> np.ndarray | None:
    """Which words a repeated window covers; None: none."""
    if places is None or len(split) < window:
        return None
    if -1 in places:
        return np.ones(len(split), dtype=bool)
    starts, _ = _candidates(words, split, places, window)
    if unique:
        starts = np.setdiff1d(starts, np.array(unique), assume_unique=True)
    if not len(starts):
        return None
    edges = np.zeros(len(split) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed and kept (the words left, or with ``keep_text`` false their
    hash). Result columns replace those of the same name."""
    added = ("n_words", "n_removed", "kept" if keep_text else "kept_sha256")
    columns = [c for c in docs.columns if c not in added]
    keyed = packed(docs.select(*(F.col(f"`{c}`") for c in columns)), text)
    keyed = keyed.select(F.xxhash64(F.coalesce(F.col("_text"), F.lit("")), F.length("_text")).alias("_key"), "_row", "_text")
    places = materialize(surviving_anchors(keyed, "_text", window), "anchors")
    # both joins below read the same exchange of the texts
    unique = unique_windows(keyed.join(places.hint("shuffle_hash"), "_key"), "_text", window)
    whole = keyed.join(places.hint("shuffle_hash"), "_key", "left").join(unique.hint("shuffle_hash"), "_key", "left")

    def cut(batches: Batches):
        words = Words()
        for batch in batches:
            totals, removed, kept = [], [], []
            for value, places, unique in zip(_texts(batch, "_text"), batch.column("_at").to_pylist(), batch.column("_unique").to_pylist(), strict=True):
                split = value.split()
                gone = covered(words, split, places, unique, window)
                left = split if gone is None else [w for w, g in zip(split, gone.tolist(), strict=True) if not g]
                totals.append(len(split))
                removed.append(len(split) - len(left))
                joined = b" ".join(left)
                kept.append(joined.decode() if keep_text else hashlib.sha256(joined).hexdigest())
            yield batches_of({c: (batch.column(c), None) for c in ("_row", "_text")} | {
                "_words": (totals, pa.int64()), "_removed": (removed, pa.int64()), "_kept": (kept, pa.string())})

    schema = T.StructType([keyed.schema["_row"], keyed.schema["_text"], T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType()), T.StructField("_kept", T.StringType())])
    own = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return whole.mapInArrow(cut, schema).select(*own, *(F.col(f"_{name}").alias(c) for name, c in zip(("words", "removed", "kept"), added, strict=True)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, keep_text=False).drop("text")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows cover; documents that lose none keep their text."""
    cut = without_repeats(packed(docs, "text"), text="_text")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("_row.n_chars"))
    return unpacked(cut, docs, "text", new)


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
