"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit tells the languages whose bit is 1 from the others
by letter n-grams. The bit's weights are log-odds of the hashed n-grams, each language counting the same on its
side, so they follow from counts by language and all classifiers come from one counting. Decoding adds up, per
language, the logistic losses of its bits, weighted by how often each bit was right for that language on the
sample, and takes the least. A text whose hard bits differ from the chosen codeword in more places than the
code corrects, or whose runner-up is close, is flagged as ambiguous.

Fitting reads about ``PER_LANG`` labelled rows of each language at most (a hash of doc_id decides which, at a
rate that follows the language's count), whole texts; counts are summed by Spark. What is broadcast is bounded
by 2**DIMENSION_BITS coordinates times the bits. Predicting is a map over all rows, whole texts in blocks.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing
was learnt; with one learnt language every other text is that language with score 1; ties go to the language
that sorts first. A null doc_id has a null held_out and is never learnt from; null texts and null languages
neither. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.common import Batches, batches_of, bounded_rows, materialize, table

DIMENSION_BITS = 17
PER_LANG = 5_000
MAX_LANGS = 4096
LONG_CODE = 63
SMOOTHING = 0.5
CLOSE = 0.75  # a score below it is ambiguous
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20
_CELLS = 1024
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_SHIFT, _WIDTH = np.uint64(64 - DIMENSION_BITS), np.uint64(21)


def codebook(classes: int) -> np.ndarray:
    """Codewords, a row of +1 and -1 per class. Up to six classes have all distinct splits as bits, so that two
    codewords differ in half of them or more; beyond, the best of 32 random codes of LONG_CODE bits."""
    if classes <= 6:
        splits = np.arange(max(0, (1 << max(classes - 1, 0)) - 1))
        rows = [np.ones(len(splits), dtype=int)] + [splits >> i & 1 for i in range(classes - 1)]
        return np.array(rows[:classes]).reshape(classes, len(splits)) * 2 - 1
    best, widest = None, -1
    for seed in range(32):
        digests = (hashlib.sha256(f"code {seed} {c}".encode()).digest() for c in range(classes))
        code = np.array([np.unpackbits(np.frombuffer(d, dtype=np.uint8))[:LONG_CODE] for d in digests]).astype(int) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        if (apart := least_distance(code)) > widest:
            best, widest = code, apart
    return best


def least_distance(code: np.ndarray) -> int:
    """The fewest places in which two codewords differ."""
    if len(code) < 2:
        return 0
    product = code @ code.T
    np.fill_diagonal(product, -code.shape[1])
    return int((code.shape[1] - product.max()) // 2)


@functools.cache
def letter_codes() -> np.ndarray:
    """Per code point the code of its lower-case letter, 0 where it is no letter."""
    codes = np.zeros(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            lower = c.lower()
            codes[i] = ord(lower) if len(lower) == 1 else i
    return codes


def grams(text: str) -> Iterator[np.ndarray]:
    """Coordinates of all runs of one to three letters of a whole text, block by block; what is no letter counts as
    one boundary. Nothing at all for a text without a letter."""
    table_ = letter_codes()
    tail, seen = np.zeros(1, dtype=np.uint64), False
    for start in range(0, len(text) + 1, BLOCK_CHARS):
        codes = table_[np.frombuffer(text[start:start + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if start + BLOCK_CHARS > len(text):
            codes = np.append(codes, np.uint64(0))
        letter = codes != 0
        seen = seen or letter.any()
        if not seen:
            continue
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= tail[-1] != 0
        codes, old = np.concatenate([tail, codes[kept]]), len(tail)
        if len(codes) > old:
            pairs = codes[:-1] << _WIDTH | codes[1:]
            triples = pairs[:-1] << _WIDTH | codes[2:]
            # only runs that end in this block
            runs = (codes[old:], pairs[old - 1:], triples[max(old - 2, 0):])
            yield np.concatenate([run * odd >> _SHIFT for run, odd in zip(runs, _ODD, strict=True)]).astype(np.int32)
            tail = codes[-2:]


class Model:
    """Languages, codewords, weights of the bits' classifiers, and how far each bit is relied on per language."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.code = langs, codebook(len(langs))
        self.reliance = np.full(self.code.shape, 1.0 / max(self.code.shape[1], 1))
        self.seen = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(at for at, _ in counts.values())])).astype(np.int64)
        shares = np.full((len(langs), len(self.seen)), SMOOTHING)
        for i, lang in enumerate(langs):
            if lang in counts:
                at, n = counts[lang]
                shares[i, np.searchsorted(self.seen, at)] += n
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1.0)
        sides = [(self.code == side).astype(float) for side in (1, -1)]
        ones, zeros = ((side / np.maximum(side.sum(axis=0), 1)).T @ shares for side in sides)
        # last row: coordinates that were never seen
        self.weights = np.vstack([np.log(ones / zeros).T, np.zeros((1, self.code.shape[1]))]).astype(np.float32) if len(self.seen) else np.zeros((1, self.code.shape[1]), dtype=np.float32)

    def row_of(self) -> np.ndarray:
        """Row of ``weights`` of every coordinate."""
        rows = np.full(1 << DIMENSION_BITS, len(self.seen), dtype=np.int32)
        rows[self.seen] = np.arange(len(self.seen))
        return rows

    def margins(self, text: str, rows: np.ndarray) -> np.ndarray | None:
        """Evidence of every bit, by the root of the number of n-grams; nothing if the text has no letter."""
        total, known, any_letter = np.zeros(self.code.shape[1]), 0, False
        for coordinates in grams(text):
            any_letter = True
            at = rows[coordinates]
            known += int((at < len(self.seen)).sum())
            total += self.weights[at].sum(axis=0, dtype=np.float64)
        return total / np.sqrt(max(known, 1)) if any_letter else None

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score, and whether it is ambiguous."""
        losses = (self.reliance * np.logaddexp(0.0, -self.code * margins)).sum(axis=1) * self.code.shape[1]
        best = int(np.argmin(losses))
        score = float(1.0 / np.exp(losses[best] - losses).sum())
        wrong = int((np.where(margins >= 0, 1, -1) != self.code[best]).sum())
        return self.langs[best], score, bool(wrong > max(least_distance(self.code) - 1, 0) // 2 or score < CLOSE)


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], DataFrame]:
    """The languages, and text and number of language of the sampled rows."""
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = sorted((r["lang"], r["n"]) for r in bounded_rows(labelled.groupBy("lang").agg(F.count("*").alias("n")), MAX_LANGS, "languages"))
    langs = [lang for lang, _ in found]
    limits = [int(min(1.0, per_lang / n) * (1 << 30)) for _, n in found]
    if not langs:
        return langs, labelled.select(F.col("text").alias("_text"), F.lit(0).alias("_lang")).limit(0)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) < F.element_at(F.array(*map(F.lit, limits)), number))
    return langs, chosen.select(F.col("text").alias("_text"), (number - 1).alias("_lang"))


def _counted(sample: DataFrame) -> DataFrame:
    """_lang, _cell, and the occurrences of the cell's coordinates: at most one row per language and cell."""

    def counts(batches: Batches):
        held: dict[int, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield batches_of({"_lang": (np.full(len(at), lang), pa.int32()), "_at": (at, pa.int32()), "n": (n[at], pa.int64())})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if lang not in held and len(held) == 64:
                    yield from emptied()
                n = held.setdefault(lang, np.zeros(1 << DIMENSION_BITS, dtype=np.int64))
                for coordinates in grams(text):
                    n += np.bincount(coordinates, minlength=len(n))
        yield from emptied()

    summed = sample.mapInArrow(counts, "_lang int, _at int, n long").groupBy("_lang", "_at").agg(F.sum("n").alias("n"))
    return summed.groupBy("_lang", F.expr(f"_at div {_CELLS}").alias("_cell")).agg(F.collect_list("_at").alias("at"), F.collect_list("n").alias("n"))


def _rely(model: Model, sample: DataFrame) -> None:
    """Set how often each bit is right on the sample, per language, as shares of one."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def right(batches: Batches):
        held, rows, right_n = shared.value, shared.value.row_of(), {}
        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                margins = held.margins(text, rows)
                if margins is not None:
                    n = right_n.setdefault(lang, np.zeros(held.code.shape[1] + 1, dtype=np.int64))
                    n += np.append((margins >= 0) == (held.code[lang] > 0), True)
        for lang, n in right_n.items():
            yield batches_of({"_lang": (np.full(len(n), lang), pa.int32()), "_bit": (np.arange(len(n)), pa.int32()), "n": (n, pa.int64())})

    summed = sample.mapInArrow(right, "_lang int, _bit int, n long").groupBy("_lang", "_bit").agg(F.sum("n").alias("n"))
    bits = model.code.shape[1]
    right_of = np.zeros((len(model.langs), bits + 1))
    for r in bounded_rows(summed, len(model.langs) * (bits + 1), "bits"):
        right_of[r["_lang"], r["_bit"]] = r["n"]
    share = (right_of[:, :bits] + 1) / (right_of[:, bits:] + 2)
    model.reliance = share / share.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang`` of the rows that are not held out."""
    langs, sample = training_sample(docs, per_lang)
    if not langs:
        return Model([], {})
    sample = materialize(sample, "langid-sample")  # read twice, the table only once
    counts: dict[str, tuple[list, list]] = {}
    for r in bounded_rows(_counted(sample), len(langs) * ((1 << DIMENSION_BITS) // _CELLS), "cells"):
        at, n = counts.setdefault(langs[r["_lang"]], ([], []))
        at.extend(r["at"])
        n.extend(r["n"])
    model = Model(langs, {lang: (np.array(at, dtype=np.int64), np.array(n, dtype=np.int64)) for lang, (at, n) in counts.items()})
    if model.code.shape[1]:
        _rely(model, sample)
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df``, and lang_pred, score and ambiguous for the whole text; a map without shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def predicted(batches: Batches):
        held, rows = shared.value, shared.value.row_of()
        for batch in batches:
            out = []
            for value in batch.column(text).to_pylist():
                margins = held.margins(value, rows) if value and held.langs else None
                out.append((UNKNOWN, 0.0, True) if margins is None else held.decode(margins))
            yield batches_of({c: (batch.column(c), None) for c in kept} | {
                "lang_pred": ([o[0] for o in out], pa.string()), "score": ([o[1] for o in out], pa.float64()), "ambiguous": ([o[2] for o in out], pa.bool_())})

    return df.mapInArrow(predicted, schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op12_language_id": op12_language_id}
