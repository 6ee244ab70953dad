"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, neighbouring pairs and pairs with one word between, hashed to
2**DIMENSION_BITS coordinates. Each coordinate has its own learning rate, and L1 keeps most weights at
exactly zero, so what is broadcast for scoring is small and bounded by the number of coordinates.

Training. About ``sample_rows`` labelled documents at most (a hash of doc_id decides which, at a rate that
follows the number of labels; of rows that share an id one is taken, by the hash of its text) are dealt to ``shards``; each shard learns on its own and the weights are
averaged. Every row of the sample is learnt from in ``EPOCHS`` passes: the first pass writes its features to
an unnamed file of the task, which the others read, so memory does not depend on the length of the texts.
Toxic rows count ``TOXIC_WEIGHT`` times, since they are the rarer ones. Scoring is a
map over all documents, whole texts.

Defined results: null and empty texts have no features and get the score of the intercept; several labels
of one document count as toxic if any says so; a null doc_id has no label and a null held_out. Without
any label every score is 0.5. Columns of the input named like a result are replaced.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.common import Batches, Memo, batches_of, bounded_rows, mix64, packed, table, texts_of, unpacked

DIMENSION_BITS = 20
SAMPLE_ROWS = 16_000
SHARDS = 1
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
TOXIC_WEIGHT = 2.0
_NON_WORD = re.compile(r"[\W_]+")
_WORD, _PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - DIMENSION_BITS)


def _word_code(token: str) -> int:
    core = _NON_WORD.sub("", token.lower())
    return xxhash.xxh3_64_intdigest(core) | 1 if core else 0


class Features:
    """Coordinates present in a text, sorted."""

    def __init__(self):
        self.codes = Memo(_word_code)

    def hashed(self, text: str) -> np.ndarray:
        """Coordinates of every occurrence, unsorted."""
        words = text.split()
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint64, count=len(words))
        codes = codes[codes != 0]
        grams = np.concatenate([codes * _WORD, codes[:-1] * _PAIR + codes[1:], codes[:-2] * _SKIP + mix64(codes[2:])])
        return (mix64(grams) >> _SHIFT).astype(np.int32)

    def present(self, text: str) -> np.ndarray:
        return np.unique(self.hashed(text))


class Ftrl:
    """FTRL-proximal for logistic loss; coordinate 2**bits is the intercept, free of L1."""

    def __init__(self, bits: int = DIMENSION_BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.intercept = 1 << bits

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.intercept, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, present: np.ndarray, label: int) -> None:
        at = np.append(present, self.intercept)
        weights = self._weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        if label:
            gradient *= TOXIC_WEIGHT
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = n + gradient * gradient

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        everything = np.arange(len(self.z))
        weights = self._weights(everything)
        kept = np.flatnonzero(weights)
        return kept, weights[kept]


def _id_text(column: str = "doc_id"):
    return F.col(column).cast("string").cast("binary")


def held_out(column: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(_id_text(column)) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """shard order, label and text of a bounded part of the labelled documents that are not held out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    n = one.count()
    point = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = one.where(point < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30)))
    if chosen.count() > 2 * sample_rows:
        raise RuntimeError(f"a hash of doc_id chose more than twice the {sample_rows} rows meant")
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id")
    # an id that many rows share is learnt from once
    rows = rows.groupBy("doc_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return rows.select(F.xxhash64("doc_id", F.lit(7)).alias("_order"), F.col("_label").cast("int").alias("_label"), "_text")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS) -> DataFrame:
    """Table of (coordinate, weight), averaged over the shards by the rows each has seen."""
    dealt = training_sample(docs, labels, sample_rows).withColumn("_shard", F.pmod("_order", F.lit(shards)))
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_order")

    def learnt(batches: Batches):
        features, model, held = Features(), Ftrl(), []
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for label, text in zip(batch.column("_label").to_pylist(), texts_of(batch, "_text"), strict=True):
                    present = features.present(text)
                    model.learn(present, label)
                    file.write(present)
                    held.append((len(present), label))
            for _ in range(EPOCHS - 1):
                file.seek(0)
                for size, label in held:
                    model.learn(np.frombuffer(file.read(4 * size), dtype=np.int32), label)
        if rows := len(held):
            at, weights = model.nonzero()
            yield batches_of({"coordinate": (at, pa.int32()), "weight": (weights * rows, pa.float64()), "seen": (np.full(len(at), rows), pa.int64())})
            yield batches_of({"coordinate": ([-1], pa.int32()), "weight": ([0.0], pa.float64()), "seen": ([rows], pa.int64())})

    parts = dealt.mapInArrow(learnt, "coordinate int, weight double, seen long")
    return parts.groupBy("coordinate").agg(F.sum("weight").alias("weight"), F.sum("seen").alias("seen"))


def collect_weights(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """To the driver: at most one row per coordinate, however large the corpus."""
    rows = bounded_rows(model, (1 << DIMENSION_BITS) + 2, "weights")  # every coordinate, the intercept, the row count
    total = sum(r["seen"] for r in rows if r["coordinate"] == -1) or 1
    kept = sorted((r["coordinate"], r["weight"] / total) for r in rows if r["coordinate"] >= 0)
    return np.array([x[0] for x in kept], dtype=np.int32), np.array([x[1] for x in kept], dtype=np.float64)


def score(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str = "text", result: str = "score") -> DataFrame:
    """All columns of ``df`` and the probability of toxicity of the whole text; a map without shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in df.columns if c != result]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(result, T.DoubleType())])

    def scored(batches: Batches):
        at, values = shared.value
        dense = np.zeros((1 << DIMENSION_BITS) + 1)
        dense[at] = values
        used, features = dense != 0, Features()
        for batch in batches:
            sums = []
            for value in texts_of(batch, text):
                hashed = features.hashed(value)
                sums.append(dense[np.unique(hashed[used[hashed]])].sum())
            logit = np.array(sums, dtype=np.float64) + dense[-1]
            yield batches_of({c: (batch.column(c), None) for c in kept} | {result: (1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))), pa.float64())})

    return df.select(*kept).mapInArrow(scored, schema)


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    return collect_weights(train(docs, table(spark, sf_dir, "labels")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, their columns unchanged."""
    scored = score(packed(docs, "text"), fit(spark, docs, sf_dir), text="_text", result="_toxicity")
    return unpacked(scored.where("_toxicity < 0.5"), docs, "text")


QUERIES = {"op1_toxicity": op1_toxicity}
