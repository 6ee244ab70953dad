"""Document fingerprints: SpotSigs.

Wherever a common word (an anchor) occurs, the chain of the next ``CHAIN`` content words, anchors left
out, is a spot signature; a document's fingerprint is the multiset of its spots. A content word that no
anchor's chain covers starts a chain of its own. So every content word is in a spot, short or anchorless
texts have telling fingerprints as well, and the rule looks at the words around a place only, never at the
whole text: one word more, less or other changes the spots of at most 2 * ``CHAIN`` places.

Two fingerprints are compared by multiset Jaccard. A pair of sizes m <= n cannot reach a similarity t if
m < t * n, so alike fingerprints are in the same or neighbouring partitions of size (``size_partition``); a
comparison with a threshold stops as soon as what is left cannot reach it any more. The query does not
search for like pairs: it gives the exact likeness of fixed pairs, so its threshold is 0, nothing is pruned,
and the partition is a column that nothing here joins on.

The edited text needs the next document: rows are dealt into consecutive ranges of doc_id and the beginning of
the text, cut at quantiles of a sample, each range also gets the first row of the next one, and one pass over
the sorted range does the rest. Texts are shuffled once; a range is streamed. Rows with the same id and the
same first ``PREFIX`` characters stay in one range.

Defined results: null counts as empty; an empty fingerprint is like an empty one (1) and unlike any other
(0); null ids come first; rows of the same id are ordered by text; a single document is its own next.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, Memo, batches_of, bounded_rows, mix64, table, texts_of

# Frequent function words of English, German, French and Spanish.
ANCHORS = frozenset("""the of and to in is that was for it with as by on at from this are be or an have not
 der die das und ist von mit den dem ein eine zu sich auf für nicht des
 le la les de du des et est un une que dans pour qui sur par
 el los las y en es del al por con una se no su""".split())
CHAIN = 3
PREFIX = 64
KEY = ["_known", "_id", "_prefix"]
_NON_WORD = re.compile(r"[\W_]+")
_FACTORS = mix64(np.arange(1, CHAIN + 1, dtype=np.uint64))


def _word_code(token: str) -> int:
    """0: nothing; 1: an anchor; else a hash of the word."""
    core = _NON_WORD.sub("", token.lower())
    if not core:
        return 0
    return 1 if core in ANCHORS else xxhash.xxh3_64_intdigest(core) | 2


class Spots:
    def __init__(self):
        self.codes = Memo(_word_code)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 32-bit spot signatures, ascending, and how often each occurs."""
        words = text.split()
        codes = np.fromiter(map(self.codes.__getitem__, words), dtype=np.uint64, count=len(words))
        codes = codes[codes != 0]
        anchor = codes == 1
        content = codes[~anchor]
        if not len(content):
            whole = xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF
            return (np.array([whole], np.uint32), np.array([1], np.int64)) if text else (np.empty(0, np.uint32), np.empty(0, np.int64))
        padded = np.concatenate([content, np.zeros(CHAIN - 1, np.uint64)])
        chains = sum(padded[i:i + len(content)] * _FACTORS[i] for i in range(CHAIN))
        starts = np.cumsum(~anchor)[anchor]  # content words up to an anchor: the next one's place
        times = np.bincount(starts, minlength=len(content))[:len(content)]
        places = np.arange(len(content))
        last = np.maximum.accumulate(np.where(times > 0, places, -CHAIN))
        times[places - last >= CHAIN] = 1
        return np.unique((mix64(np.repeat(chains, times)) >> np.uint64(32)).astype(np.uint32), return_counts=True)


def size_partition(size: int, threshold: float) -> int:
    """Fingerprints that can be as alike as the threshold are in the same or in neighbouring partitions."""
    return 0 if size == 0 else 1 + int(math.log(size) / -math.log(threshold))


def pruned_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float = 0.0) -> float:
    """Multiset Jaccard, or 0 as soon as it cannot reach the threshold."""
    size_a, size_b = int(a[1].sum()), int(b[1].sum())
    if not size_a or not size_b:
        return float(size_a == size_b)
    if min(size_a, size_b) < threshold * max(size_a, size_b):
        return 0.0
    needed = threshold / (1 + threshold) * (size_a + size_b)
    common, step = 0, len(a[0]) if threshold <= 0 else 256
    left = size_a
    for start in range(0, len(a[0]), step):
        part, counts = a[0][start:start + step], a[1][start:start + step]
        at = np.searchsorted(b[0], part)
        found = b[0][np.minimum(at, len(b[0]) - 1)] == part
        common += int(np.minimum(counts[found], b[1][at[found]]).sum())
        left -= int(counts.sum())
        if common + left < needed:
            return 0.0
    return common / (size_a + size_b - common)


def encode(spots: tuple[np.ndarray, np.ndarray]) -> str:
    """Text of a fingerprint: its 32-bit spots, ascending and as often as they occur, in base64."""
    return base64.b64encode(np.repeat(*spots).astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(base64.b64decode(fingerprint), dtype="<u4"), return_counts=True)


def _bounds(rows: DataFrame, parts: int) -> list[tuple[bool, int, str]]:
    """Least keys of all ranges but the first, from quantiles of a sample; any bounds give the same results."""
    wanted = 20 * parts
    sampled = rows.select(*KEY).sample(min(1.0, wanted / max(rows.count(), 1)), seed=1)
    keys = sorted(tuple(r) for r in bounded_rows(sampled, 2 * wanted + 1000, "sampled ids"))
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)} - {keys[0]}) if keys else []


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in ranges of ascending id, sorted within, each range followed by the first row of the next.

    Columns: _range, _halo (that row), doc_id, _text. A range is cut anywhere in the order by id and the first
    ``PREFIX`` characters of the text, so outlying ids and ids of many texts are spread as well.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumns({
        "_known": F.col("doc_id").isNotNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_prefix": F.left("_text", F.lit(PREFIX))})
    bounds = _bounds(rows, parts)

    @F.pandas_udf("int")
    def range_of(known: pd.Series, number: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, key) for key in zip(known.tolist(), number.tolist(), prefix.tolist(), strict=True)], dtype="int32")

    rows = rows.withColumn("_range", range_of(*KEY))
    least = {r["_range"]: r["least"] for r in bounded_rows(rows.groupBy("_range").agg(F.min(F.struct(*KEY)).alias("least")), len(bounds) + 1, "ranges of ids")}
    used = sorted(least)
    # of the rows with a range's least key the one of the least text goes to the range before, too; the first range follows the last
    heads = [(used[i - 1], *least[used[i]]) for i in range(len(used))]
    head = F.broadcast(docs.sparkSession.createDataFrame(heads, "_before int, _known boolean, _id long, _prefix string"))
    halo = rows.join(head, KEY).groupBy("_before", "doc_id").agg(F.min("_text").alias("_text"))
    dealt = rows.select("_range", F.lit(False).alias("_halo"), "doc_id", "_text").union(halo.select("_before", F.lit(True), "doc_id", "_text"))
    return dealt.repartition("_range").sortWithinPartitions("_range", "_halo", "doc_id", "_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    partition of the fingerprint's size."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(batches: Batches):
        spots, held, held_range = Spots(), None, None
        for batch in batches:
            out: list[tuple] = []
            for number, doc_id, text in zip(batch.column("_range").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch, "_text"), strict=True):
                own = spots.of(text)
                if number == held_range:
                    out.append(row(spots, *held, text, own))
                held, held_range = (doc_id, text, own), number
            yield packed(out)

    def row(spots: Spots, doc_id, text: str, own, next_text: str, next_own) -> tuple:
        half = len(text) // 2
        edited = text[:len(text) - half] + next_text[:half]
        changed = own if edited == text else spots.of(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(own), encode(changed),
                pruned_jaccard(own, changed), pruned_jaccard(own, next_own), size_partition(int(own[1].sum()), 0.8))

    names = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
             "near_edited": pa.float64(), "near_next": pa.float64(), "size_partition": pa.int32()}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return batches_of({name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(names.items())})

    return with_next(docs, parts).mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, size_partition int")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op5_spotsigs": op5_spotsigs}
