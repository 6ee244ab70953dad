"""Near-duplicate classes: BagMinHash signatures, banding, and exact verification.

A document is the multiset of its five-word shingles. The weight axis of a shingle is cut into dyadic
blocks [0, 1), [1, 2), [2, 4), ...; each block of each shingle has a Poisson process of points, seeded by
the shingle, whose rate is the block's width and whose points lie at uniform levels in it. A point
counts if its level is below the shingle's number, and proposes its arrival time for one component of
the signature. The least proposal wins, so two documents agree in a component with a probability equal
to their weighted Jaccard similarity, and points later than the components' maximum are never made.

``BANDS`` bands of ``ROWS`` components give candidates: a pair at 0.8 is missed by all bands with
probability 8e-5. Candidates are verified on the shingle multisets of the whole texts. No bucket is expanded
into its pairs: first every text is compared with one bucket's least key, then with those of its other
buckets that are not in its component yet, at last only members outside a bucket's largest component with
members of other components, the likeliest pairs first. Texts of buckets that are still in several components
get a second, longer signature; what it shows to be clearly below the threshold is not verified. Links form
components by contraction; every step is written to the shared folder.

Defined results: equal texts are one class; null counts as empty; texts without words are like equal ones
only; a text of one to four words is one shingle; class_id is the least doc_id of the class (null if none has
one); every row is kept, repeated rows as well; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, batches_of, materialize, mix64, packed, table, texts_of, unpacked
from offerscope.llm.repeats import Words, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 7, 40
SKETCH = ROWS * BANDS  # components with two bits each in a sketch
LONG = 1024  # and in the longer one
SLACK = 5.0  # deviations by which a pair's sketches may differ more than those of a pair at the threshold
ESTIMATES = (0.84, 0.8)  # what pairs are compared first, by the similarity that their longer sketches suggest
SEEN = 500_000
_BLOCK, _POINT, _PLACE, _BAND = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingles(words: Words, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, ascending, and their numbers."""
    split = text.encode("utf-8", "replace").split()
    if not split:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(window_hashes(words.codes(split), min(SHINGLE, len(split)), 1), return_counts=True)


def multiset_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def _points(seeds: np.ndarray, width: int, limit: float):
    """Points of Poisson processes of rate ``width`` up to a time: (process, time, random bits)."""
    alive, reached, done = np.arange(len(seeds)), np.zeros(len(seeds)), 0
    expected = limit * width
    step = 1 if expected < 0.5 else int(expected + 3 * expected ** 0.5 + 2)
    while len(alive):
        number = np.arange(done, done + step, dtype=np.uint64)
        bits = mix64(seeds[alive][:, None] + number * _POINT)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        times = reached[:, None] + np.cumsum(gaps, axis=1)
        row, column = np.nonzero(times <= limit)
        yield alive[row], times[row, column], bits[row, column]
        going = times[:, -1] <= limit
        alive, reached, done = alive[going], times[going, -1], done + step
        step = max(step, 4)


def signature(elements: np.ndarray, counts: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Random bits of the winning point of every component."""
    limit = size * (np.log(size) + 3) / counts.sum()
    blocks = [(0, 1, elements, counts)]
    low = 1
    while (larger := counts > low).any():
        blocks.append((low, low, elements[larger], counts[larger]))
        low *= 2
    while True:
        best, winner = np.full(size, np.inf), np.zeros(size, dtype=np.uint64)
        times, places, bits_of = [], [], []
        for start, width, own, number in blocks:
            for process, time, bits in _points(mix64(own + np.array([start + 1], dtype=np.uint64) * _BLOCK), width, limit):
                more = mix64(bits + _PLACE)
                level = start + ((more & np.uint64(0xFFFFFFFF)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
                counted = level < number[process]
                times.append(time[counted])
                places.append(((more[counted] >> np.uint64(32)) % np.uint64(size)).astype(np.int64))
                bits_of.append(bits[counted])
        time, place, bits = np.concatenate(times), np.concatenate(places), np.concatenate(bits_of)
        order = np.argsort(-time, kind="stable")  # the least time is written last
        best[place[order]], winner[place[order]] = time[order], bits[order]
        if np.isfinite(best).all():
            return winner
        limit *= 2


def _banded(winner: np.ndarray) -> np.ndarray:
    code = np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND
    for column in winner.reshape(BANDS, ROWS).T:
        code = mix64(code + column)
    return code.view(np.int64)


def _columns(size: int) -> list[str]:
    return [f"_sketch{size}_{i}" for i in range(-(-size // 32))]


def _sketched(winner: np.ndarray) -> list[int]:
    """Two bits of each component, 32 components in a number."""
    symbols = np.zeros(len(_columns(len(winner))) * 32, dtype=np.uint64)
    symbols[: len(winner)] = winner & np.uint64(3)
    shifted = symbols.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(shifted, axis=1).view(np.int64).tolist()


def signatures(keyed: DataFrame) -> DataFrame:
    """_key, _weight, sketches and _bands of every distinct text that has words."""

    def signed(batches: Batches):
        words, seen = Words(), set()
        for batch in batches:
            keys, weights, sketches, bands = [], [], [], []
            for key, text in zip(batch.column("_key").to_pylist(), texts_of(batch, "_text"), strict=True):
                if key in seen:
                    continue
                if len(seen) < SEEN:  # only spares work, copies are dropped below
                    seen.add(key)
                elements, counts = shingles(words, text)
                if not len(elements):
                    continue
                winner = signature(elements, counts)
                keys.append(key)
                weights.append(int(counts.sum()))
                sketches.append(_sketched(winner))
                bands.append(_banded(winner))
            yield batches_of(
                {"_key": (keys, pa.int64()), "_weight": (weights, pa.int64())} | _sketch_arrays(sketches, SKETCH) | {"_bands": (bands, pa.list_(pa.int64()))}
            )

    made = keyed.select("_key", "_text").mapInArrow(signed, f"_key long, _weight long, {_sketch_schema(SKETCH)}, _bands array<long>")
    return made.dropDuplicates(["_key"])


def long_sketches(texts: DataFrame) -> DataFrame:
    """_key, _weight and a sketch of ``LONG`` components of every text; the texts have words and distinct keys."""

    def sketched(batches: Batches):
        words = Words()
        for batch in batches:
            made = [shingles(words, text) for text in texts_of(batch, "_text")]
            weights = [int(counts.sum()) for _, counts in made]
            sketches = [_sketched(signature(elements, counts, LONG)) for elements, counts in made]
            yield batches_of({"_key": (batch.column("_key"), None), "_weight": (weights, pa.int64())} | _sketch_arrays(sketches, LONG))

    return texts.select("_key", "_text").mapInArrow(sketched, f"_key long, _weight long, {_sketch_schema(LONG)}")


def _sketch_schema(size: int) -> str:
    return ", ".join(f"{name} long" for name in _columns(size))


def _sketch_arrays(sketches: list[list[int]], size: int) -> dict[str, tuple[list[int], pa.DataType]]:
    return {name: ([s[i] for s in sketches], pa.int64()) for i, name in enumerate(_columns(size))}


def _plausible(a: str, b: str, size: int, estimate: float | None = None):
    """Condition that every pair at the threshold meets: weights, and sketches within ``SLACK`` deviations;
    with an estimate, that the sketches suggest so much."""
    differ = (1 - THRESHOLD) * 3 / 4  # components that differ, and not by chance alike in two bits
    most = int(size * differ + SLACK * (size * differ * (1 - differ)) ** 0.5)
    if estimate is not None:
        most = int(size * (1 - estimate) * 3 / 4)
    col = lambda side, name: F.col(f"{side}.{name}")
    odd = lambda x: F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    distance = sum(odd(col(a, n).bitwiseXOR(col(b, n))) for n in _columns(size))
    small, large = F.least(col(a, "_weight"), col(b, "_weight")), F.greatest(col(a, "_weight"), col(b, "_weight"))
    return (small >= THRESHOLD * large) & (distance <= most)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts reach the threshold."""
    left = texts.select(F.col("_key").alias("a"), F.col("_text").alias("_text_a"))
    right = texts.select(F.col("_key").alias("b"), F.col("_text").alias("_text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "_text_a", "_text_b")

    def compared(batches: Batches):
        words, last, last_set = Words(), None, None
        for batch in batches:
            a, b, linked = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for key, text_a, text_b in zip(a, texts_of(batch, "_text_a"), texts_of(batch, "_text_b"), strict=True):
                if key != last:
                    last, last_set = key, shingles(words, text_a)
                linked.append(multiset_jaccard(last_set, shingles(words, text_b)) >= THRESHOLD)
            yield batches_of({"a": (batch.column("a"), None), "b": (batch.column("b"), None)}).filter(pa.array(linked, type=pa.bool_()))

    return both.mapInArrow(compared, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """_key and _root, the least key it is linked with over any number of links.

    Every node points to its least neighbour if that is less, pointers are doubled until they reach the trees'
    roots, and the links between different roots, each once, are the next round's.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = materialize(ends.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")), "tree")
        while True:
            above = tree.select(F.col("a").alias("root"), F.col("root").alias("higher"))
            tree = materialize(tree.select("a", "root").join(above, "root").select("a", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "tree")
            if tree.where("moved").isEmpty():
                break
        tree = tree.select("a", "root")
        if labels is None:
            labels = tree.select(F.col("a").alias("_key"), F.col("root").alias("_root"))
        else:
            raised = labels.join(tree, F.col("_root") == F.col("a"), "left")
            labels = materialize(raised.select("_key", F.coalesce("root", "_root").alias("_root")), "labels")
        into = tree.select(F.col("a").alias("b"), F.col("root").alias("root_b"))
        between = edges.join(tree, "a").join(into, "b").where("root <> root_b")
        edges = materialize(between.select(F.least("root", "root_b").alias("a"), F.greatest("root", "root_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def _star(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a pivot and a text that pass the cheap conditions."""
    facts = signed.drop("_bands")
    pivots = facts.withColumnRenamed("_key", "_pivot").alias("p")
    known = pairs.select("_key", "_pivot").join(facts, "_key").alias("m").join(pivots, F.col("m._pivot") == F.col("p._pivot"))
    return known.where(_plausible("m", "p", SKETCH)).select(F.col("m._pivot").alias("a"), F.col("m._key").alias("b"))


def near_links(keyed: DataFrame) -> DataFrame:
    """_key and _root of all texts that are linked with a different text; ``keyed`` has _key and _text."""
    signed = materialize(signatures(keyed), "signatures")
    bands = signed.select("_key", F.explode("_bands").alias("_band"))
    shared = bands.groupBy("_band").agg(F.min("_key").alias("_pivot"), F.max("_key").alias("_other")).where("_pivot < _other").drop("_other")
    members = materialize(bands.join(shared, "_band"), "members")
    texts = materialize(keyed.select("_key", "_text").join(members.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"]), "texts")

    # first each text against one pivot, which settles most; then against the pivots it isn't linked with
    single = members.groupBy("_key").agg(F.min("_pivot").alias("_pivot")).where("_key <> _pivot")
    links = materialize(_verified(_star(single, signed), texts), "star")
    roots = components(links)
    apart = members.where("_key <> _pivot").select("_key", "_pivot").distinct().join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
    other = roots.select(F.col("_key").alias("_pivot"), F.col("_root").alias("_pivot_root"))
    apart = apart.join(other, "_pivot", "left").where(F.col("_root") != F.coalesce("_pivot_root", "_pivot"))
    links = materialize(links.unionByName(_verified(_star(apart, signed), texts)), "star")

    members = materialize(_open(members, components(links)).drop("_root", "_main"), "open")
    sketches = materialize(long_sketches(texts.join(members.select("_key").distinct(), "_key", "left_semi")), "sketches")
    sketches = materialize(sketches.join(signed.select("_key", "_bands"), "_key"), "sketches")
    for estimate in (*ESTIMATES, None):
        between = _across(_open(members, components(links)), sketches, estimate)
        links = materialize(links.unionByName(_verified(between, texts)), "star")
    return components(links)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their _root and the bucket's largest one, _main."""
    placed = members.join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
    sizes = placed.groupBy("_band", "_root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("_band").agg(F.max_by("_root", F.struct("n", "_root")).alias("_main"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(several.select("_band", "_main"), "_band")


def _across(placed: DataFrame, sketches: DataFrame, estimate: float | None) -> DataFrame:
    """Pairs of different components that share a bucket: members outside the bucket's largest component with
    those of the others, each in the first bucket that it shares (where one of them is that bucket's pivot, it was
    compared before). The likeliest pairs are taken first, since one link settles a text."""
    placed = materialize(placed.join(sketches, "_key"), "placed")
    outside, anyone = placed.where("_root <> _main").alias("x"), placed.alias("y")
    once = (F.col("y._root") == F.col("y._main")) | (F.col("x._key") < F.col("y._key"))
    untested = (F.col("x._key") != F.col("x._pivot")) & (F.col("y._key") != F.col("x._pivot"))
    different = (F.col("x._band") == F.col("y._band")) & (F.col("x._root") != F.col("y._root")) & once & untested
    first = F.array_intersect("x._bands", "y._bands")[0] == F.col("x._band")
    pairs = outside.join(anyone, different & _plausible("x", "y", LONG, estimate) & first)
    return pairs.select(F.least("x._key", "y._key").alias("a"), F.greatest("x._key", "y._key").alias("b"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_key", F.xxhash64(text, F.length(text)))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and is_first (the class's least row) of every row, and its _key."""
    keyed = _keyed(docs.select("doc_id", "text"))
    roots = near_links(keyed.select("_key", F.col("text").alias("_text")))
    rows = keyed.select("doc_id", "_key").join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key"))
    heads = rows.groupBy("_root").agg(least.alias("_head"), F.count("*").alias("class_size"))
    first = F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("_key") == F.col("_head._key"))
    return rows.join(heads, "_root").select("doc_id", F.col("_head.doc_id").alias("class_id"), "class_size", first.alias("is_first"), "_key")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("_key")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least doc_id; of repeated rows one."""
    others = classes(docs).where("NOT is_first").select(F.col("doc_id").alias("_other"), F.col("_key").alias("_other_key")).distinct()
    rows = packed(docs, "text")
    keyed = _keyed(rows.withColumnRenamed("_text", "text")).select("_row", F.col("text").alias("_text"), "_key", F.col("_row.doc_id").alias("_doc"))
    kept = keyed.join(others, (F.col("_key") == F.col("_other_key")) & F.col("_doc").eqNullSafe(F.col("_other")), "left_anti")
    number = F.row_number().over(Window.partitionBy("_key", "_doc").orderBy("_key"))
    return unpacked(kept.withColumn("_number", number).where("_number = 1"), docs, "text")


QUERIES = {"op9_bagminhash": op9_bagminhash}
