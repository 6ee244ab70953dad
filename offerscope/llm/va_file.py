"""Exact top-k search with vector approximations.

Vectors are integers, floor(scale * x). Every block of candidates keeps, beside the exact vectors, an
approximation: one byte per dimension, the number of its cell between the block's least and greatest
value. A scan of the cells bounds every inner product from below and above. Candidates whose upper bound
is under the k-th best lower bound cannot qualify; the others are read exactly in the order of their upper
bounds until the k-th exact score is better than what the rest can reach. Blocks return k rows per query
at most, which are merged by rank.

Queries are broadcast in groups of about ``QUERY_ROWS``; with more of them the candidates are scanned
once per group, so the memory of a task depends on neither table.

Defined results: vectors that are null or hold a null or a non-finite component take no part, nor does a
pair of different length; rows with the query's own id are no candidates of it; rows with a null id are
neither queries nor candidates; equal scores go to the smaller id; repeated candidate rows count each.
Scores are 64-bit integers: the cells' bounds are widened by their rounding error, exact vectors are multiplied
as integers, and an inner product that might not fit into 64 bits raises ``OverflowError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, batches_of, bounded_rows, table

QUERY_ROWS = 2048
CELLS = 255
CANDIDATE_ROWS = 4096


def to_integers(df: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and the vector ``v`` as integers, usable rows only."""
    usable = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wide = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"))
    return wide.where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & usable).select(
        "vec_id", F.transform("_v", lambda x: F.floor(x * scale)).alias("v"))


class Block:
    """Candidates of one length: exact vectors and the cells that approximate them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low, self.most = low.astype(np.float64), np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64)))
        width = np.maximum(np.ceil((high.astype(np.float64) - self.low + 1) / CELLS * (1 + 2.0**-40)), 1)
        self.cells = np.minimum((vectors.astype(np.float64) - self.low) // width, CELLS).astype(np.uint8)
        self.width = width

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any vector in a candidate's cells."""
        queries = queries.astype(np.float64)
        size = np.abs(queries) @ (self.most + self.width)
        if (size >= 2.0**63).any():
            raise OverflowError("an inner product may not fit into 64 bits")
        # sums below 2**53 have no rounding error; beyond, every term and addition may lose half a unit
        slack = np.where(size < 2.0**53, 0.0, size * (queries.shape[1] + 8) * 2.0**-50)[:, None]
        floor = self.low + self.cells * self.width
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        base, reach = queries @ floor.T, self.width - 1
        return base + (down @ reach)[:, None] - slack, base + (up @ reach)[:, None] + slack

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query position, vec_ids, scores) of the k best of every query."""
        lower, upper = self.bounds(queries)
        own = query_ids[:, None] == self.ids[None, :]
        lower[own] = upper[own] = -np.inf
        for at in range(len(queries)):
            n = len(self.ids)
            kth = np.partition(lower[at], n - k)[n - k] if n > k else -np.inf
            left = np.flatnonzero((upper[at] >= kth) & np.isfinite(upper[at]))
            left = left[np.lexsort((self.ids[left], -upper[at][left]))]
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            for start in range(0, len(left), 4 * k):
                if len(scores) == k and scores[-1] > upper[at][left[start]]:
                    break
                step = left[start:start + 4 * k]
                ids = np.append(ids, self.ids[step])
                scores = np.append(scores, self.vectors[step] @ queries[at])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            yield at, ids, scores


def _blocks(batches: Batches):
    """Blocks of one vector length each."""
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATE_ROWS):
            part = batch.slice(start, CANDIDATE_ROWS)
            ids, vectors = part.column("vec_id").to_numpy(zero_copy_only=False), part.column("v")
            lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths)
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                yield Block(ids[rows], flat[(ends[rows] - length)[:, None] + np.arange(length)])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as ``to_integers`` makes them."""
    spark = candidates.sparkSession
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    grouped = queries.distinct().withColumn("_group", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)))
    found = None
    for group in range(groups):
        # dealt by hash, QUERY_ROWS on average; twice as many have a probability below 1e-300
        rows = bounded_rows(grouped.where(F.col("_group") == group).drop("_group"), 2 * QUERY_ROWS, "queries of a group")
        shared = spark.sparkContext.broadcast([(r["vec_id"], list(r["v"])) for r in rows])

        def scan(batches: Batches, shared=shared):
            by_length: dict[int, list] = {}
            for number, (query_id, vector) in enumerate(shared.value):
                by_length.setdefault(len(vector), []).append((number, query_id, vector))
            ready = {n: ([x[0] for x in q], np.array([x[1] for x in q]), np.array([x[2] for x in q], dtype=np.int64)) for n, q in by_length.items() if n}
            kept: dict[int, tuple] = {}
            for block in _blocks(batches):
                numbers, ids, vectors = ready.get(block.vectors.shape[1], ((), None, None))
                for at in range(0, len(numbers), 256):
                    for row, vec_ids, scores in block.best(ids[at:at + 256], vectors[at:at + 256], k):
                        number = numbers[at + row]
                        if number in kept:
                            vec_ids, scores = np.append(kept[number][0], vec_ids), np.append(kept[number][1], scores)
                            order = np.lexsort((vec_ids, -scores))[:k]
                            vec_ids, scores = vec_ids[order], scores[order]
                        kept[number] = (vec_ids, scores)
            numbers = [n for n, (vec_ids, _) in kept.items() for _ in vec_ids]
            yield batches_of({
                "query": ([n for n in numbers], pa.int64()), "query_id": ([shared.value[n][0] for n in numbers], pa.int64()),
                "vec_id": ([int(x) for vec_ids, _ in kept.values() for x in vec_ids], pa.int64()),
                "score": ([int(x) for _, scores in kept.values() for x in scores], pa.int64())})

        part = candidates.mapInArrow(scan, "query long, query_id long, vec_id long, score long").withColumn("_group", F.lit(group))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_group", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = to_integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = {"op6_va_file_top_k": """
WITH usable AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""}

QUERIES = {"op6_va_file_top_k": op6_va_file_top_k}
