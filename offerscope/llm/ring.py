"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``CELLS`` places. Every shard owns ``VIRTUAL_NODES`` of them; a row lies at the place of
its text's hash and belongs to the next virtual node clockwise. Each shard takes as many rows as its
capacity, and what overflows continues clockwise to the next shard with room. Capacities add up to the
number of rows and differ by one at most, so the shards do too (law ``rows``). Rows of equal text lie at
the same place and stay together unless a shard fills up among them: rows of an arc are numbered text by
text, so a cut of an arc splits at most the one text that it falls into.

Which shard takes how many rows of an arc follows from the counts of the arcs alone: at most
``shards * VIRTUAL_NODES`` numbers, whatever the size of the table. Rows are numbered inside an arc by groups
and the groups' offsets. A group is a bucket of text hashes, ordered by hash; each text with more than one
in ``HOT`` of all rows (fewer than ``HOT`` texts) has groups of its own, by salts of the key, so a text that
a third of the rows share is numbered by many tasks. The slot in the shard follows from the same number.

Defined results: a null text has no bytes (size 16, CRC-32 of nothing); rows may repeat and ids may be
null, each row gets a slot of its own; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerscope.llm.common import bounded_rows, table

CELLS = 1 << 13
VIRTUAL_NODES = 48
SALTS = 64
BUCKETS = 64
HOT = 1000


def place(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % CELLS


def arcs(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """The arc of every place, and the shard at the end of every arc, clockwise."""
    nodes = sorted((place(f"shard {s} node {n}"), s) for s in range(shards) for n in range(virtual_nodes))
    nodes = [node for i, node in enumerate(nodes) if not i or nodes[i - 1][0] != node[0]]
    owners, arc_of, arc = [s for _, s in nodes], [], 0
    for cell in range(CELLS):
        while arc < len(nodes) and nodes[arc][0] < cell:
            arc += 1
        arc_of.append(arc % len(nodes))
    return arc_of, owners


def spill(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): where the rows of every arc go.

    First every arc fills its own shard; then the overflow of all arcs moves on one node at a time.
    """
    room, taken, slots, out = list(capacity), [0] * len(counts), [0] * len(capacity), []
    afloat, step = [a for a, n in enumerate(counts) if n], 0
    while afloat:
        still = []
        for arc in afloat:
            shard = owners[(arc + step) % len(owners)]
            n = min(room[shard], counts[arc] - taken[arc])
            if n:
                out.append((arc, taken[arc], taken[arc] + n, shard, slots[shard]))
                room[shard] -= n
                slots[shard] += n
                taken[arc] += n
            if taken[arc] < counts[arc]:
                still.append(arc)
        afloat, step = still, step + 1
    return out


def _small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, without Python on the executors."""
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.replace(' ', ':') for f in schema.split(', '))}>>")))


def shard_rows(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, size, text_crc32, law, home_shard, shard, slot of every row."""
    spark = docs.sparkSession
    arc_of, owners = arcs(shards)
    code = F.coalesce(F.col(text), F.lit("")).cast("binary")
    cell = F.pmod("_hash", F.lit(CELLS)).cast("int")
    hashes = docs.select(F.xxhash64(code).alias("_hash"))
    often = hashes.groupBy("_hash").agg(F.count("*").alias("n")).where((F.col("n") > docs.count() / HOT) & (F.col("n") > 1))
    hot = {r["_hash"]: i for i, r in enumerate(sorted(bounded_rows(often, HOT, "texts of many rows")))}
    hot_table = F.broadcast(_small_table(spark, list(hot.items()) or [(0, None)], "_hash long, _hot int"))
    # hot texts first, then buckets of hashes; the low bits of a hash are the place
    bucket = F.coalesce("_hot", F.lit(HOT) + F.pmod(F.shiftrightunsigned("_hash", CELLS.bit_length() - 1), F.lit(BUCKETS)).cast("int"))
    rows = docs.select(F.col(key), (F.octet_length(code) + 16).cast("long").alias("size"), F.crc32(code).alias("text_crc32"), F.xxhash64(code).alias("_hash"))
    rows = rows.join(hot_table, "_hash", "left").select(
        key, "size", "text_crc32", "_hash", F.element_at(F.lit(arc_of), cell + 1).alias("_arc"), bucket.alias("_bucket"),
        F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0).cast("int").alias("_salt"))
    counted = rows.groupBy("_arc", "_bucket", "_salt").agg(F.count("*").alias("n"))
    groups = {(r["_arc"], r["_bucket"], r["_salt"]): r["n"] for r in bounded_rows(counted, len(owners) * BUCKETS + HOT * SALTS, "groups of an arc")}
    counts, offsets = [0] * len(owners), []
    for group in sorted(groups):
        offsets.append((*group, counts[group[0]]))
        counts[group[0]] += groups[group]
    total = sum(counts)
    plan = spill(counts, owners, [total // shards + (s < total % shards) for s in range(shards)])
    if not total:
        offsets, plan = [(-1, -1, -1, 0)], [(-1, 0, 0, 0, 0)]

    starts = F.broadcast(_small_table(spark, offsets, "_arc int, _bucket int, _salt int, _offset long"))
    takes = F.broadcast(_small_table(spark, plan, "_arc int, _from long, _to long, shard int, _slot long"))
    within = F.row_number().over(Window.partitionBy("_arc", "_bucket", "_salt").orderBy("_hash", key, "text_crc32", "size"))
    numbered = rows.withColumn("_number", within - 1).join(starts, ["_arc", "_bucket", "_salt"]).withColumn("_number", F.col("_number") + F.col("_offset"))
    placed = numbered.join(takes, (numbered["_arc"] == takes["_arc"]) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to")))
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), F.element_at(F.lit(owners), numbered["_arc"] + 1).alias("home_shard"),
                         "shard", (F.col("_slot") + F.col("_number") - F.col("_from")).alias("slot"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


QUERIES = {"op7_ring_shards": op7_ring_shards}
