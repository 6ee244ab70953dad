"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has a fingerprint: its length and, per lane, the polynomial sum of x(turn) * base**place
modulo ``P``. Fingerprints form a monoid: those of "head, then suffix" are head + base**len(head) * suffix. So
conversations are never rebuilt as texts. Prefix fingerprints of the original turns come from one
running sum; the fingerprint of the first d rebuilt turns is that of a head of the base conversation combined
with that of a stretch of own turns, a difference of two prefixes moved to its new place.

Rows (conversation, depth, fingerprint) grouped by depth and fingerprint are the nodes. Every node that more
than one stored turn stands for is verified: their references lead to the stored roles and texts, which must
all be equal. Equal last turns and equal fingerprints make the fingerprints one turn less equal too, so this
proves whole prefixes. If a verification ever fails, all is done again with other lanes.

A node belongs to its smallest member, so the nodes of one conversation are the end of its path, from depth
``_from`` on. What a member contributes to a node's subtree is thus a sum over the end of its own chain, and
subtree sums need one grouping and no recursion. No conversation and no node is gathered: positions and
running sums go by ranges and blocks, and the ids that end at a node are digested as a stream of sorted chunks.

Defined results: null roles and texts are empty; a null turn comes first, and rows with the same turn are
ordered by the digest of role and text; rows without a conversation id belong to no conversation; a
conversation whose turns all fall away is a member of the root only; an empty table has no root. Only the four
named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, batches_of, materialize, mix64, table
from offerscope.llm.ordered import deal, number, running_sums
from offerscope.llm.sqltext import CRC32_SQL

P = (1 << 31) - 1
LANES = 3
FAMILY = 20
MAX_HEAD = 3
CHUNK_IDS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", *(f"f{k}" for k in range(LANES))]


def bases(seed: int) -> list[int]:
    """One base per lane, fixed by the seed."""
    digest = hashlib.sha256(f"prefix trie {seed}".encode()).digest()
    return [int.from_bytes(digest[8 * k:8 * k + 8], "big") % (P - 1000) + 500 for k in range(LANES)]


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base**exponents modulo ``modulus``, all at once by repeated squaring."""
    out, square, left = np.ones(len(exponents), dtype=np.uint64), base % modulus, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(modulus), out)
        square, left = square * square % modulus, left >> np.uint64(1)
    return out


def head_length(conv_id: Column | str) -> Column:
    """Turns taken over from the base conversation, 0 to ``MAX_HEAD``."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % (MAX_HEAD + 1)).cast("int")


def base_of(conv_id: Column | str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % FAMILY


def stored_turns(rows: DataFrame) -> DataFrame:
    """The turns in order, written, with a reference ``_at``: conv_id, role, text, _mark (digest of the turn), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("_mark"))
    return deal(turns, "conv_id", [F.asc_nulls_first("turn"), F.asc("_mark")], "trie-turns")


def _with_terms(numbered: DataFrame, seed: int, modulus: int) -> DataFrame:
    """Per turn the terms x * base**pos of the lanes (s0, s1, ...); a map in Arrow batches."""
    kept = ["conv_id", "_pos", "_n", "_at", "words"]
    base, salt = bases(seed), [np.uint64(s) for s in range(seed * LANES + 1, (seed + 1) * LANES + 1)]

    def mapped(batches: Batches):
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("_mark").to_pylist()), dtype=np.uint64).reshape(-1, 4)
            pos = batch.column("_pos").to_numpy()
            out = {c: (batch.column(c), None) for c in kept}
            for k in range(LANES):
                x = mix64(mix64(marks[:, k] ^ salt[k]) + marks[:, 3]) % np.uint64(modulus - 1) + np.uint64(1)
                out[f"s{k}"] = ((x * powers(base[k], pos, modulus) % np.uint64(modulus)).astype(np.int64), pa.int64())
            yield batches_of(out)

    schema = "conv_id long, _pos long, _n long, _at long, words long, " + ", ".join(f"s{k} long" for k in range(LANES))
    return numbered.select(*kept, "_mark").mapInArrow(mapped, schema)


def rebuilt_rows(turns: DataFrame, seed: int = 0, modulus: int = P) -> DataFrame:
    """conv_id, depth, fingerprint, length (turns of the rebuilt conversation), words and _at (the stored turn) of
    every prefix of every rebuilt conversation. Prefixes inside the base's head have no words and no reference of
    their own: those of the base conversation stand for them."""
    kind = turns.schema["conv_id"].dataType
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "_at", "_mark", "words")
    terms = materialize(_with_terms(number(narrow, "conv_id"), seed, modulus), "trie-terms")
    lanes = [f"s{k}" for k in range(LANES)]
    prefixes = running_sums(terms, "conv_id", "_pos", lanes).withColumns({s: F.col(s) % modulus for s in lanes})
    prefixes = materialize(prefixes, "trie-prefixes")

    heads = prefixes.groupBy("conv_id").agg(F.max("_n").alias("n"), *(F.max(F.when(F.col("_pos") == i, F.col(s))).alias(f"{s}_{i + 1}") for s in lanes for i in range(MAX_HEAD)))
    bases_heads = heads.toDF("_base", *(f"b_{c}" for c in heads.columns[1:]))
    convs = heads.withColumns({"_base": base_of("conv_id"), "h": F.when(F.col("conv_id") % FAMILY == 0, 0).otherwise(head_length("conv_id"))}).join(bases_heads, "_base", "left")
    convs = convs.withColumn("head", F.least(F.col("h"), F.coalesce(F.col("b_n"), F.lit(0))).cast("int"))

    def at(prefix: str, lane: str, count: Column) -> Column:
        """Fingerprint of the first ``count`` turns, 0 to MAX_HEAD."""
        return F.coalesce(*(F.when(count == i, F.col(f"{prefix}{lane}_{i}")) for i in range(1, MAX_HEAD + 1)), F.lit(0)).cast("long")

    length = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    moved = [F.element_at(F.array(*(F.lit(pow(b, e, modulus)) for e in range(-MAX_HEAD, 1))), F.col("head") - F.col("h") + MAX_HEAD + 1).cast("long") for b in bases(seed)]
    convs = convs.select(
        "conv_id", "h", "head", length.alias("length"), *(at("b_", s, F.col("head")).alias(f"head_{s}") for s in lanes), *(at("", s, F.col("h")).alias(f"skip_{s}") for s in lanes),
        *(m.alias(f"move{k}") for k, m in enumerate(moved)), *(F.col(f"b_{s}_{i}") for s in lanes for i in range(1, MAX_HEAD + 1)))
    convs = materialize(convs, "trie-conversations")

    own = prefixes.select("conv_id", "_pos", "_at", "words", *lanes).join(convs.select("conv_id", "h", "head", "length", *(f"{a}_{s}" for a in ("head", "skip") for s in lanes), *(f"move{k}" for k in range(LANES))), "conv_id").where("_pos >= h")
    own = own.select("conv_id", (F.col("head") + F.col("_pos") + 1 - F.col("h")).cast("long").alias("depth"),
                     *(((F.col(f"head_s{k}") + F.col(f"move{k}") * F.pmod(F.col(f"s{k}") - F.col(f"skip_s{k}"), F.lit(modulus))) % modulus).alias(f"f{k}") for k in range(LANES)), "length", "words", "_at")
    # depth 0, the root, and the turns taken over
    taken = convs.select("conv_id", F.explode(F.sequence(F.lit(0), F.col("head"))).alias("depth"), "length", *(F.col(f"b_{s}_{i}") for s in lanes for i in range(1, MAX_HEAD + 1)))
    taken = taken.select("conv_id", F.col("depth").cast("long").alias("depth"), *(at("b_", s, F.col("depth")).alias(f"f{k}") for k, s in enumerate(lanes)), "length", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("_at"))
    return materialize(own.unionByName(taken).withColumn("conv_id", F.col("conv_id").cast(kind)), "trie-rows")


def verified(rows: DataFrame, nodes: DataFrame, turns: DataFrame) -> bool:
    """Whether all stored turns that stand for one node are equal, role and text."""
    several = nodes.where("_refs > 1").select(*_NODE)
    references = rows.where("_at is not null").select(*_NODE, "_at").join(several, _NODE)
    found = references.join(turns.select("_at", "role", "text"), "_at")
    least = found.groupBy(*_NODE).agg(F.min("role").alias("r"), F.max("role").alias("rr"), F.min("text").alias("t"), F.max("text").alias("tt"))
    return least.where("r <> rr or t <> tt").isEmpty()


def _ends(rows: DataFrame) -> DataFrame:
    """Per node at which conversations end: digest of their ids, ascending, joined by commas."""
    keys = [*_NODE, "conv_id"]
    dealt = rows.where("depth = length").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    columns = ", ".join(f"{c} long" for c in _NODE)

    kinds = [(c, pa.int64()) for c in _NODE]

    def table_of(rows: list[tuple], *more: tuple[str, pa.DataType]) -> pa.RecordBatch:
        return batches_of({c: ([r[i] for r in rows], kind) for i, (c, kind) in enumerate([*kinds, *more])})

    def chunks(batches: Batches):
        node, ids = None, []
        for batch in batches:
            done = []
            for *at, conv in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                if ids and (at != node or len(ids) == CHUNK_IDS):
                    done.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = at
                ids.append(conv)
            yield table_of(done, ("first", pa.int64()), ("ids", pa.string()))
        if ids:
            yield table_of([(*node, ids[0], ",".join(map(str, ids)))], ("first", pa.int64()), ("ids", pa.string()))

    def digested(batches: Batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"]), strict=True):
                if at != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield table_of(done, ("ends_sha256", pa.string()))
        if node is not None:
            yield table_of([(*node, digest.hexdigest())], ("ends_sha256", pa.string()))

    chunked = dealt.mapInArrow(chunks, f"{columns}, first long, ids string")
    return chunked.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digested, f"{columns}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, modulus: int = P) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_words of every node."""
    turns = stored_turns(conversations)
    for seed in itertools.count():
        rows = rebuilt_rows(turns, seed, modulus if not seed else P)
        nodes = rows.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("n_words"),
                                         (F.max("length") == F.col("depth")).cast("long").alias("_leaf"), F.count("_at").alias("_refs"))
        nodes = materialize(nodes.withColumn("_saved", (F.col("n_convs") - 1) * F.col("n_words")), "trie-nodes")
        if verified(rows, nodes, turns):
            return _described(rows, nodes)


def _described(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    chains = materialize(nodes.groupBy("conv_id").agg(F.min("depth").alias("_from"), F.sum("_saved").alias("_total"), F.max("_leaf").alias("_leaves")), "trie-chains")
    # what is saved from a node to the end of its chain
    along = running_sums(nodes.select("conv_id", "depth", F.col("_saved").alias("_until"), "_saved"), "conv_id", "depth", ["_until"])
    along = along.select("conv_id", "depth", (F.col("_until") - F.col("_saved")).alias("_spent"))

    paths = rows.select("conv_id", *_NODE).join(chains, "conv_id", "left")
    shares = paths.join(along, ["conv_id", "depth"], "left").groupBy(*_NODE).agg(
        F.sum(F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        F.sum(F.coalesce("_total", F.lit(0)) - F.coalesce("_spent", F.lit(0))).alias("saved_tokens"))

    # only the first node of a chain has a parent in another chain
    above = paths.where("depth = _from - 1").select(F.col("conv_id").alias("_child"), *_NODE).join(nodes.select(*_NODE, "conv_id"), _NODE)
    above = above.select(F.col("_child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_above"))
    placed = nodes.join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id")))
    placed = materialize(placed.drop("_above"), "trie-placed")
    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))

    out = placed.join(shares, _NODE).join(_ends(rows), _NODE, "left").join(children, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "n_words")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))



ORACLE = {"op11_prefix_trie": f"""
WITH turns AS (
 SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS m, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
 SELECT conv_id, list(m ORDER BY turn NULLS FIRST, unhex(sha256(strlen(m.r) || ':' || m.r || m.t))) AS ms,
  CAST({CRC32_SQL.format(c="conv_id")} % 4 AS INTEGER) AS h FROM turns GROUP BY conv_id),
rebuilt AS (
 SELECT o.conv_id, list_concat(coalesce(b.ms, [])[1:o.h], o.ms[o.h + 1:]) AS ms FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, len(ms) AS n, ms, unnest(range(len(ms) + 1)) AS depth FROM rebuilt),
nodes AS (
 SELECT ms[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
  CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(ms[depth].t), '[^\\x20\\x09-\\x0D]+')) END AS n_words
 FROM prefixes GROUP BY 1, 2),
below AS (
 SELECT a.conv_id, a.depth, count(*) FILTER (b.depth = a.depth + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n_words) AS BIGINT) AS saved_tokens
 FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.k[1:a.depth] = a.k GROUP BY a.conv_id, a.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, w.n_children, w.n_leaves, w.saved_tokens, n.ends_sha256, CAST(n.n_words AS BIGINT) AS n_words
FROM nodes n JOIN below w USING (conv_id, depth) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]"""}

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
