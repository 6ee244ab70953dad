"""Merkle dataset manifest by sibling-shift self-joins.

Every row is a leaf: the digest H of its fields. Per source the leaves, ascending by id, form a tree whose
top is the source's subroot; the subroots, ordered by source, form the tree of the root. H is the lowercase
hex SHA-256 of its inputs' texts one after the other.

A level is one equijoin of the nodes with themselves per sibling: the node in slot s of its run of ``ARITY``
looks for the slots s+1, s+2 of the same run (modulo ``ARITY``), by computed positions; slot-zero rows, which
then hold the whole run, emit the parents. Every level is written, a third the size of the one below. The
siblings on a leaf's way to the root are put together from the top down: a node's way is its own siblings and
its parent's way, so upper levels are joined as few rows, never a level per leaf. A source that holds a third
of all rows is dealt by (source, position) like any other.

Defined results: a null source is a source of its own, before all others; leaves with equal ids (null ids
first) are ordered by their digests, so equal rows are interchangeable; a source with one row has that leaf as
its subroot, and a manifest of one source has the subroot as its root; an empty table gives no row. Only the
named columns are read, others may be called anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm.common import materialize, table
from offerscope.llm.sqltext import CRC32_SQL
from offerscope.llm.ordered import number_rows

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of the fields: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _run_digest() -> Column:
    """Digest of the run that a node and its siblings make up."""
    return F.unhex(F.sha2(F.concat(_hex(F.col("_left")), _hex(F.col("_node")), _hex(F.col("_right"))), 256))


def _parents(level: DataFrame) -> DataFrame:
    return level.where(F.col("_pos") % ARITY == 0).select(
        "_group", F.expr(f"_pos div {ARITY}").alias("_pos"), F.expr(f"(_n + {ARITY - 1}) div {ARITY}").alias("_n"), _run_digest().alias("_node"))


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of groups that have several, with the digests left and right of each in its run."""
    nodes = nodes.where("_n > 1").select("_group", "_pos", "_n", "_node")
    slot = F.col("_pos") % ARITY
    out = nodes
    for shift in range(1, ARITY):
        other = nodes.select("_group", F.col("_pos").alias("_at"), F.col("_node").alias(f"_other{shift}"))
        at = F.col("_pos") - slot + (slot + shift) % ARITY
        out = out.withColumn("_at", at).join(other, ["_group", "_at"], "left").drop("_at")
    none = F.lit(b"")
    after = [F.when(slot + shift < ARITY, F.col(f"_other{shift}")) for shift in range(1, ARITY)]
    before = [F.when(slot + shift >= ARITY, F.col(f"_other{shift}")) for shift in range(1, ARITY)]
    return out.select("_group", "_pos", "_n", "_node", F.concat(*(F.coalesce(c, none) for c in before)).alias("_left"),
                      F.concat(*(F.coalesce(c, none) for c in after)).alias("_right"))


class Forest:
    """The trees over numbered nodes (_group, _pos, _n, _node), one per group."""

    def __init__(self, nodes: DataFrame):
        self.levels: list[DataFrame] = []
        most = nodes.agg(F.max("_n")).first()[0] or 0  # one number: the largest group's size
        self.roots = nodes.where("_n = 1").select("_group", "_node", F.lit(0).alias("_height"))
        while most > 1:
            level = materialize(_with_siblings(nodes), "merkle-level")
            self.levels.append(level)
            nodes, most = _parents(level), -(-most // ARITY)
            self.roots = self.roots.unionByName(nodes.where("_n = 1").select("_group", "_node", F.lit(len(self.levels)).alias("_height")))

    def ways(self, tops: DataFrame) -> DataFrame:
        """``_way`` of every leaf (_group, _pos): array of (left, right) digests, level by level. ``tops`` holds the
        ``_height`` of every tree and its way on from there (``_way``); its other columns go along."""
        carried = [c for c in tops.columns if c not in ("_group", "_height", "_way")]

        def arrived(height: int) -> DataFrame:
            return tops.where(F.col("_height") == height).select("_group", F.lit(0).cast("long").alias("_pos"), "_way", *carried)

        above = arrived(len(self.levels))
        for height in reversed(range(len(self.levels))):
            upper = above.withColumnRenamed("_pos", "_up").withColumnRenamed("_way", "_rest")
            level = self.levels[height].withColumn("_up", F.expr(f"_pos div {ARITY}")).join(upper, ["_group", "_up"])
            own = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
            above = level.select("_group", "_pos", F.concat(own, F.col("_rest")).alias("_way"), *carried).unionByName(arrived(height))
        return above


def fold(leaf: Column, way: Column | str) -> Column:
    """The root that a leaf's digest (hex) leads to by the siblings of its way."""
    return F.aggregate(way, leaf, lambda node, step: F.sha2(F.concat(_hex(step["left"]), node, _hex(step["right"])), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``proof_sha256`` is H of the siblings on the way from the leaf to the root. ``claim`` is the leaf digest that is
    checked against the manifest (the row's own, if left out): ``folded_root`` is where it leads by the row's siblings.
    """
    own = leaf_digest([F.col(c) for c in fields])
    name = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first
    narrow = docs.select(F.col(key).alias("_key"), name.alias("_group"), F.unhex(own).alias("_node"), F.unhex(own if claim is None else claim).alias("_claim"))
    narrow = materialize(narrow, "merkle-leaves")  # whole texts are read once, not again for the ranges
    leaves = materialize(number_rows(narrow, "_group", [F.asc_nulls_first("_key"), F.asc("_node")], "merkle-dealt"), "merkle-numbered")
    sources = Forest(leaves)

    subroots = materialize(sources.roots, "merkle-subroots").select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_node", F.col("_height").alias("_below"))
    named = materialize(number_rows(subroots, "_group", [F.asc("_name")], "merkle-names"), "merkle-named")
    top = Forest(named)
    root = top.roots.first()  # one row at most
    step = "array<struct<left:binary,right:binary>>"
    ways = top.ways(top.roots.select("_group", "_height", F.array().cast(step).alias("_way")))
    tops = named.join(ways, ["_group", "_pos"]).select(F.col("_name").alias("_group"), F.col("_below").alias("_height"), "_way", F.col("_node").alias("_subroot"))

    rows = leaves.select("_key", "_group", "_pos", "_node", "_claim").join(sources.ways(materialize(tops, "merkle-tops")), ["_group", "_pos"])
    siblings = F.array_join(F.transform("_way", lambda step: _hex(F.concat(step["left"], step["right"]))), "")
    rows = rows.select(F.col("_key").alias(key), _hex(F.col("_node")).alias("leaf"), _hex(F.col("_subroot")).alias("subroot"), F.lit(root and bytes(root["_node"]).hex()).cast("string").alias("root"),
                       F.sha2(siblings, 256).alias("proof_sha256"), fold(_hex(F.col("_claim")), "_way").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, by the CRC-32 of its id, is checked with the line ends of its text deleted."""
    docs = table(spark, sf_dir, "documents")
    claimed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, claim=F.when(tampered, leaf_digest(claimed)).otherwise(leaf_digest([F.col(c) for c in FIELDS])))



_FIELD = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_H = "sha256(" + " || ".join(_FIELD.format(c=c) for c in FIELDS[:-1]) + " || {text})"
_SIBLINGS = "coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos {side} l.pos // pow3), '')"

ORACLE = {"op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
 SELECT doc_id, coalesce('1' || source, '0') AS g, {_H.format(text=_FIELD.format(c="text"))} AS leaf,
  CASE WHEN {CRC32_SQL.format(c="doc_id")} % 2 = 0 THEN {_H.format(text=_FIELD.format(c="replace(text, chr(10), '')"))} END AS changed
 FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes(g, level, pos, n, d) AS (
 SELECT g, 0, pos, n, leaf FROM numbered
 UNION ALL SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 3, n),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, d) AS (
 SELECT 0, pos, n, d FROM subroots
 UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (
 SELECT l.g, l.pos, o.level AS step, {_SIBLINGS.format(side="<")} AS l, {_SIBLINGS.format(side=">")} AS r
 FROM numbered l JOIN (SELECT *, CAST(pow(3, level) AS BIGINT) AS pow3 FROM nodes WHERE n > 1) o ON o.g = l.g AND o.pos // 3 = l.pos // pow3 // 3
 GROUP BY l.g, l.pos, o.level
 UNION ALL
 SELECT l.g, NULL, 1000 + o.level, {_SIBLINGS.format(side="<")}, {_SIBLINGS.format(side=">")}
 FROM subroots l JOIN (SELECT *, CAST(pow(3, level) AS BIGINT) AS pow3 FROM tops WHERE n > 1) o ON o.pos // 3 = l.pos // pow3 // 3
 GROUP BY l.g, l.pos, o.level),
ways AS (
 SELECT n.g, n.pos, coalesce(list(struct_pack(l := s.l, r := s.r) ORDER BY s.step) FILTER (s.step IS NOT NULL), []) AS way
 FROM numbered n LEFT JOIN steps s ON s.g = n.g AND (s.pos = n.pos OR s.pos IS NULL) GROUP BY n.g, n.pos),
proved AS (
 SELECT n.doc_id, n.leaf, u.d AS subroot, t.d AS root, sha256(array_to_string(list_transform(w.way, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(l := coalesce(n.changed, n.leaf), r := ''), w.way), lambda a, s: struct_pack(l := sha256(s.l || a.l || s.r), r := '')).l AS folded_root
 FROM numbered n JOIN ways w USING (g, pos) JOIN subroots u ON u.g = n.g JOIN tops t ON t.n = 1)
SELECT *, folded_root = root AS verified FROM proved"""}

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
