"""A Merkle manifest of a dataset, with proofs from parents' preimages.

Each row is a leaf: the digest of its columns. The leaves of a source ascend by id; every 16
consecutive nodes become one parent until one node is left, the subroot; subroots ascend by source
and become the root in the same way. What is stored of a parent is its preimage, the digests of
its children one after the other. A leaf joins the preimages of its ancestors: with its own 64
characters cut out they are its siblings, with a replacement put in they fold to the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lookup, materialize, spread, table

#: Characters of a digest in hex.
DIGEST = 64

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encode(c: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else the number of its UTF-8 bytes, ``:`` and itself."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encode(c) for c in columns]), 256)


def excise(preimage: Column, slot: Column) -> Column:
    """The siblings: a preimage without the digest in a slot (from 0)."""
    return F.concat(F.substring(preimage, F.lit(1), slot * DIGEST), F.substring(preimage, (slot + 1) * DIGEST + 1, F.length(preimage)))


def splice(preimage: Column, slot: Column, digest: Column) -> Column:
    """A preimage with another digest in a slot."""
    return F.concat(F.substring(preimage, F.lit(1), slot * DIGEST), digest, F.substring(preimage, (slot + 1) * DIGEST + 1, F.length(preimage)))


def siblings(path: Column) -> Column:
    """All siblings on a path (array of preimage, slot from the leaf upward), one after the other."""
    return F.array_join(F.transform(path, lambda p: excise(p.preimage, p.slot)), "")


def fold(path: Column, digest: Column) -> Column:
    """The root that a digest gives with the siblings on a path."""
    return F.aggregate(path, digest, lambda found, p: F.sha2(splice(p.preimage, p.slot, found), 256))


def number(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add idx, the place from 0 in its tree, and n, the nodes of the tree.

    Rows are dealt by range of (tree, order), so a tree of a third of all rows takes many tasks;
    places inside a task are shifted by what the tasks before hold of the tree.
    """
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    each = Window.partitionBy("tree")
    earlier = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select("tree", "part", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(each).alias("n")), "runs")
    return lookup(dealt, runs, ["tree", "part"], "inner", salts=1).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """tree, idx, n, preimage, hash of the next level; trees of one node are done."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run"), F.max("n").alias("n"))
    preimage = F.array_join(F.transform("run", lambda x: x.hash), "")
    rows = runs.select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), preimage.alias("preimage"))
    return rows.withColumn("hash", F.sha2("preimage", 256))


def levels_above(nodes: DataFrame, fanout: int = 16) -> list[DataFrame]:
    """The levels over numbered nodes, each materialized, until every tree is one node."""
    out: list[DataFrame] = []
    largest = nodes.agg(F.max("n")).first()[0] or 0
    below = nodes
    while largest > 1:
        below = materialize(_parents(below, fanout), "parents")
        out.append(below)
        largest = -(-largest // fanout)
    return out


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, hash: the last node of each tree."""
    out = nodes.where("n = 1").select("tree", "hash")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("tree", "hash"))
    return out


def with_paths(nodes: DataFrame, levels: list[DataFrame], top: DataFrame, fanout: int = 16) -> DataFrame:
    """The nodes with the columns of top (a row a tree: tree, path, and others), the path begun by their own ancestors.

    A path goes down a level at a time, so a level's rows meet the preimages of one level and what
    their parents carry, at most ``fanout`` rows to each.
    """
    carried = [c for c in top.columns if c not in ("tree", "path")]
    above = None
    for level in [*reversed(levels), nodes]:
        own = [c for c in level.columns if c != "tree"]
        found = level.where("n = 1").join(top, "tree").select("tree", *own, *carried, "path")
        if above is not None:
            up = above.select("tree", F.col("idx").alias("up"), F.col("preimage").alias("above"), F.col("path").alias("rest"), *carried)
            rows = level.where("n > 1").withColumn("up", F.floor(F.col("idx") / fanout)).join(up, ["tree", "up"])
            step = F.struct(F.col("above").alias("preimage"), F.pmod("idx", F.lit(fanout)).cast("int").alias("slot"))
            found = found.unionByName(rows.select("tree", *own, *carried, F.concat(F.array(step), F.col("rest")).alias("path")))
        above = found
    return above


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, idx, n, hash, id and kept columns; levels: their parents; top: tree, subroot, root and the path from subroot to root."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: DataFrame
    fanout: int

    def proofs(self) -> DataFrame:
        """Each leaf with subroot, root and path (preimage and slot of each ancestor, upward)."""
        return with_paths(self.leaves, self.levels, self.top, self.fanout).drop("idx", "n", "tree")


def manifest(docs: DataFrame, id: str = "doc_id", source: str = "source", columns: tuple[str, ...] = LEAF_COLUMNS, keep: dict[str, Column] | None = None, fanout: int = 16) -> Manifest:
    """The trees over docs. keep: further columns of the leaves, by name, computed from docs beside the digest.

    Every row is a leaf, whatever is null in it: the null source is a tree of its own and comes
    first, null ids come first in it, empty texts differ from null ones. Rows with one id follow each other by
    digest, repeated rows are leaves each. An empty table has no leaf and no root. Other columns of
    docs are not read; only digests are shuffled, never texts.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit(""))
    leaves = spread(docs).select(tree.alias("tree"), F.col(f"`{id}`").alias("id"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("hash"), *[c.alias(n) for n, c in (keep or {}).items()])
    leaves = materialize(number(materialize(leaves, "digests"), ["id", "hash"]), "numbered")  # texts are read and hashed once
    levels = levels_above(leaves, fanout)
    roots = tops(leaves, levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    roots = materialize(number(roots, ["of"]), "subroots")
    over = levels_above(roots, fanout)
    last = tops(roots, over).select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<preimage:string,slot:int>>").alias("path"))
    top = with_paths(roots, over, last, fanout).select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    return Manifest(leaves, levels, materialize(top, "tops"), fanout)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = manifest(docs, keep={"altered": F.when(hit, altered)}).proofs()
    got = got.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("altered", "hash")).alias("folded_root"),
    )
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_encode(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_SQL_LEAF = "sha256(" + " || ".join(_sql_encode(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_SQL_UP = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"

OP12_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT *, {_SQL_LEAF.format(text=_sql_encode("text"))} AS leaf,
    {_SQL_LEAF.format(text=_sql_encode("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} AS low FROM documents
), crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, _i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), ranked AS (
  SELECT d.*, coalesce(xor(c, 4294967295) % 5 = 0, false) AS hit, row_number() OVER (PARTITION BY source ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS r
  FROM doc d LEFT JOIN crc USING (doc_id)
), up AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY r) AS nodes FROM ranked GROUP BY source
  UNION ALL SELECT source, lvl + 1, {_SQL_UP} FROM up WHERE len(nodes) > 1
), sub AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sr, lvl AS height FROM up WHERE len(nodes) = 1
), over AS (
  SELECT 0 AS lvl, list(subroot ORDER BY sr) AS nodes FROM sub
  UNION ALL SELECT lvl + 1, {_SQL_UP} FROM over WHERE len(nodes) > 1
), step AS (
  SELECT r.source, r.r, u.lvl, (r.r // (16 ** u.lvl)::BIGINT) AS place, u.nodes FROM ranked r JOIN up u ON r.source IS NOT DISTINCT FROM u.source AND len(u.nodes) > 1
  UNION ALL
  SELECT r.source, r.r, s.height + o.lvl, (s.sr // (16 ** o.lvl)::BIGINT), o.nodes FROM ranked r JOIN sub s ON r.source IS NOT DISTINCT FROM s.source JOIN over o ON len(o.nodes) > 1
), side AS (
  SELECT source, r, lvl, array_to_string(nodes[place // 16 * 16 + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place // 16 * 16 + 16], '') AS after FROM step
), proof AS (
  SELECT source, r, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM side GROUP BY source, r
), folded AS (
  SELECT source, r, 0 AS lvl, CASE WHEN hit THEN low ELSE leaf END AS h FROM ranked
  UNION ALL SELECT f.source, f.r, f.lvl + 1, sha256(s.before || f.h || s.after) FROM folded f JOIN side s ON s.source IS NOT DISTINCT FROM f.source AND s.r = f.r AND s.lvl = f.lvl
), ended AS (SELECT source, r, arg_max(h, lvl) AS h FROM folded GROUP BY source, r)
SELECT d.doc_id, d.leaf, s.subroot, o.nodes[1] AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = o.nodes[1] AS verified
FROM ranked d JOIN sub s ON d.source IS NOT DISTINCT FROM s.source JOIN over o ON len(o.nodes) = 1
JOIN ended e ON d.source IS NOT DISTINCT FROM e.source AND d.r = e.r LEFT JOIN proof p ON d.source IS NOT DISTINCT FROM p.source AND d.r = p.r
"""
