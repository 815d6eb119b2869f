"""Merkle manifest of a table: one hash tree per source, and one over the sources' roots.

*Leaves.*  A leaf hashes the row's columns in a fixed order, each as ``-`` if null, else
its UTF-8 byte count, a colon and its value.  Leaves of a source are numbered by
ascending id (null ids first, rows of one id by their hash): a range partitioning by source,
id and hash sorts them, and the counts of each (source, partition) say where its
numbers begin.  A source of any size is spread over the partitions.

*Levels.*  On every level each node finds its siblings by equijoins of the level with
itself on (tree, index of the sibling): the index with its last bit flipped for binary
trees, the index at the next slots of its run otherwise.  The rows of slot zero, which
hold their whole run, emit the parents.  A tree ends when one node remains.

*Proofs.*  Paths go down from the roots: the path of a node is its siblings followed by the
path of its parent, so the long paths are only joined once, one third (or half) as many as
there are leaves.  A path is an array of (before, after): the digests of the run to
the left and to the right of the node.

Levels and paths are written as tables and read again: a checkpoint would hand on the planner's guess at
a join's size, a product that grows beyond any number within ten levels of joins.

Digests travel as 32 bytes and are hashed as lower-case hex text.  Rows of null source are a
tree of their own, before all others; repeated rows are leaves of their own.  The root of an empty
table does not exist and its manifest has no rows.  A text goes through one hash and leaves its
row at the scan, so long texts cost nothing further.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Mapping[str, Column] | None = None) -> Column:
    """Digest (32 bytes) of the columns of a row; ``values`` stand in for columns of their names."""
    shown = []
    for name in COLUMNS:
        value = (values or {}).get(name, F.col(name)).cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*shown), 256))


def _nothing() -> Column:
    return F.lit(b"")


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _node(digests: Column) -> Column:
    return F.unhex(F.sha2(hexed(digests), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx, the place in ``tree`` by ``order`` from 0, and n, the rows of the tree."""
    dealt = cut_lineage(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order))
    placed = dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    # One row per tree and partition that holds some of it.
    parts = placed.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(
        "tree", "__part", (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(tree).alias("n")
    )
    return placed.join(shifts, ["tree", "__part"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift", "__first")


def _with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Nodes of a level (tree, idx, n, digest) with the digests before and after them in their run."""
    idx, slot = F.col("idx"), F.pmod(F.col("idx"), F.lit(arity))
    found = level
    for shift in range(1, arity):
        sibling = idx.bitwiseXOR(F.lit(1)) if arity == 2 else idx - slot + F.pmod(idx + shift, F.lit(arity))
        others = level.select("tree", F.col("idx").alias("__place"), F.col("digest").alias(f"__{shift}"))
        found = found.withColumn("__place", sibling).join(others, ["tree", "__place"], "left").drop("__place")

    def at(place: int) -> Column:
        """The sibling in a slot, or nothing where the run is shorter."""
        return F.coalesce(*[F.when(F.pmod(idx + shift, F.lit(arity)) == place, F.col(f"__{shift}")) for shift in range(1, arity)], _nothing())

    before = F.concat(*[F.when(slot > place, at(place)).otherwise(_nothing()) for place in range(arity - 1)])
    after = F.concat(*[F.when(slot < place, at(place)).otherwise(_nothing()) for place in range(1, arity)])
    return found.select("tree", "idx", "n", "digest", before.alias("before"), after.alias("after"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    first = level.where(F.pmod("idx", F.lit(arity)) == 0)
    return first.select(
        "tree",
        F.expr(f"idx div {arity}").alias("idx"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        _node(F.concat("digest", "after")).alias("digest"),
    )


def grow(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels with siblings, lowest first, and the roots (tree, level, idx, digest).

    There are as many levels as the largest tree is deep; each level is written once.
    """
    levels, roots = [], []
    level = nodes.select("tree", "idx", "n", "digest")
    while True:
        roots.append(level.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "idx", "digest"))
        several = level.where("n > 1")
        if several.isEmpty():
            break
        levels.append(written(_with_siblings(several, arity), "level"))
        level = _parents(levels[-1], arity)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, written(found, "roots")


def paths(levels: list[DataFrame], seeds: DataFrame, arity: int) -> DataFrame:
    """tree, idx, root, path of every node of the lowest level; ``seeds`` (tree, level, idx, root, path) are the roots."""

    def seeded(level: int) -> DataFrame:
        return seeds.where(F.col("level") == level).select("tree", "idx", "root", "path")

    known = seeded(len(levels))
    for level in reversed(range(len(levels))):
        own = levels[level].select("tree", "idx", F.expr(f"idx div {arity}").alias("__up"), "before", "after")
        above = known.select("tree", F.col("idx").alias("__up"), "root", "path")
        path = F.concat(F.array(F.struct("before", "after")), F.col("path"))
        known = own.join(above, ["tree", "__up"]).select("tree", "idx", "root", path.alias("path"))
        known = known.unionByName(seeded(level))
        if level > 1:
            # Long chains of joins are slow to plan; the two largest levels are not worth writing.
            known = written(known, "paths")
    return known


def manifest(docs: DataFrame, arity: int = 3, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row, with the columns ``carry`` names.

    ``docs`` has the columns of :data:`COLUMNS`; others are not read.  Digests are
    binary.  ``path`` leads from the leaf to the subroot and on to the root.
    """
    if arity < 2:
        raise ValueError("a node needs room for two")
    carried = [value.alias(name) for name, value in (carry or {}).items()]
    # The name of a tree sorts like its source, with null first.
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = docs.select(tree.alias("tree"), "doc_id", "source", leaf().alias("digest"), *carried)
    leaves = cut_lineage(numbered(rows, "doc_id", "digest"))
    levels, subroots = grow(leaves, arity)

    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("named"), "digest")
    sources = cut_lineage(numbered(sources, "named"))
    upper, top = grow(sources, arity)
    root = top.first()
    over = paths(upper, top.select("tree", "level", "idx", F.col("digest").alias("root"), F.array().cast("array<struct<before:binary,after:binary>>").alias("path")), arity)
    above = sources.select("named", "idx").join(over.select("idx", "path"), "idx").select(F.col("named").alias("tree"), "path")
    seeds = written(subroots.join(above, "tree").select("tree", "level", "idx", F.col("digest").alias("root"), "path"), "paths")
    found = leaves.drop("n").join(paths(levels, seeds, arity).withColumnRenamed("root", "subroot"), ["tree", "idx"])
    whole = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", whole.alias("root"), "path", *(carry or {}))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf leads to, as hex text."""
    return F.aggregate(path, hexed(digest), lambda h, s: F.sha2(F.concat(hexed(s["before"]), h, hexed(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on a path, as hex text."""
    siblings = F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"])))
    return F.sha2(F.array_join(siblings, ""), 256)
