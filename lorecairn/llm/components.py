"""Connected components and bounded membership filters, shared by the joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Narrow rows for one task of a table that many small steps read.
PART_ROWS = 200_000
#: Size of a membership filter; with more members it lets more rows through, never fewer.
FILTER_BITS = 1 << 26


def few_parts(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows in no more partitions than it needs: every shuffle writes files for each of them."""
    return rows.coalesce(parts_of(rows))


def parts_of(rows: DataFrame) -> int:
    return -(-rows.count() // PART_ROWS) or 1


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` (a, b) is linked with.

    Alternating large and small stars: a node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows.  Each step is a partial
    minimum and an equi join on narrow rows, so a hub is split like any hot key.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut_lineage(links)
    # A step never has many more rows than there are edges.
    parts = parts_of(links)
    links = links.coalesce(parts)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").coalesce(parts).distinct().coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        links = cut_lineage(small.coalesce(parts).distinct().coalesce(parts))
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(parts)
            )
        before = state


def member_bits(members: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit table of the hashes of a long column: a fixed ``bits / 8`` bytes at the driver at most."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (
        members.select(at.alias("at"))
        .groupBy((F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
        .toPandas()
    )
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["value"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def bit_place(column: str, bits: int = FILTER_BITS):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def maybe(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the places from :func:`bit_place` are set."""
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
