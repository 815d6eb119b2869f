"""Mixing sources to target weights with hash thresholds, in DataFrame functions only.

Every document has a fixed hash.  A source's words are summed by hash bucket;
the running sums show in which bucket its budget ends, and only that bucket is
summed again by the next bits of the hash, until the threshold is exact.  A
document is in if its hash is below its source's threshold: no sort of the
documents, and a larger budget always holds what a smaller one does.

A budget that ends inside a document leaves a rest.  It is filled in further
rounds from the documents behind the threshold that are no larger than the rest,
until none is left that fits.  The document at a threshold is larger than the rest
and out for good, so every round has fewer documents.  Documents are taken whole.

Sources are ordered by code point, null last.  Null and empty texts have size 0
and are never taken.  Repeated rows (same id and text) share a hash: they are
taken together or not at all.  Without words every target is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import WORD

BITS, LEVELS = 16, 3
#: As many sources at most are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
_TOP = 1 << (BITS * LEVELS)


def size_column() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def hash_column() -> Column:
    """Non-negative hash of ``BITS * LEVELS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 64 - BITS * LEVELS)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number`` from 0 in the given order, counted per sorted partition and then shifted.

    What meets in one task is one row per partition, never the table.
    """
    placed = cut_lineage(df.orderBy(*order)).withColumn("part", F.spark_partition_id())
    sizes = placed.groupBy("part").count()
    shifts = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return (
        placed.withColumn("within", within)
        .join(shifts, "part")
        .withColumn("number", F.col("within") + F.col("shift"))
        .drop("part", "within", "shift")
    )


def targets(totals: DataFrame, share: float, most: float, cycle: tuple[int, ...]) -> DataFrame:
    """One row per source: source, source_size, number, weight, target.

    All targets together are ``share`` times all sizes, dealt by weight; a
    target stops at ``most`` times its source's size and the excess is dealt again.
    Each round stops at least one more source, and rounds need two sums each.
    """
    sources = numbered(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("number") % len(cycle) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight.cast("double")))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    # A source is full once the level - words per weight - would lift it above its stop.
    stop = most * F.col("source_size")
    level, full = 0.0, -1
    while True:
        held = F.col("weight") * level > stop if full >= 0 else F.lit(False)
        row = sources.agg(
            F.count(F.when(held, 1)).alias("full"),
            F.coalesce(F.sum(F.when(held, stop)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row["full"] == full or row["weight"] == 0:
            break
        full, level = row["full"], max(level, (budget - row["used"]) / row["weight"])
    return sources.withColumn("target", F.least(F.col("weight") * level, stop))


def _threshold(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """number, upto, rest: rows with a hash below ``upto`` fit the budget, which then has ``rest`` words left."""
    # A level's state: the buckets before ``prefix`` are in, ``rest`` words are left for bucket ``prefix``.
    state = budgets.select("number", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    running = Window.partitionBy("number").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        sums = (
            rows.join(F.broadcast(state) if few else state, "number")
            .where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
            .groupBy("number", "rest", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
            .withColumn("sum", F.sum("words").over(running))
            .groupBy("number")
            .agg(
                F.min(F.when(F.col("sum") > F.col("rest"), F.col("bucket"))).alias("over"),
                F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("inside"),
            )
        )
        state = state.join(sums, "number", "left").select(
            "number",
            F.coalesce("over", F.shiftleft(F.col("prefix") + 1, BITS)).alias("prefix"),
            (F.col("rest") - F.coalesce("inside", F.lit(0))).alias("rest"),
        )
        # A row per source; without the cut every level would compute those before it again.
        state = cut_lineage(state)
    return state.withColumnRenamed("prefix", "upto")


@dataclass
class Mix:
    """One row per source - source, source_size, target, copies and thresholds - and how many rounds they hold."""

    sources: DataFrame
    rounds: int
    broadcast: bool

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with size, source_size, target and copies (whole copies that the mix takes); other columns stay."""
        own = ("size", "source_size", "target", "copies")
        kept = [c for c in docs.columns if c.lower() not in own]
        made = docs.select(*kept, size_column().alias("size"), hash_column().alias("__hash"))
        table = self.sources.withColumnRenamed("source", "__source")
        rows = made.join(F.broadcast(table) if self.broadcast else table, made["source"].eqNullSafe(table["__source"]))
        extra, behind = F.lit(0), F.lit(True)
        for k in range(self.rounds):
            small = (F.col("size") <= F.col(f"__rest{k}")) & behind
            extra = extra + F.when(small & (F.col("__hash") < F.col(f"__upto{k}")), 1).otherwise(0)
            behind = behind & (F.col("__hash") > F.col(f"__upto{k}"))
        copies = F.when(F.col("size") > 0, F.col("__copies") + extra).otherwise(0)
        return rows.select(*kept, "size", "source_size", "target", copies.cast("int").alias("copies"))


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2)) -> Mix:
    """Find the targets and the thresholds from all documents; only narrow rows are kept for it."""
    narrow = cut_lineage(docs.select("source", size_column().alias("size"), hash_column().alias("hash")))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = targets(totals, share, most, cycle)
    # Whole copies of a source first; the thresholds deal what is left, less than one copy.
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    table = table.withColumn("__copies", copies.cast("long"))
    budget = F.floor(F.col("target") - F.col("__copies") * F.col("source_size") + F.lit(1e-6)).cast("long")
    table = cut_lineage(table.withColumn("budget", budget))
    few = table.count() <= BROADCAST_SOURCES
    small = F.broadcast(table) if few else table
    rows = narrow.where("size > 0").join(small, narrow["source"].eqNullSafe(small["source"])).select("number", "size", "hash")
    rows = cut_lineage(rows)
    # In a round only documents no larger than the rest count; in the first, the rest is the budget itself.
    budgets = table.select("number", "budget")
    left = rows.join(F.broadcast(budgets) if few else budgets, "number").where("size <= budget")
    found, k = table, 0
    while True:
        ends = _threshold(left.select("number", "size", "hash"), budgets, few)
        found = found.join(
            budgets.join(ends, "number").select("number", F.col("upto").alias(f"__upto{k}"), F.col("budget").alias(f"__rest{k}")),
            "number",
        )
        budgets = ends.select("number", F.col("rest").alias("budget"))
        step = ends.select("number", "upto", F.col("rest").alias("left"))
        left = cut_lineage(
            left.select("number", "size", "hash")
            .join(F.broadcast(step) if few else step, "number")
            .where("hash > upto and size <= left")
        )
        k += 1
        if left.isEmpty():
            return Mix(cut_lineage(found.drop("number", "weight", "budget")), k, few)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: each document as often as the mix takes it, columns unchanged."""
    columns = docs.columns
    return (
        plan(docs, **options)
        .apply(docs)
        .where("copies > 0")
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .select(*columns)
    )
