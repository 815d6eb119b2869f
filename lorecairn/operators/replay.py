"""Replay of ordered command logs, and folding of several commands per key.

Nothing here orders all commands of a key in one task.  The log is cut into ranges
of (key, ts, event_id); one row per key and range carries the state into the
next range, and everything after that is an aggregate with a map-side part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: State of a key after a replay.
STATE = (
    "key string, live boolean, version int, title string, tags array<string>, "
    "applied long, rejected long, not_found long, late long, "
    "last_ts timestamp_ntz, last_event long"
)

UPDATES = ("set_title", "add_tag", "remove_tag")


def fold_tag_operations(operations: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Net effect per key of ordered tag operations ``(key, tag, adds, at)``.

    Gives ``removed``, the tags removed at some point, and ``added``, the tags
    whose last operation adds them, in the order they came back.  With ``held``
    ``(key, tag)``, the tags before the operations, only those appear in ``removed``, so
    that no list is longer than the tags of a document.
    """
    removed_at = operations.groupBy("key", "tag").agg(
        F.max(F.when(~F.col("adds"), F.col("at"))).alias("removed_at")
    )
    # Joined back on (key, tag): the aggregated side has one row per pair.
    added_at = (
        operations.where("adds")
        .join(removed_at, ["key", "tag"])
        .where(F.col("removed_at").isNull() | (F.col("at") > F.col("removed_at")))
        .groupBy("key", "tag")
        .agg(F.min("at").alias("added_at"))
    )
    net = removed_at.join(added_at, ["key", "tag"], "left")
    if held is not None:
        known = held.select("key", "tag", F.lit(True).alias("held")).distinct()
        net = net.join(known, ["key", "tag"], "left").where("held or added_at is not null")
    # One entry per tag that the key has before or after.
    return net.groupBy("key").agg(
        F.collect_list(F.when(F.col("removed_at").isNotNull(), F.col("tag"))).alias("removed"),
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("added_at").isNotNull(), F.struct("added_at", F.col("tag").alias("tag"))
                    )
                )
            ),
            lambda entry: entry["tag"],
        ).alias("added"),
    )


def apply_tag_changes(tags: Column, removed: Column, added: Column) -> Column:
    """Tags after the folded operations; order and duplicates of kept tags stay."""
    none = F.array().cast("array<string>")
    gone, fresh = F.coalesce(removed, none), F.coalesce(added, none)
    kept = F.filter(tags, lambda t: ~F.array_contains(gone, t))
    return F.concat(kept, F.filter(fresh, lambda t: ~F.array_contains(kept, t)))


def judge(commands: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add ``status`` to every command ``(key, ts, event_id, op, title, tag)``.

    A key starts dead.  An insert on a live key is rejected; an update or
    delete on a dead key is not_found.  With ``state`` the keys continue from
    there, and commands not after a key's last one are late.

    A command maps the liveness before it to the one after it: an insert and a delete
    to a constant, all others to itself.  These maps compose, so the log is dealt by
    ranges of (key, ts, event_id) of about equal size, each range composes its own
    part of a key, and a scan over one row per (key, range) carries the liveness
    into every range.  A key of any number of commands, also of one instant, takes as many
    ranges as its size needs.
    """
    at = F.struct("ts", "event_id")
    log = commands.withColumn("at", at).withColumn(
        "starts", F.when(F.col("op") == "insert", True).when(F.col("op") == "delete", False)
    )
    if state is not None:
        before = state.select(
            "key",
            F.col("live").alias("live_before_log"),
            F.struct(F.col("last_ts").alias("ts"), F.col("last_event").alias("event_id")).alias("last_at"),
        )
        log = log.join(before, "key", "left").withColumn(
            "is_late", F.coalesce(F.col("at") <= F.col("last_at"), F.lit(False))
        )
    else:
        log = log.withColumn("live_before_log", F.lit(False)).withColumn("is_late", F.lit(False))
    log = log.withColumn("starts", F.when(~F.col("is_late"), F.col("starts"))).drop("last_at")

    dealt = cut_lineage(log.repartitionByRange("key", "ts", "event_id"))
    placed = dealt.withColumn("range", F.spark_partition_id())
    composed = placed.groupBy("key", "range").agg(
        F.max_by("starts", F.when(F.col("starts").isNotNull(), F.col("at"))).alias("composed")
    )
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = composed.select(
        "key", "range", F.last("composed", ignorenulls=True).over(earlier).alias("carried")
    )
    within = (
        Window.partitionBy("key", "range")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    live = F.coalesce(
        F.last("starts", ignorenulls=True).over(within),
        F.col("carried"),
        F.col("live_before_log"),
        F.lit(False),
    )
    status = (
        F.when(F.col("is_late"), "late")
        .when((F.col("op") == "insert") & F.col("live"), "rejected")
        .when((F.col("op") != "insert") & ~F.col("live"), "not_found")
        .otherwise("applied")
    )
    return (
        placed.join(carried, ["key", "range"])
        .withColumn("live", live)
        .withColumn("status", status)
        .select("key", "ts", "event_id", "at", "op", "title", "tag", "status", "range")
    )


def replay(commands: DataFrame, state: DataFrame | None = None, chunk: str | None = None) -> DataFrame:
    """Final state of every key that appears in ``commands``, in the columns of ``STATE``.

    ``chunk`` is accepted from earlier callers and has no effect: the log is cut by size.

    Version counts 1 for the last effective insert plus one per update applied
    since.  A deleted key keeps the values it had.
    """
    # Four aggregates below read the judged log, so it is computed once.
    judged = cut_lineage(judge(commands, state))
    applied = F.col("status") == "applied"
    is_insert = applied & (F.col("op") == "insert")
    is_end = applied & F.col("op").isin("insert", "delete")

    def times(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    summary = judged.groupBy("key").agg(
        F.max(F.when(is_insert, F.col("at"))).alias("inserted_at"),
        F.max_by(F.col("op") == "insert", F.when(is_end, F.col("at"))).alias("ends_live"),
        F.max(F.when(F.col("status") != "late", F.col("at"))).alias("last_at"),
        *[times(s) for s in ("applied", "rejected", "not_found", "late")],
    )
    current = judged.where(applied).join(summary.select("key", "inserted_at"), "key").where(
        F.col("inserted_at").isNull() | (F.col("at") >= F.col("inserted_at"))
    )
    values = current.groupBy("key").agg(
        F.count(F.when(F.col("op").isin(*UPDATES), 1)).alias("updates"),
        F.max_by(
            "title", F.when(F.col("op").isin("insert", "set_title"), F.col("at"))
        ).alias("new_title"),
    )
    tag_changes = fold_tag_operations(
        current.where(F.col("op").isin("add_tag", "remove_tag")).select(
            "key", "tag", (F.col("op") == "add_tag").alias("adds"), "at"
        ),
        held=summary.select("key", F.lit(None).cast("string").alias("tag")).limit(0)
        if state is None
        else state.select("key", F.explode("tags").alias("tag")),
    )
    result = summary.join(values, "key", "left").join(tag_changes, "key", "left")
    if state is not None:
        result = result.join(state.select("key", F.struct(*STATE_COLUMNS).alias("old")), "key", "left")
    else:
        result = result.withColumn("old", F.lit(None).cast(f"struct<{_state_struct()}>"))
    continued = F.col("inserted_at").isNull()
    none = F.array().cast("array<string>")

    def plus(name: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(f"old.{name}"), F.lit(0))).alias(name)

    return result.select(
        "key",
        F.coalesce("ends_live", "old.live", F.lit(False)).alias("live"),
        (
            F.when(continued, F.coalesce(F.col("old.version"), F.lit(0))).otherwise(1)
            + F.coalesce("updates", F.lit(0))
        )
        .cast("int")
        .alias("version"),
        F.when(continued, F.coalesce("new_title", "old.title"))
        .otherwise(F.col("new_title"))
        .alias("title"),
        apply_tag_changes(
            F.when(continued, F.coalesce(F.col("old.tags"), none)).otherwise(none),
            F.col("removed"),
            F.col("added"),
        ).alias("tags"),
        *[plus(s) for s in ("applied", "rejected", "not_found", "late")],
        F.coalesce("last_at.ts", "old.last_ts").alias("last_ts"),
        F.coalesce("last_at.event_id", "old.last_event").alias("last_event"),
    )


STATE_COLUMNS = [part.strip().split(" ")[0] for part in STATE.split(", ")]


def _state_struct() -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in STATE.split(", "))
