"""A change stream applied to document state, micro-batch by micro-batch.

A batch only rewrites the keys it touches: their new rows go to a folder named
by the batch, and the current state is the latest row per key.  Every
``compact_every`` batches the whole state is folded into one base folder, so a
reader never looks at more than that many batches.  The folders follow from the
batch number alone, which makes a repeated batch write the same thing again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replay
from .ingest import batch_folder

COMPACT_EVERY = 20


def distinct_events(changes: DataFrame, delay: str) -> DataFrame:
    """Drop repeats of an event that arrive within ``delay`` of it."""
    timed = changes.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("event_time")
    )


def _read(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.schema(replay.STATE).parquet(folder).withColumn("batch", F.lit(batch))


def state_rows(spark: SparkSession, root: str, upto: int, compact_every: int) -> DataFrame:
    """All state rows that count after batch ``upto`` (-1 for none): base and later batches."""
    base = upto // compact_every * compact_every if upto >= 0 else 0
    parts = []
    if base > 0:
        parts.append(_read(spark, batch_folder(root, "base", base), base))
    first = base + 1 if base > 0 else 0
    parts += [
        _read(spark, batch_folder(root, "state", n), n) for n in range(first, upto + 1)
    ]
    rows = spark.createDataFrame([], f"{replay.STATE}, batch int")
    for part in parts:
        rows = rows.unionByName(part)
    return rows


def latest(rows: DataFrame) -> DataFrame:
    """Newest row per key; one partial aggregate, no sort."""
    newest = rows.groupBy("key").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("row")
    )
    return newest.select("row.*")


def current_state(
    spark: SparkSession, root: str, upto: int, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    return latest(state_rows(spark, root, upto, compact_every))


def apply_changes(
    changes: DataFrame,
    root: str,
    checkpoint: str,
    compact_every: int = COMPACT_EVERY,
    query_name: str = "lorecairn-changes",
) -> StreamingQuery:
    """Fold a command stream ``(key, ts, event_id, op, title, tag)`` into state under ``root``.

    A command that is not after the last one its key has seen in an earlier
    batch is counted as late and does not change the key.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = batch.select("key").distinct()
        before = state_rows(spark, root, number - 1, compact_every).join(keys, "key", "left_semi")
        after = replay.replay(batch, latest(before))
        after.write.mode("overwrite").parquet(batch_folder(root, "state", number))
        if number > 0 and number % compact_every == 0:
            rows = state_rows(spark, root, number - 1, compact_every).unionByName(
                _read(spark, batch_folder(root, "state", number), number)
            )
            latest(rows).write.mode("overwrite").parquet(batch_folder(root, "base", number))

    return (
        changes.writeStream.queryName(query_name)
        .foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
