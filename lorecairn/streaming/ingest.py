"""Streaming ingest of documents and live tag counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import maintain, suggest
from ..sources.tables import conform, read_documents, read_links


def batch_folder(root: str, table: str, batch: int) -> str:
    """Folder of one micro-batch; writing it again replaces it, so a retry adds nothing."""
    return f"{root}/{table}/batch={batch:012d}"


def ingest(
    commands: DataFrame,
    topics: DataFrame,
    root: str,
    checkpoint: str,
    now: str,
    query_name: str = "lorecairn-ingest",
) -> StreamingQuery:
    """Store a stream of store commands: documents, topic links and outcomes.

    The embedding and the topic check are those of the batch job.  Every
    micro-batch writes its own folders under ``root``.
    """

    def store(batch: DataFrame, number: int) -> None:
        change = maintain.store_documents(batch, topics, now)
        for table, rows, schema in (
            ("documents", change.documents, schemas.DOCUMENTS),
            ("links", change.links, schemas.RELATIONSHIPS),
        ):
            conform(rows, schema).write.mode("overwrite").parquet(
                batch_folder(root, table, number)
            )
        change.outcomes.write.mode("overwrite").parquet(batch_folder(root, "outcomes", number))

    return (
        commands.writeStream.queryName(query_name)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    return read_documents(spark, f"{root}/documents")


def stored_links(spark: SparkSession, root: str) -> DataFrame:
    return read_links(spark, f"{root}/links")


def live_tag_counts(documents: DataFrame) -> DataFrame:
    """Running tag counts of a document stream; write it in complete or update mode."""
    return suggest.tag_counts(documents)
