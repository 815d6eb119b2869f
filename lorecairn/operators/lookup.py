"""Scans, key look-ups, tag look-ups and display projections of documents and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text


def list_topics(topics: DataFrame) -> DataFrame:
    return topics.select("key", "name", "description", "parent_topic").orderBy("name", "key")


def embedding_inventory(docs: DataFrame) -> DataFrame:
    """Key, title and whether the document is embedded; no other column is read."""
    return docs.select("key", "title", F.col("embedding").isNotNull().alias("has_embedding"))


def embedding_coverage(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.count("embedding").alias("with_embedding")
    )


def embedded(docs: DataFrame) -> DataFrame:
    """Documents whose embedding exists and is not empty."""
    return docs.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def get_by_key(table: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per requested key; ``found`` is false and the columns are null when it is missing."""
    # The table is only filtered, which never shuffles rows nobody asked for into the result;
    # the few hits then meet the keys.
    hits = table.join(keys.select("key").distinct(), "key", "left_semi").withColumn("found", F.lit(True))
    return keys.select("key").join(hits, "key", "left").fillna(False, ["found"])


def documents_by_tag(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents carrying exactly the requested tag; one row per document and request."""
    tagged = docs.select("key", "metadata.created", F.explode(F.array_distinct("tags")).alias("tag"))
    return tagged.join(requests.select("tag"), "tag")


def documents_by_normalized_tag(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Like :func:`documents_by_tag` after trimming and lower-casing the request.

    Stored tags keep their case, so a stored tag with capitals is never found.
    """
    asked = requests.select(F.lower(text.strip(F.col("tag"))).alias("tag")).distinct()
    return documents_by_tag(docs, asked)


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created"), "key")


def document_snippets(docs: DataFrame) -> DataFrame:
    return docs.select(
        "key",
        text.snippet(F.col("content")).alias("snippet"),
        text.preview(F.col("summary"), F.col("content")).alias("preview"),
    )
