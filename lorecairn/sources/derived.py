"""Knowledge-base tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..session import spread

# Declared types of the columns read; nothing is inferred.
_RAW = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}
_OPERATIONS = {
    "signup": "insert",
    "view": "set_title",
    "click": "add_tag",
    "purchase": "remove_tag",
    "error": "delete",
}


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(_RAW[name]) if name in _RAW else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def kb_documents(spark: SparkSession, folder: str, embedded: bool = False) -> DataFrame:
    """One document per documents row; the vectors are joined on request only."""
    docs = spread(raw(spark, folder, "documents"), "doc_id")
    number = F.col("doc_id")
    created = F.concat(
        F.lit("2024-01-"),
        _two_digits(number % 28 + 1),
        F.lit("T"),
        _two_digits(number % 24),
        F.lit(":00:00"),
    )
    lang = F.when(number % 7 == 0, F.upper("lang")).otherwise(F.col("lang"))
    size = F.when(F.col("n_chars") < 1000, "short").otherwise("long")
    if embedded:
        vectors = raw(spark, folder, "embeddings").select(
            F.col("vec_id").alias("doc_id"), "embedding"
        )
        docs = docs.join(vectors, "doc_id", "left")
    else:
        docs = docs.withColumn("embedding", F.lit(None).cast("array<float>"))
    return docs.select(
        number.cast("string").alias("key"),
        F.substring(F.translate("text", "\n", " "), 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.array(lang, "source", size).alias("tags"),
        F.struct(
            F.lit("synthetic").alias("source"),
            F.lit(schemas.DEFAULT_CREATOR).alias("creator"),
            created.alias("created"),
            created.alias("updated"),
            F.lit(1).alias("version"),
        ).alias("metadata"),
        F.when(number % 3 == 1, F.substring("text", 1, 120))
        .when(number % 3 == 2, F.lit(""))
        .alias("summary"),
        F.lit(schemas.DEFAULT_CONFIDENCE).alias("confidence"),
        "embedding",
        F.lit(schemas.DEFAULT_STATUS).alias("status"),
    )


def kb_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and document sources as a three-level tree, plus its edge cases."""
    regions = raw(spark, folder, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("parent_topic"),
    )
    nations = raw(spark, folder, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_topic"),
    )
    number = F.substring("source", F.lit(4), F.length("source"))
    sources = (
        raw(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            F.concat(F.lit("s"), number).alias("key"),
            F.col("source").alias("name"),
            F.concat(F.lit("n"), number).alias("parent_topic"),
        )
    )
    edge_cases = spark.createDataFrame(
        [("x1", "orphan", "zz"), ("c1", "cyc1", "c2"), ("c2", "cyc2", "c1"), ("p0", "self", "p0")],
        "key string, name string, parent_topic string",
    )
    rows = regions.unionByName(nations).unionByName(sources).unionByName(edge_cases)
    return rows.select(
        "key",
        "name",
        F.concat(F.lit("about "), "name").alias("description"),
        "parent_topic",
        F.create_map(F.lit("creator"), F.lit(schemas.DEFAULT_CREATOR)).alias("metadata"),
    )


def kb_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every document belongs to the topic of its source and links to one other document."""
    docs = raw(spark, folder, "documents").select("doc_id", "source")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    number = F.col("doc_id")
    source_id = F.concat(F.lit(schemas.DOCUMENT_PREFIX), number)
    belongs = docs.select(
        source_id.alias("from_id"),
        F.concat(F.lit(schemas.TOPIC_PREFIX + "s"), F.substring("source", F.lit(4), F.length("source"))).alias("to_id"),
        F.lit(schemas.TOPIC_LINK_TYPE).alias("type"),
        F.lit(schemas.TOPIC_LINK_STRENGTH).alias("strength"),
        F.lit(False).alias("bidirectional"),
    )
    between = docs.select(
        source_id.alias("from_id"),
        F.concat(
            F.lit(schemas.DOCUMENT_PREFIX), (number * 7 + 1) % total.scalar()
        ).alias("to_id"),
        F.when(number % 2 == 0, schemas.DOCUMENT_LINK_TYPE).otherwise("cites").alias("type"),
        F.lit(schemas.DOCUMENT_LINK_STRENGTH).alias("strength"),
        (number % 3 == 0).alias("bidirectional"),
    )
    return belongs.unionByName(between).withColumn(
        "metadata", F.lit(None).cast("map<string,string>")
    )


def kb_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Command log from the events table."""
    pairs = [F.lit(x) for pair in _OPERATIONS.items() for x in pair]
    return raw(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"),
        "ts",
        "event_id",
        F.create_map(*pairs)[F.col("event_type")].alias("op"),
        F.concat(F.lit("title-"), F.col("event_id")).alias("title"),
        F.concat(F.lit("t"), F.col("event_id") % 10).alias("tag"),
    )


def ingest_commands(turns: DataFrame) -> DataFrame:
    """Store commands from the assistant turns of conversations (batch or stream)."""
    return turns.where("role = 'assistant'").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("key"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit(" chat, "), F.col("role"), F.lit(" ,, t"), F.col("turn") % 3).alias("tags_csv"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("creator"),
        F.concat(F.lit("r"), F.col("conv_id") % 7).alias("topic_key"),
    )


def kb_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest_commands(raw(spark, folder, "conversations"))


def kb_queries(
    spark: SparkSession, folder: str, max_results: int = 5, min_score: float = 0.3
) -> DataFrame:
    """Request table from the user turns of conversations."""
    return (
        raw(spark, folder, "conversations")
        .where("role = 'user'")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.col("text").alias("query"),
            F.lit(max_results).alias("max_results"),
            F.lit(min_score).alias("min_score"),
        )
    )


def kb_records(spark: SparkSession, folder: str) -> DataFrame:
    """Stored JSON lines of the documents; every tenth has a field the schema lacks."""
    docs = kb_documents(spark, folder).drop("embedding")
    stored = F.struct(
        F.col("key").alias("_key"),
        document_ref("key").alias("_id"),
        F.lit("1").alias("_rev"),
        *[F.col(c) for c in docs.columns if c != "key"],
    )
    plain = F.to_json(stored)
    extended = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"unknown":true}'))
    is_odd = F.col("key").cast("long") % 10 == 0
    return docs.select(F.when(is_odd, extended).otherwise(plain).alias("value"))


def document_ref(key: str) -> Column:
    return F.concat(F.lit(schemas.DOCUMENT_PREFIX), F.col(key))
