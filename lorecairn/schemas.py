"""Schemas of the knowledge-base tables.  They are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", METADATA),
        T.StructField("summary", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("status", T.StringType()),
    ]
)

TOPICS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("parent_topic", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

RELATIONSHIPS = T.StructType(
    [
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("bidirectional", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Fixed values -------------------------------------------------------------
DOCUMENT_PREFIX = "documents/"
TOPIC_PREFIX = "topics/"
DEFAULT_SOURCE = "mcp_conversation"
DEFAULT_CREATOR = "system"
DEFAULT_CONFIDENCE = 0.9
DEFAULT_STATUS = "active"
DEFAULT_IMPORTANCE = "3"
TOPIC_LINK_TYPE = "belongs_to"
TOPIC_LINK_STRENGTH = 0.9
DOCUMENT_LINK_TYPE = "related"
DOCUMENT_LINK_STRENGTH = 0.5
# ---------------------------------------------------------------------------
