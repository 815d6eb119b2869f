"""Queries over links and the topic tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph
from ..sources import derived
from . import sql
from .registry import register


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return derived.kb_documents(spark, folder), derived.kb_links(spark, folder)


@register(
    "docs_by_topic",
    sql.query(
        """SELECT replace(l.to_id, 'topics/', '') AS topic_key, d.key, d.title
           FROM kb_links l JOIN kb_documents d ON l.from_id = 'documents/' || d.key
           WHERE l.to_id LIKE 'topics/%'""",
        "kb_documents",
        "kb_links",
    ),
)
def docs_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    docs, links = _tables(spark, folder)
    return graph.documents_by_topic(docs, links).select("topic_key", "key", "title")


_RELATED = """
    SELECT a.key AS key, b.key AS related_key, b.title AS related_title, l.type
    FROM kb_links l JOIN kb_documents a ON l.from_id = 'documents/' || a.key
    JOIN kb_documents b ON l.to_id = 'documents/' || b.key
    UNION ALL
    SELECT b.key, a.key, a.title, l.type
    FROM kb_links l JOIN kb_documents a ON l.from_id = 'documents/' || a.key
    JOIN kb_documents b ON l.to_id = 'documents/' || b.key
    WHERE l.bidirectional AND a.key <> b.key"""


@register(
    "related_documents",
    sql.query(
        "SELECT key, related_key, related_title FROM related",
        "kb_documents",
        "kb_links",
        related=_RELATED,
    ),
)
def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    return graph.related_documents(*_tables(spark, folder))


@register(
    "related_documents_typed",
    sql.query(
        "SELECT key, related_key, related_title FROM related WHERE type = 'cites'",
        "kb_documents",
        "kb_links",
        related=_RELATED,
    ),
)
def related_documents_typed(spark: SparkSession, folder: str) -> DataFrame:
    return graph.related_documents(*_tables(spark, folder), link_type="cites")


@register(
    "document_detail",
    sql.query(
        """SELECT key, 'document' AS section, title, nullif(summary, '') AS summary,
                  array_to_string(tags, ', ') AS tags, created, created AS updated,
                  CAST(1 AS INTEGER) AS version, 'synthetic' AS source, 'system' AS creator,
                  CAST(0.9 AS DOUBLE) AS confidence, content,
                  CAST(NULL AS VARCHAR) AS related_key, CAST(NULL AS VARCHAR) AS related_title
           FROM kb_documents WHERE key IN (SELECT key FROM asked)
           UNION ALL
           SELECT key, 'related', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
                  related_key, related_title
           FROM related WHERE key IN (SELECT key FROM asked)""",
        "kb_documents",
        "kb_links",
        related=_RELATED,
        asked="SELECT CAST(doc_id AS VARCHAR) AS key FROM labels",
    ),
)
def document_detail(spark: SparkSession, folder: str) -> DataFrame:
    keys = derived.raw(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return graph.document_detail(*_tables(spark, folder), keys)


@register(
    "topic_contents",
    sql.query(
        """SELECT a.topic_key, t.name AS topic_name,
                  CAST(coalesce(n.documents, 0) AS BIGINT) AS documents,
                  CASE WHEN t.key IS NULL THEN 'not_found' WHEN n.documents IS NULL THEN 'empty'
                       ELSE 'ok' END AS status,
                  s.key, s.title, nullif(s.summary, '') AS summary,
                  array_to_string(s.tags, ', ') AS tags,
                  CASE WHEN length(s.content) < 1000 THEN s.content END AS content
           FROM asked a LEFT JOIN kb_topics t ON t.key = a.topic_key
           LEFT JOIN (SELECT topic_key, count(*) AS documents FROM shown GROUP BY topic_key) n
                  ON n.topic_key = t.key
           LEFT JOIN shown s ON s.topic_key = t.key""",
        "kb_documents",
        "kb_links",
        "kb_topics",
        asked="""SELECT key AS topic_key FROM kb_topics
                 UNION SELECT 's' || CAST(s_suppkey AS VARCHAR) FROM supplier""",
        shown="""SELECT replace(l.to_id, 'topics/', '') AS topic_key, d.*
                 FROM kb_links l JOIN kb_documents d ON l.from_id = 'documents/' || d.key
                 WHERE l.to_id LIKE 'topics/%'""",
    ),
)
def topic_contents(spark: SparkSession, folder: str) -> DataFrame:
    topics = derived.kb_topics(spark, folder)
    suppliers = derived.raw(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key")
    )
    return graph.topic_contents(
        *_tables(spark, folder), topics, topics.select("key").unionByName(suppliers)
    )


_TREE = """
    SELECT key, name, description, key AS root, 0 AS depth, list_value(name, key) AS path
    FROM kb_topics WHERE parent_topic IS NULL OR parent_topic = ''
                      OR parent_topic NOT IN (SELECT key FROM kb_topics)
    UNION ALL
    SELECT t.key, t.name, t.description, u.root, u.depth + 1,
           list_concat(u.path, list_value(t.name, t.key))
    FROM kb_topics t JOIN tree u ON t.parent_topic = u.key"""


@register(
    "topic_hierarchy",
    sql.query(
        """SELECT key, name, description, root, CAST(depth AS INTEGER) AS depth,
                  array_to_string(path, '/') AS path FROM tree""",
        "kb_topics",
        recursive=True,
        tree=_TREE,
    ),
)
def topic_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    tree = graph.topic_hierarchy(derived.kb_topics(spark, folder))
    return tree.withColumn("path", F.array_join("path", "/"))


@register(
    "topic_outline",
    sql.query(
        """SELECT key, CAST(depth AS INTEGER) AS depth, repeat('  ', depth) || name AS label,
                  array_to_string(path, '/') AS path FROM tree ORDER BY tree.path""",
        "kb_topics",
        recursive=True,
        tree=_TREE,
    ),
)
def topic_outline(spark: SparkSession, folder: str) -> DataFrame:
    outline = graph.topic_outline(derived.kb_topics(spark, folder))
    return outline.withColumn("path", F.array_join("path", "/"))
