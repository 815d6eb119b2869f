"""Queries over documents, topics, tags and request texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import lookup, suggest
from ..sources import derived, records
from . import sql
from .registry import register

def _joined(column: str = "tags"):
    return F.array_join(column, ", ").alias(column)


@register(
    "scan_documents",
    sql.query(
        """SELECT key, title, content, summary, array_to_string(tags, ', ') AS tags, created,
                  CAST(1 AS INTEGER) AS version, CAST(0.9 AS DOUBLE) AS confidence,
                  'active' AS status FROM kb_documents""",
        "kb_documents",
    ),
)
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return derived.kb_documents(spark, folder).select(
        "key",
        "title",
        "content",
        "summary",
        _joined(),
        F.col("metadata.created").alias("created"),
        F.col("metadata.version").alias("version"),
        "confidence",
        "status",
    )


@register(
    "list_topics",
    sql.query(
        "SELECT key, name, description, parent_topic FROM kb_topics ORDER BY name, key", "kb_topics"
    ),
)
def list_topics(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.list_topics(derived.kb_topics(spark, folder))


@register(
    "embedding_inventory",
    sql.query(
        "SELECT key, title, embedding IS NOT NULL AS has_embedding FROM kb_embedded", "kb_embedded"
    ),
)
def embedding_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.embedding_inventory(derived.kb_documents(spark, folder, embedded=True))


@register(
    "embedding_coverage",
    sql.query(
        "SELECT count(*) AS documents, count(embedding) AS with_embedding FROM kb_embedded",
        "kb_embedded",
    ),
)
def embedding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.embedding_coverage(derived.kb_documents(spark, folder, embedded=True))


@register(
    "decode_records",
    sql.query(
        """SELECT key, title, content, summary, array_to_string(tags, ', ') AS tags, created,
                  CAST(1 AS INTEGER) AS version, CAST(0.9 AS DOUBLE) AS confidence,
                  'active' AS status,
                  CASE WHEN doc_id % 10 = 0 THEN 'unknown_field' ELSE 'none' END AS problem
           FROM kb_documents""",
        "kb_documents",
    ),
)
def decode_records(spark: SparkSession, folder: str) -> DataFrame:
    decoded = records.decode_documents(derived.kb_records(spark, folder))
    return decoded.select(
        "key",
        "title",
        "content",
        "summary",
        _joined(),
        F.col("metadata.created").alias("created"),
        F.col("metadata.version").alias("version"),
        "confidence",
        "status",
        F.coalesce("problem", F.lit("none")).alias("problem"),
    )


@register(
    "get_documents",
    sql.query(
        """SELECT CAST(c.c_custkey AS VARCHAR) AS key, d.key IS NOT NULL AS found, d.title, d.created
           FROM customer c LEFT JOIN kb_documents d ON d.key = CAST(c.c_custkey AS VARCHAR)""",
        "kb_documents",
    ),
)
def get_documents(spark: SparkSession, folder: str) -> DataFrame:
    keys = derived.raw(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return lookup.get_by_key(derived.kb_documents(spark, folder), keys).select(
        "key", "found", "title", F.col("metadata.created").alias("created")
    )


@register(
    "get_topics",
    sql.query(
        """SELECT s.key, t.key IS NOT NULL AS found, t.name, t.parent_topic
           FROM (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS key FROM supplier) s
           LEFT JOIN kb_topics t ON t.key = s.key""",
        "kb_topics",
    ),
)
def get_topics(spark: SparkSession, folder: str) -> DataFrame:
    keys = derived.raw(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key")
    )
    return lookup.get_by_key(derived.kb_topics(spark, folder), keys).select(
        "key", "found", "name", "parent_topic"
    )


_TAGS = [("EN",), ("src3",), ("long",), ("Short",)]


@register(
    "docs_by_tag",
    sql.query(
        """SELECT r.tag, d.key, d.created FROM requests r
           JOIN kb_documents d ON list_contains(d.tags, r.tag)
           ORDER BY d.created DESC, d.key""",
        "kb_documents",
        requests=sql.values(["tag"], _TAGS),
    ),
)
def docs_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame(_TAGS, "tag string")
    return lookup.newest_first(lookup.documents_by_tag(derived.kb_documents(spark, folder), asked))


_LOOSE_TAGS = [(" EN ",), ("Short",), ("src3\t",), ("de",)]


@register(
    "docs_by_tag_normalized",
    sql.query(
        """SELECT lower(trim(r.tag, ' ' || chr(9))) AS tag, d.key, d.created FROM requests r
           JOIN kb_documents d ON list_contains(d.tags, lower(trim(r.tag, ' ' || chr(9))))
           ORDER BY d.created DESC, d.key""",
        "kb_documents",
        requests=sql.values(["tag"], _LOOSE_TAGS),
    ),
)
def docs_by_tag_normalized(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame(_LOOSE_TAGS, "tag string")
    docs = derived.kb_documents(spark, folder)
    return lookup.newest_first(lookup.documents_by_normalized_tag(docs, asked))


@register(
    "document_snippets",
    sql.query(
        f"""SELECT key, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...'
                   ELSE content END AS snippet, {sql.preview()} AS preview FROM kb_documents""",
        "kb_documents",
    ),
)
def document_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.document_snippets(derived.kb_documents(spark, folder))


@register(
    "clean_queries",
    sql.query(f"SELECT query_id, {sql.cleaned('query')} AS cleaned FROM kb_queries", "kb_queries"),
)
def clean_queries(spark: SparkSession, folder: str) -> DataFrame:
    return derived.kb_queries(spark, folder).select(
        "query_id", text.clean_query(F.col("query")).alias("cleaned")
    )


@register(
    "extract_terms",
    sql.query(
        f"""SELECT query_id, array_to_string({sql.terms(sql.cleaned('query'))}, ' ') AS terms
            FROM kb_queries""",
        "kb_queries",
    ),
)
def extract_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = text.extract_terms(text.clean_query(F.col("query")))
    return derived.kb_queries(spark, folder).select(
        "query_id", F.array_join(terms, " ").alias("terms")
    )


@register(
    "expand_terms",
    sql.query(
        f"SELECT query_id, array_to_string({sql.expanded('terms')}, ' ') AS terms FROM split",
        "kb_queries",
        split=f"SELECT query_id, {sql.terms(sql.cleaned('query'))} AS terms FROM kb_queries",
    ),
)
def expand_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = text.expand_terms(text.extract_terms(text.clean_query(F.col("query"))))
    return derived.kb_queries(spark, folder).select(
        "query_id", F.array_join(terms, " ").alias("terms")
    )


@register(
    "parse_tags",
    sql.query(
        """SELECT key, 'chat|assistant|t' || CAST(turn % 3 AS VARCHAR) AS tags,
                  CAST(3 AS INTEGER) AS n_tags FROM kb_ingest""",
        "kb_ingest",
    ),
)
def parse_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = text.parse_tags(F.col("tags_csv"))
    return derived.kb_ingest(spark, folder).select(
        "key", F.array_join(tags, "|").alias("tags"), F.size(tags).alias("n_tags")
    )


@register(
    "retag_documents",
    sql.query(
        """SELECT key, array_to_string(list_filter(
                      list_concat(tags, list_value('new'),
                                  CASE WHEN list_contains(tags, 'short') THEN CAST([] AS VARCHAR[])
                                       ELSE list_value('short') END),
                      lambda t: t NOT IN (raw_lang, 'zzz')), '|') AS tags
           FROM kb_documents""",
        "kb_documents",
    ),
)
def retag_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder)
    language = F.lower(F.col("tags")[0])
    add = F.array(F.lit("new"), F.col("tags")[1], F.lit("new"), F.lit("short"))
    remove = F.array(language, F.lit("zzz"))
    return docs.select(
        "key", F.array_join(text.retag(F.col("tags"), add, remove), "|").alias("tags")
    )


_TAG_COUNTS = """SELECT tag, CAST(count(*) AS BIGINT) AS uses,
                        CAST(count(DISTINCT key) AS BIGINT) AS documents
                 FROM (SELECT key, unnest(tags) AS tag FROM kb_documents) GROUP BY tag"""


@register(
    "list_tags", sql.query(f"{_TAG_COUNTS} ORDER BY uses DESC, tag", "kb_documents")
)
def list_tags(spark: SparkSession, folder: str) -> DataFrame:
    return suggest.list_tags(derived.kb_documents(spark, folder))


@register(
    "top_tags", sql.query(f"{_TAG_COUNTS} ORDER BY uses DESC, tag LIMIT 5", "kb_documents")
)
def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return suggest.top_tags(derived.kb_documents(spark, folder))
