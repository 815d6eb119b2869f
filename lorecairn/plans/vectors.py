"""Embedding and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, vectors
from ..operators import nearest
from ..sources import derived
from . import sql
from .registry import register

_CELLS = "SELECT key, CAST(cell AS INTEGER) AS cell, round(CAST(value AS DOUBLE), 6) AS value FROM cells"


def _cells(embedded: DataFrame) -> DataFrame:
    """Non-zero cells of the embeddings."""
    return (
        embedded.select("key", F.posexplode("embedding").alias("cell", "value"))
        .where("value <> 0")
        .select("key", "cell", F.round(F.col("value").cast("double"), 6).alias("value"))
    )


@register(
    "hash_embedding",
    sql.query(_CELLS, "kb_documents", cells=sql.hash_cells("kb_documents", "key", "content")),
)
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder)
    return _cells(docs.select("key", vectors.hash_embedding("content").alias("embedding")))


@register(
    "model_embedding",
    sql.query(
        _CELLS,
        "kb_documents",
        cells=sql.hash_cells(
            f"(SELECT key, {sql.EMBEDDING_TEXT} AS body FROM kb_documents)", "key", "body"
        ),
    ),
)
def model_embedding(spark: SparkSession, folder: str) -> DataFrame:
    # Without an installed sentence model this is the deterministic embedding.
    docs = derived.kb_documents(spark, folder)
    body = text.embedding_text(F.col("title"), F.col("summary"), F.col("content"))
    return _cells(docs.select("key", vectors.model_embedding(body).alias("embedding")))


def _linked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded documents at both ends of a document link."""
    between = derived.kb_links(spark, folder).where("type <> 'belongs_to'")
    vectors_by_id = derived.kb_documents(spark, folder, embedded=True).where(
        "embedding is not null"
    ).select(F.concat(F.lit("documents/"), "key").alias("id"), "embedding")
    left = vectors_by_id.toDF("from_id", "a")
    right = vectors_by_id.toDF("to_id", "b")
    return between.select("from_id", "to_id").join(left, "from_id").join(right, "to_id")


def _pairs_check(expression: str, name: str) -> str:
    return sql.query(
        f"""SELECT l.from_id, l.to_id, round({expression}, 6) AS {name}
            FROM kb_links l
            JOIN vectors a ON l.from_id = a.id JOIN vectors b ON l.to_id = b.id""",
        "kb_embedded",
        "kb_links",
        vectors="""SELECT 'documents/' || key AS id, CAST(embedding AS DOUBLE[]) AS v
                   FROM kb_embedded WHERE embedding IS NOT NULL""",
    )


@register("cosine_pairs", _pairs_check("list_cosine_similarity(a.v, b.v)", "cosine"))
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    cosine = vectors.cosine_similarity(F.col("a"), F.col("b"))
    return _linked_vectors(spark, folder).select(
        "from_id", "to_id", F.round(cosine, 6).alias("cosine")
    )


@register("euclidean_pairs", _pairs_check("list_distance(a.v, b.v)", "distance"))
def euclidean_pairs(spark: SparkSession, folder: str) -> DataFrame:
    distance = vectors.euclidean_distance(F.col("a"), F.col("b"))
    return _linked_vectors(spark, folder).select(
        "from_id", "to_id", F.round(distance, 6).alias("distance")
    )


_TOP = """
    SELECT query_id, CAST(rank AS INTEGER) AS rank, key, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank
          FROM scored)
    WHERE rank <= max_results"""
_VECTORS = """SELECT key, CAST(embedding AS DOUBLE[]) AS v FROM kb_embedded
              WHERE embedding IS NOT NULL"""


def _shown(results: DataFrame) -> DataFrame:
    """Scores rounded for the comparison, after ranking."""
    return results.withColumn("score", F.round("score", 6))


def _wave() -> Column:
    """A fixed 64-dimensional request vector."""
    return F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.cos(i.cast("double")))


_WAVE_CHECK = "list_transform(range(1, 65), lambda i: cos(i))"


def _wave_request(spark: SparkSession, max_results: int, min_score: float | None) -> DataFrame:
    return spark.range(1, 2).select(
        F.col("id").alias("query_id"),
        _wave().alias("vector"),
        F.lit(max_results).alias("max_results"),
        F.lit(min_score).cast("double").alias("min_score"),
    )


@register(
    "knn_l2",
    sql.query(
        _TOP,
        "kb_embedded",
        vectors=_VECTORS,
        scored=f"""SELECT CAST(1 AS BIGINT) AS query_id, key, 25 AS max_results,
                          1 - list_distance(v, {_WAVE_CHECK}) AS score FROM vectors""",
    ),
)
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder, embedded=True)
    return _shown(nearest.nearest_l2(docs, _wave_request(spark, 25, None)))


@register(
    "knn_cosine",
    sql.query(
        _TOP,
        "kb_embedded",
        vectors=_VECTORS,
        scored=f"""SELECT * FROM (
                       SELECT CAST(1 AS BIGINT) AS query_id, key, 50 AS max_results,
                              list_cosine_similarity(v, {_WAVE_CHECK}) AS score
                       FROM vectors) WHERE score >= 0.1""",
    ),
)
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder, embedded=True)
    return _shown(nearest.nearest(docs, _wave_request(spark, 50, 0.1)))


@register(
    "knn_batch",
    sql.query(
        _TOP,
        "kb_embedded",
        vectors=_VECTORS,
        scored="""SELECT * FROM (
                      SELECT e.vec_id AS query_id, key, 5 AS max_results,
                             list_cosine_similarity(v, CAST(e.embedding AS DOUBLE[])) AS score
                      FROM vectors, embeddings e) WHERE score >= 0.1""",
    ),
)
def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    requests = derived.raw(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("vector"),
        F.lit(5).alias("max_results"),
        F.lit(0.1).alias("min_score"),
    )
    return _shown(nearest.nearest(derived.kb_documents(spark, folder, embedded=True), requests))


_TEXTS = [
    (1, "thing with erent of the ores", 5, 0.5),
    (2, "Die Einheit und der Schein", 99, 0.95),
    (3, "que le leau", 0, 0.0),
    (4, "", 5, 0.5),
]


@register(
    "semantic_search",
    sql.query(
        f"""SELECT t.query_id, t.rank, t.key, t.score, d.title, {sql.preview()} AS preview,
                   array_to_string(d.tags, ', ') AS tags, d.created
            FROM ({_TOP}) t JOIN kb_documents d USING (key)""",
        "kb_documents",
        requests=sql.values(["query_id", "query", "max_results", "min_score"], _TEXTS),
        doc_cells=sql.hash_cells(
            f"(SELECT key, {sql.EMBEDDING_TEXT} AS body FROM kb_documents)", "key", "body"
        ),
        request_cells=sql.hash_cells("requests", "query_id", "query"),
        doc_norms="SELECT key, sqrt(sum(CAST(value AS DOUBLE) ** 2)) AS norm FROM doc_cells GROUP BY key",
        request_norms="""SELECT key, sqrt(sum(CAST(value AS DOUBLE) ** 2)) AS norm
                         FROM request_cells GROUP BY key""",
        products="""SELECT q.key AS query_id, d.key AS key,
                           sum(CAST(q.value AS DOUBLE) * CAST(d.value AS DOUBLE)) AS product
                    FROM request_cells q JOIN doc_cells d USING (cell) GROUP BY q.key, d.key""",
        scored="""SELECT * FROM (
                      SELECT CAST(p.query_id AS BIGINT) AS query_id, p.key,
                             least(greatest(r.max_results, 1), 20) AS max_results,
                             least(greatest(r.min_score, 0.1), 0.9) AS floor,
                             -- sums come in any order here; twelve digits make copies tie
                             round(product / (dn.norm * qn.norm), 12) AS score
                      FROM products p JOIN requests r ON r.query_id = p.query_id
                      JOIN doc_norms dn ON dn.key = p.key
                      JOIN request_norms qn ON qn.key = p.query_id)
                  WHERE score >= floor""",
    ),
)
def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder)
    asked = spark.createDataFrame(
        _TEXTS, "query_id long, query string, max_results int, min_score double"
    )
    found = _shown(nearest.semantic_search(nearest.embed_documents(docs), asked))
    return found.select("query_id", "rank", "key", "score", "title", "preview", "tags", "created")
