"""Exact nearest neighbours for request tables.

A request table of proven small size travels with the scan of the documents:
every task multiplies its Arrow batches with the request matrix and keeps k
rows per request, so only those are shuffled.  A larger table visits cells of
documents around pivots, and skips those that cannot hold one of the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text
from ..functions.vectors import hash_embedding
from ..session import bounded_rows
from . import cells
from .ranking import (
    attach_documents,
    clamp_results,
    clamp_similarity,
    largest,
    top_per_request,
    with_limits,
)

#: Up to this many requests, and this many vector cells, travel with the scan.
INLINE_VECTORS = 4096
INLINE_CELLS = 4_000_000
#: Vectors per block of a cell, which a task holds.
DOCUMENT_BLOCK = 50_000
#: Requests multiplied at a time, which bounds the score matrix in memory.
STRIPE = 256
#: Scores, and values of vectors compared exactly, that a task holds at a time.
VALUES = 1 << 20
#: Relative error that a matrix product is trusted to stay below.
SLACK = 1e-12


def _bounds(documents: np.ndarray, squares: np.ndarray, requests: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every score from one matrix product; its rounding depends on where a row stands."""
    products = documents @ requests.T
    if metric == "cosine":
        lengths = np.sqrt(squares)[:, None] * np.linalg.norm(requests, axis=1)
        values = np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0)
        return values - SLACK, values + SLACK
    both = squares[:, None] + (requests**2).sum(axis=1)
    distance, error = both - 2.0 * products, SLACK * both
    return 1.0 - np.sqrt(np.maximum(distance, 0.0) + error), 1.0 - np.sqrt(np.maximum(distance - error, 0.0))


def _exact(documents: np.ndarray, requests: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, summed in one fixed order, so that copies tie exactly."""
    if metric == "l2":
        return 1.0 - np.sqrt(((documents - requests) ** 2).sum(axis=1))
    lengths = np.sqrt((documents**2).sum(axis=1)) * np.sqrt((requests**2).sum(axis=1))
    products = (documents * requests).sum(axis=1)
    return np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0) + 0.0


def keep_best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "score", "key"], ascending=[True, False, True])
    return ordered[ordered.groupby("query_id").cumcount() < k]


def best_of_batch(
    keys: np.ndarray,
    documents: np.ndarray,
    ids: np.ndarray,
    requests: np.ndarray,
    floors: np.ndarray,
    k: int,
    metric: str,
) -> pd.DataFrame:
    """The k best rows per request within one batch of documents."""
    parts = []
    squares = np.einsum("ij,ij->i", documents, documents)
    stripe = max(1, min(STRIPE, VALUES // max(1, len(keys))))
    for start in range(0, len(ids), stripe):
        stop = start + stripe
        low, high = _bounds(documents, squares, requests[start:stop], metric)
        # Whatever may reach the k-th score stays until exact scores, and then keys, decide.
        kth = min(max(len(keys) - k, 0), len(keys) - 1)
        bar = np.maximum(np.partition(low, kth, axis=0)[kth], floors[start:stop])
        rows, columns = np.nonzero(high >= bar)
        # Copies all reach the k-th score, so there may be as many pairs as scores.
        scores, pairs = np.empty(len(rows)), max(1, VALUES // max(1, documents.shape[1]))
        for at in range(0, len(rows), pairs):
            some = slice(at, at + pairs)
            scores[some] = _exact(documents[rows[some]], requests[start:stop][columns[some]], metric)
        passing = scores >= floors[start:stop][columns]
        rows, columns, scores = rows[passing], columns[passing], scores[passing]
        parts.append(
            keep_best(
                pd.DataFrame(
                    {
                        "query_id": ids[start:stop][columns],
                        "key": keys[rows],
                        "score": scores,
                    }
                ),
                k,
            )
        )
    return pd.concat(parts, ignore_index=True)


def best_above(
    keys: np.ndarray, documents: np.ndarray, requests: np.ndarray, floors: np.ndarray, k: int, metric: str
) -> pd.DataFrame:
    """Rows among which are the k best per request that reach its floor; ``query_id`` is the place of the request.

    Where few reach their floor, a matrix product in single precision tells which are scored; else the best are sought.
    """
    squares = np.einsum("ij,ij->i", documents, documents)
    near = cells.units(documents) if metric == "cosine" else documents
    parts, stripe, pairs = [], max(1, min(STRIPE, VALUES // max(1, len(keys)))), max(1, VALUES // max(1, documents.shape[1]))
    for start in range(0, len(requests), stripe):
        some, floor = requests[start : start + stripe], floors[start : start + stripe]
        if metric == "cosine":
            bar = floor - cells.SINGLE * (documents.shape[1] + 8)
            reached = near @ cells.units(some).T >= np.maximum(bar, -2.0).astype(np.float32)
        else:
            reached = _bounds(documents, squares, some, metric)[1] >= floor
        hits = np.flatnonzero(reached)
        if len(hits) > 2 * k * len(some) + len(keys):
            parts.append(best_of_batch(keys, documents, np.arange(start, start + len(some)), some, floor, k, metric))
            continue
        rows, columns = np.divmod(hits, len(some))
        scores = np.empty(len(hits))
        for at in range(0, len(hits), pairs):
            scores[at : at + pairs] = _exact(documents[rows[at : at + pairs]], some[columns[at : at + pairs]], metric)
        passing = scores >= floor[columns]
        parts.append(pd.DataFrame({"query_id": columns[passing] + start, "key": keys[rows[passing]], "score": scores[passing]}))
    return pd.concat(parts, ignore_index=True)


def emit(kept: pd.DataFrame) -> pd.DataFrame:
    # An empty column has no text type of its own, and Arrow output needs one.
    return kept.assign(key=kept["key"].astype(object))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def floors(limits: pd.Series) -> np.ndarray:
    return limits.fillna(-np.inf).to_numpy(dtype=float)


def nearest(
    docs: DataFrame,
    requests: DataFrame,
    metric: str = "cosine",
    inline: int | None = None,
    document_block: int = DOCUMENT_BLOCK,
    request_block: int | None = None,
) -> DataFrame:
    """Best documents per request: ``(query_id, rank, key, score)``.

    ``requests`` has query_id (any type), vector, max_results (10 if null) and
    min_score (null for no threshold).  The score is the cosine, or 1 minus the L2 distance for
    ``metric="l2"``.  Vectors of another dimension are not compared.  ``request_block`` is
    accepted from earlier callers and has no effect: requests are streamed.
    """
    wanted = with_limits(requests).select(
        "query_id",
        "vector",
        "max_results",
        F.col("min_score").cast("double").alias("min_score"),
    ).where(F.size("vector") > 0)
    vectors = docs.select("key", "embedding").where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    )
    result = StructType([wanted.schema["query_id"], StructField("key", StringType()), StructField("score", DoubleType())])
    limit = INLINE_VECTORS if inline is None else inline
    rows = bounded_rows(wanted, limit)
    if rows is not None and sum(len(r["vector"]) for r in rows) > INLINE_CELLS:
        rows = None
    if rows is not None:
        k = max((r["max_results"] for r in rows), default=0)
        scored = _scan(vectors, rows, k, metric, result)
        limits = None
    else:
        k = largest(wanted, "max_results")
        scored = cells.search(vectors, wanted, k, metric, document_block, result).scored
        limits = wanted.select("query_id", "max_results")
    order = [F.desc("score"), F.asc("key")]
    top = top_per_request(scored, ["query_id"], order, k)
    if rows is not None:
        per_request = {r["query_id"]: r["max_results"] for r in rows}
        if len(set(per_request.values())) > 1:
            limits = docs.sparkSession.createDataFrame(list(per_request.items()), wanted.select("query_id", "max_results").schema)
    if limits is not None:
        top = top.join(limits, "query_id").where(F.col("rank") <= F.col("max_results"))
    return top.select("query_id", "rank", "key", "score")


def _scan(vectors: DataFrame, rows: list, k: int, metric: str, result: StructType) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["vector"]), []).append(r)
    blocks = {
        size: (
            np.array([r["query_id"] for r in group]),
            np.array([r["vector"] for r in group], dtype=np.float64),
            np.array(
                [-np.inf if r["min_score"] is None else r["min_score"] for r in group], dtype=float
            ),
        )
        for size, group in by_size.items()
    }

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for size, (ids, matrix, floors) in blocks.items():
                same = batch[sizes == size]
                if same.empty:
                    continue
                found = best_of_batch(
                    same["key"].to_numpy(), _matrix(same["embedding"]), ids, matrix, floors, k, metric
                )
                kept = found if kept is None else keep_best(pd.concat([kept, found]), k)
        if kept is not None:
            yield emit(kept)

    comparable = vectors.where(F.size("embedding").isin(*blocks)) if blocks else vectors.limit(0)
    return comparable.mapInPandas(best, result)


def nearest_l2(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Ranked by 1 minus the L2 distance, without a threshold."""
    open_requests = requests.withColumn("min_score", F.lit(None).cast("double"))
    return nearest(docs, open_requests, "l2", inline)


def embed_documents(docs: DataFrame) -> DataFrame:
    """Replace the embedding by that of title, summary and content."""
    body = text.embedding_text(F.col("title"), F.col("summary"), F.col("content"))
    return docs.withColumn("embedding", hash_embedding(body))


def semantic_search(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Text requests against embedded documents, with display columns.

    ``max_results`` is clamped to 1..20 and ``min_score`` to 0.1..0.9.
    """
    wanted = requests.select(
        "query_id",
        hash_embedding("query").alias("vector"),
        clamp_results(F.col("max_results")).alias("max_results"),
        clamp_similarity(F.col("min_score")).alias("min_score"),
    )
    shown = [
        F.col("title"),
        text.preview(F.col("summary"), F.col("content")).alias("preview"),
        F.array_join("tags", ", ").alias("tags"),
        F.col("metadata.created").alias("created"),
    ]
    return attach_documents(nearest(docs, wanted, "cosine", inline), docs, shown)
