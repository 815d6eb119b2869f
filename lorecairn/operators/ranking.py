"""Top-k per request and the late join that fetches display columns for the winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values -------------------------------------------------------------
MIN_RESULTS, MAX_RESULTS = 1, 20
MIN_SIMILARITY, MAX_SIMILARITY = 0.1, 0.9
#: Limits of a request that names none.
DEFAULT_RESULTS, DEFAULT_SCORE = 10, 0.3
#: Slack of a threshold test, so that a score equal to the threshold passes.
EPSILON = 1e-9
# ---------------------------------------------------------------------------


def clamp_results(n: Column) -> Column:
    return F.least(F.greatest(n, F.lit(MIN_RESULTS)), F.lit(MAX_RESULTS))


def clamp_similarity(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(MIN_SIMILARITY)), F.lit(MAX_SIMILARITY))


def with_limits(requests: DataFrame, results: int = DEFAULT_RESULTS, score: float | None = None) -> DataFrame:
    """``requests`` with its null limits filled in; a limit below 1 gives no rows."""
    filled = requests.withColumn("max_results", F.coalesce(F.col("max_results").cast("int"), F.lit(results)))
    if score is None:
        return filled
    return filled.withColumn("min_score", F.coalesce(F.col("min_score").cast("double"), F.lit(score)))


def top_per_request(
    scored: DataFrame, by: list[str], order: list[Column], k: int, per_row: str | None = None
) -> DataFrame:
    """Number rows 1..k per request and keep the best.

    ``k`` is a plain number so that every task prunes to k rows per request
    before the shuffle; ``per_row`` names a column with a lower, per-request limit.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") <= F.col(per_row)) if per_row else ranked


def largest(requests: DataFrame, column: str) -> int:
    """Largest per-request limit; one small aggregate over the request table."""
    return int(requests.agg(F.max(column).alias("k")).first()["k"] or 0)


def attach_documents(results: DataFrame, docs: DataFrame, columns: list[Column | str]) -> DataFrame:
    """Join display columns to the few winning rows."""
    return results.join(docs.select("key", *columns), "key")
