"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (folder of the Parquet tables), BENCH_CPUS (cores),
BENCH_RUNS (timed runs per query, the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorecairn.plans import QUERIES  # noqa: E402
from lorecairn.session import build_session  # noqa: E402

HEADLINE = (
    "smart_search",
    "smart_search_batch",
    "fulltext_search",
    "fuzzy_search",
    "typo_search",
    "related_terms",
    "suggest_terms",
    "knn_batch",
    "knn_cosine",
    "hash_embedding",
    "semantic_search",
    "list_tags",
    "related_documents",
    "topic_contents",
    "topic_hierarchy",
    "update_documents",
    "link_documents",
    "replay_changes",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    # Every row and column is produced, unlike with count().
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in sys.argv[1:] or HEADLINE:
        try:
            run(spark, name, folder)  # warm-up
            times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
