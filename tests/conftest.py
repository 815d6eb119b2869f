from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lorecairn.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return SMALL


@pytest.fixture(scope="session")
def docs(spark):
    """A handful of hand-made documents with the awkward cases."""
    rows = [
        ("a", "Running Things", "The thing was RUNNING, fast things.", ["Go", "x", "x"], None, [1.0, 0.0]),
        ("b", "Other", "nothing here", ["go"], "", [0.0, 0.0]),
        ("c", "Red ink", "ing ink inking", [], "things in summary", [0.6, 0.8]),
        ("d", "Copy", "The thing was RUNNING, fast things.", ["y"], None, None),
        ("e", "Copy", "The thing was RUNNING, fast things.", ["y"], "s", [-1.0, 0.0]),
        ("f", "Long", "word " * 60 + "z" * 300 + "needle" + "z" * 300, ["two words"], None, [1.0, 0.0, 0.0]),
    ]
    meta = ("synthetic", "system", "2024-01-01T00:00:00", "2024-01-01T00:00:00", 1)
    from lorecairn.schemas import DOCUMENTS

    return spark.createDataFrame(
        [(k, t, c, g, meta, s, 0.9, e, "active") for k, t, c, g, s, e in rows], DOCUMENTS
    )


def requests(spark, *rows):
    return spark.createDataFrame(
        [(i, q, n, m) for i, (q, n, m) in enumerate(rows, 1)],
        "query_id long, query string, max_results int, min_score double",
    )
