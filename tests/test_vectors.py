"""Embeddings and nearest neighbours against numpy."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorecairn.functions import vectors
from lorecairn.operators import cells, nearest
from lorecairn.sources import derived


def reference_vector(text, dimension=384):
    cells = np.zeros(dimension)
    for i, letter in enumerate(text):
        cells[ord(letter) % dimension] += 1.0 / (i + 1)
    length = np.linalg.norm(cells)
    return cells / length if length else cells


@pytest.mark.parametrize("text", ["", "a", "Héllo 🙂 world", "x" * 5000])
def test_character_vector(text):
    np.testing.assert_allclose(vectors.character_vector(text), reference_vector(text), atol=1e-6)


def test_hash_embedding_column(spark):
    rows = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(vectors.hash_embedding("t", 8)).collect()]
    np.testing.assert_allclose(got[0], reference_vector("ab", 8), atol=1e-6)
    assert got[1] == got[2] == [0.0] * 8


def test_batches_without_any_text(spark):
    rows = spark.createDataFrame([("",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in rows.select(vectors.hash_embedding("t", 8)).collect()]
    assert got == [[0.0] * 8] * 2


def test_a_batch_of_vectors_needs_little_memory_beside_its_texts():
    texts = pd.Series(["añ🙂 b" * 400] * 1500 + ["long 🙂" * 150_000, "", None, "z"], dtype=object)
    tracemalloc.start()
    got = vectors.character_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Counted in one pass, 4 million characters took over 200 MB.
    assert peak < 60e6
    for place in (0, 1499, 1500, 1501, 1503):
        np.testing.assert_allclose(got[place], reference_vector(texts[place]), atol=1e-6)
    assert not got[1502].any()


def test_model_embedding_uses_the_encoder_and_falls_back(spark):
    rows = spark.createDataFrame([("ab",), ("bad",)], "t string").coalesce(1)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    def broken():
        def encode(texts):
            raise ValueError("no")

        return encode

    good = [r[0] for r in rows.select(vectors.model_embedding("t", load)).collect()]
    assert good == [[2.0, 1.0], [3.0, 1.0]]
    for loader in (broken, lambda: None):
        got = [r[0] for r in rows.select(vectors.model_embedding("t", loader, 8)).collect()]
        np.testing.assert_allclose(got[0], reference_vector("ab", 8), atol=1e-6)


def test_cosine_and_distance(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0])],
        "a array<float>, b array<float>",
    )
    got = rows.select(
        F.round(vectors.cosine_similarity(F.col("a"), F.col("b")), 6),
        F.round(vectors.euclidean_distance(F.col("a"), F.col("b")), 6),
    ).collect()
    assert [tuple(r) for r in got] == [(0.6, 0.894427), (0.0, 1.0), (-1.0, 2.0), (None, None)]


def brute(documents, wanted, metric):
    out = []
    for q in wanted:
        scored = []
        for d in documents:
            if d["embedding"] is None or len(d["embedding"]) != len(q["vector"]):
                continue
            a, b = np.array(d["embedding"], float), np.array(q["vector"], float)
            if metric == "cosine":
                lengths = np.linalg.norm(a) * np.linalg.norm(b)
                score = float(a @ b / lengths) if lengths else 0.0
            else:
                score = float(1 - np.linalg.norm(a - b))
            if q["min_score"] is None or score >= q["min_score"]:
                scored.append((-score, d["key"]))
        for rank, (s, key) in enumerate(sorted(scored)[: q["max_results"]], 1):
            out.append((q["query_id"], rank, key, round(-s, 6) + 0.0))
    return sorted(out)


def shown(results):
    """Rows with the score rounded for the comparison, after ranking."""
    return sorted((*tuple(r)[:3], round(r["score"], 6) + 0.0) for r in results.collect())


@pytest.mark.parametrize("inline", [None, 0])
def test_scores_are_ranked_before_they_are_rounded(spark, inline):
    docs = spark.createDataFrame([("a", [1.0, 0.0004]), ("b", [1.0, 0.0])], "key string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], 1, None)], "query_id string, vector array<float>, max_results int, min_score double")
    (row,) = nearest.nearest(docs, asked, "cosine", inline).collect()
    assert (row["query_id"], row["key"]) == ("q", "b")


@pytest.mark.parametrize("inline", [None, 0])
def test_distance_of_long_vectors(spark, inline):
    base = np.random.default_rng(1).normal(0, 2e4, 100).astype(np.float32)
    other = base.copy()
    other[3] += np.float32(0.0625)
    rows = [("a", base.tolist()), ("b", other.tolist())]
    docs = spark.createDataFrame(rows, "key string, embedding array<float>")
    asked = spark.createDataFrame([(1, base.tolist(), None, None)], "query_id int, vector array<float>, max_results int, min_score double")
    got = nearest.nearest(docs, asked, "l2", inline)
    assert got.schema["query_id"].dataType.simpleString() == "int"
    exact = 1 - float(np.linalg.norm(base.astype(float) - other.astype(float)))
    assert [(r["key"], r["score"]) for r in got.orderBy("rank").collect()] == [("a", 1.0), ("b", pytest.approx(exact, abs=1e-12))]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("inline", [None, 0])
def test_nearest_on_awkward_vectors(spark, docs, metric, inline):
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], 2, 0.0), (2, [0.0, 1.0], 10, None), (3, [0.0, 0.0], 10, None), (4, [1.0, 0.0, 0.0], 3, 0.5)],
        "query_id long, vector array<float>, max_results int, min_score double",
    )
    got = nearest.nearest(docs, asked, metric, inline, document_block=2, request_block=2)
    assert shown(got) == brute(docs.collect(), asked.collect(), metric)


def test_copies_tie_by_key_in_both_ways(spark):
    rows = [(f"k{i:03d}", [0.5, 0.5, float(i % 3)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "key string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(
        [(i, [1.0, float(i), 0.0], 4, None) for i in range(5)],
        "query_id long, vector array<float>, max_results int, min_score double",
    )
    expected = brute(docs.collect(), asked.collect(), "cosine")
    for inline in (None, 0):
        got = nearest.nearest(docs, asked, "cosine", inline, document_block=30, request_block=2)
        assert shown(got) == expected


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_many_copies_in_a_block_need_little_memory(metric):
    rng = np.random.default_rng(3)
    documents, requests = rng.normal(size=(20_000, 64)), rng.normal(size=(256, 64))
    documents[:5000], requests[0] = documents[0], documents[0]
    keys = np.array([f"{i:05d}" for i in range(len(documents))], dtype=object)
    tracemalloc.start()
    got = nearest.best_of_batch(keys, documents, np.arange(256), requests, np.full(256, -np.inf), 3, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A matrix of all scores takes 41 MB, and four of them were held.
    assert peak < 100e6
    assert got[got["query_id"] == 0]["key"].tolist() == ["00000", "00001", "00002"]
    assert len(got) == 256 * 3


def test_semantic_search_clamps(spark, docs):
    embedded = nearest.embed_documents(docs)
    asked = spark.createDataFrame(
        [(1, "Copy  The thing was RUNNING, fast things.", 0, 5.0)],
        "query_id long, query string, max_results int, min_score double",
    )
    assert [(r["key"], round(r["score"], 6)) for r in nearest.semantic_search(embedded, asked).collect()] == [("d", 1.0)]


def test_native_scoring_agrees_with_the_matrix_way(spark, folder):
    docs = derived.kb_documents(spark, folder, embedded=True).where("embedding is not null")
    vector = docs.orderBy("key").first()["embedding"]
    asked = spark.createDataFrame([(1, vector, 7, None)], "query_id long, vector array<float>, max_results int, min_score double")
    native = (
        docs.select("key", F.round(vectors.cosine_similarity(F.col("embedding"), F.array(*[F.lit(x) for x in vector])), 6).alias("score"))
        .orderBy(F.desc("score"), "key").limit(7)
    )
    got = nearest.nearest(docs, asked).orderBy("rank").select("key", F.round("score", 6).alias("score"))
    assert got.collect() == native.collect()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("visits", [0, 10**9])
def test_visits_and_scans_give_the_same(spark, monkeypatch, metric, visits):
    """Requests with and without a bar, copies, no length and a null id, in several scans, against plain sums."""
    monkeypatch.setattr(cells, "VISITS", visits)
    monkeypatch.setattr(cells, "SCAN_VALUES", 12 * 7)
    monkeypatch.setattr(cells, "SCORES", 40)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(120, 12)).astype(np.float32)
    points[40:60], points[60] = points[3], 0
    docs = spark.createDataFrame([(f"k{i:03d}", p.tolist()) for i, p in enumerate(points)], "key string, embedding array<float>")
    asked = spark.createDataFrame(
        [(2**60 + i, points[i * 3 + 2].tolist(), 1 + i % 4, [None, 0.1, -1.5, 5.0][i % 4]) for i in range(30)] + [(None, points[0].tolist(), 2, None)],
        "query_id long, vector array<float>, max_results int, min_score double",
    )
    got = nearest.nearest(docs, asked, metric, 0)
    assert shown(got) == brute(docs.collect(), [q for q in asked.collect() if q["query_id"]], metric)


def test_a_request_does_not_visit_most_cells(spark, monkeypatch):
    """Vectors without structure: the triangle inequality rules out next to nothing."""
    monkeypatch.setattr(cells, "PIVOTS", 40)
    sent = []
    visited = cells._visited
    monkeypatch.setattr(cells, "_visited", lambda placed, visits, *a: sent.append(visits.count()) or visited(placed, visits, *a))
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 32)).astype(np.float32)
    docs = spark.createDataFrame([(f"k{i:03d}", p.tolist()) for i, p in enumerate(points)], "key string, embedding array<float>")
    asked = spark.createDataFrame([(i, p.tolist(), 3, 0.0) for i, p in enumerate(points[:60])], "query_id long, vector array<float>, max_results int, min_score double")
    got = nearest.nearest(docs, asked, "cosine", 0)
    assert shown(got) == brute(docs.collect(), asked.collect(), "cosine")
    # All 40 cells were visited by nearly each, with its vector.
    assert sum(sent) <= 60 * (1 + 6 + cells.VISITS)
