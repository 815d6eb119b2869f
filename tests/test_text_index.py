"""The stored index against the search that reads the texts."""

import pytest
from pyspark.sql import functions as F

from lorecairn.operators import search, text_index
from lorecairn.sources import derived

from .conftest import requests

REQUESTS = [
    ("thing fast", 10, None),
    ("Thing, |ink", 5, None),
    ("red |ink -things", 50, None),
    ("the, -of", 500, None),
    ("prefix:thi, -prefix:ing", 100, None),
    ("prefix:i", 100, None),
    ("-thing", 10, None),
    ("-thing fast", 10, None),
    ("|fast", 10, None),
    ("|fast |missing word", 10, None),
    ("missing", 10, None),
    ("word prefix:zzz", 10, None),
    ("fast fast", None, None),
    ("  ,; ", 10, None),
    (None, 10, None),
    ("fast", 0, None),
]


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "words")
    nulls = docs.where("key = 'a'").withColumn("key", F.lit("n")).withColumn("content", F.lit(None).cast("string"))
    again = docs.where("key = 'a'").withColumn("content", F.lit("other fast words"))
    whole = docs.unionByName(nulls).unionByName(again)
    text_index.write_index(whole, path, buckets=16)
    return text_index.TextIndex(spark, path)


def test_index_answers_like_the_texts(spark, docs, stored):
    asked = requests(spark, *REQUESTS)
    want = {tuple(r) for r in search.fulltext_matches(docs, asked).collect()}
    got = stored.matches(asked).collect()
    extra = {(r.query_id, r.key) for r in got} - {(q, k) for q, k, _ in want}
    assert len(got) == len({tuple(r) for r in got})
    assert {(q, k) for q, k, _ in want} <= {(r.query_id, r.key) for r in got}
    # The second row of document "a" adds its words.
    assert all(k == "a" for _, k in extra)


def test_index_of_the_test_table(spark, folder, tmp_path):
    docs = derived.kb_documents(spark, folder)
    text_index.write_index(docs, str(tmp_path / "index"))
    asked = requests(spark, *REQUESTS, ("die und der", 200, None), ("prefix:th |que -und", 200, None), ("prefix:a prefix:b", 200, None))
    want = search.fulltext_search(docs, asked, inline=0)
    assert {tuple(r) for r in text_index.TextIndex(spark, str(tmp_path / "index")).search(asked).collect()} == {tuple(r) for r in want.collect()}


def test_only_the_buckets_of_the_words_are_read(spark, stored):
    clauses = spark.createDataFrame([(1, 0, False, "fast")], "query_id int, i int, prefix boolean, word string")
    lookups = stored.lookups(clauses)
    [row] = lookups.collect()
    asked = stored.asked(lookups)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {row.bucket})]" in plan
    assert [r.bucket for r in asked.select("bucket").distinct().collect()] == [row.bucket]
    assert row.documents == 3


def test_words_count_documents(stored):
    counted = {r.word: r.documents for r in stored.words.collect()}
    found = stored.postings.groupBy("word").count().collect()
    assert counted == {r["word"]: r["count"] for r in found}
    assert stored.postings.count() == stored.postings.distinct().count()


def test_repeated_and_null_keys_are_one_document_each(spark, tmp_path):
    rows = [("a", "red ink red"), ("b", "blue ink"), ("a", "ink two"), (None, "red one"), (None, "one"), ("c", None), ("d", " ,")]
    docs = spark.createDataFrame(rows, "key string, content string").repartition(4)
    text_index.write_index(docs, str(tmp_path / "index"), buckets=3)
    index = text_index.TextIndex(spark, str(tmp_path / "index"))
    want = [("blue", "b"), ("ink", "a"), ("ink", "b"), ("one", None), ("red", "a"), ("red", None), ("two", "a")]
    assert sorted([(r.word, r.key) for r in index.postings.collect()], key=str) == sorted(want, key=str)
    assert {r.word: r.documents for r in index.words.collect()} == {"blue": 1, "ink": 2, "one": 1, "red": 2, "two": 1}


def test_a_document_sends_its_words_in_few_rows(spark):
    docs = spark.createDataFrame([(str(i), " ".join(f"w{j}" for j in range(i, i + 100))) for i in range(50)], "key string, text string")
    dealt = text_index._dealt(docs, 64)
    assert dealt.count() == 5000
    # One exchange of packed rows by their place; every row of a word was sent twice before.
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionBy") + plan.count("Rebalance") == 1 and "Aggregate" not in plan


def test_postings_of_other_words_are_left_out(spark, stored, monkeypatch):
    lookups = spark.createDataFrame([("fast",)], "word string")
    assert {r.word for r in stored._of_words(stored.postings, lookups).collect()} == {"fast"}
    monkeypatch.setattr(text_index, "SENT_WORDS", 0)
    assert stored._of_words(stored.postings, lookups).count() == stored.postings.count()


def test_empty_table(spark, docs, tmp_path):
    text_index.write_index(docs.limit(0), str(tmp_path / "none"))
    index = text_index.TextIndex(spark, str(tmp_path / "none"))
    assert index.search(requests(spark, *REQUESTS)).count() == 0
    with pytest.raises(ValueError, match="needs a bucket"):
        text_index.write_index(docs, str(tmp_path / "other"), buckets=0)
