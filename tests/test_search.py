"""Searches against brute force, and the inlined way against the join way."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lorecairn.functions import text
from lorecairn.operators import matching, search, suggest
from lorecairn.sources import derived
from tests.conftest import requests


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WEIGHTS = {"title": 1.0, "content": 0.5, "summary": 0.8, "tags": 0.7}


def weighted(doc, terms):
    scores = []
    for t in terms:
        scores += [
            WEIGHTS["title"] * (t in doc["title"].lower()),
            WEIGHTS["content"] * (t in doc["content"].lower()),
            WEIGHTS["summary"] * (t in (doc["summary"] or "").lower()),
            WEIGHTS["tags"] * any(t in g.lower() for g in doc["tags"]),
        ]
    return sum(scores) / len(scores)


@pytest.mark.parametrize("inline", [None, 0])
def test_smart_search_equals_brute_force(spark, docs, inline):
    asked = requests(
        spark,
        ("running things", 10, 0.1),
        ("needle", 10, 0.1),
        ("go words", 2, 0.05),
        ("the of", 10, 0.1),
        ("", 10, 0.1),
    )
    got = {
        (r["query_id"], r["key"]): round(r["score"], 6)
        for r in search.smart_search(docs, asked, inline).collect()
    }
    terms = {1: ["running", "runn", "things", "thing"], 2: ["needle"], 3: ["go", "words", "word"]}
    floors = {1: 0.1, 2: 0.1, 3: 0.05}
    expected = {}
    for q, words in terms.items():
        found = [(round(weighted(d, words), 6), d["key"]) for d in docs.collect()]
        kept = sorted((-s, k) for s, k in found if s >= floors[q])
        for s, k in kept[: 2 if q == 3 else 10]:
            expected[(q, k)] = -s
    assert got == expected


def test_score_equal_to_the_threshold_passes(spark, docs):
    # Content and tag of one term: (0.5 + 0.7) / 4.
    for inline in (None, 0):
        found = search.smart_search(docs, requests(spark, ("word", 10, 0.3)), inline)
        assert [(r["key"], r["score"]) for r in found.collect()] == [("f", 0.3)]


@pytest.mark.parametrize("low", [0.3, 0.1])
def test_both_ways_agree_on_real_requests(spark, folder, low):
    docs = derived.kb_documents(spark, folder)
    asked = derived.kb_queries(spark, folder, 5, low)
    inlined = search.smart_search(docs, asked, inline=10_000)
    assert rows(inlined) == rows(search.smart_search(docs, asked, inline=0))


@pytest.mark.parametrize("inline", [None, 0])
def test_threshold_zero_lets_documents_without_a_match_pass(spark, docs, inline):
    asked = requests(spark, ("needle", 4, 0.0), ("absent", 2, 0.0), ("the", 5, 0.0))
    got = rows(search.smart_search(docs, asked, inline).select("query_id", "rank", "key", "score"))
    assert got == [
        (1, 1, "f", 0.125), (1, 2, "a", 0.0), (1, 3, "b", 0.0), (1, 4, "c", 0.0),
        (2, 1, "a", 0.0), (2, 2, "b", 0.0),
    ]


def test_term_matches_finds_terms_inside_long_words_and_long_terms(spark, docs):
    long_term = "z" * 70
    terms = spark.createDataFrame([("needle",), ("zneedlez",), (long_term,), ("z" * 301,), ("ink",)], "term string")
    expected = [("c", "ink"), ("f", long_term), ("f", "needle"), ("f", "zneedlez")]
    for inline in (None, 0):
        got = rows(matching.term_matches(docs, terms, ["title", "content"], inline))
        assert got == sorted(expected)


def test_prefix_matches(spark):
    vocabulary = spark.createDataFrame([("thing",), ("thinking-about-it",), ("",)], "word string")
    prefixes = spark.createDataFrame([("thin",), ("thinking-abo",), ("thinking-xx",)], "prefix string")
    assert rows(matching.prefix_matches(vocabulary, prefixes)) == [
        ("thing", "thin"),
        ("thinking-about-it", "thin"),
        ("thinking-about-it", "thinking-abo"),
    ]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_edit_matches_equal_brute_force(spark, distance):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abü") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    terms = words[::9] + ["a", "zz", "abababababab"]
    expected = sorted((w, t) for w in words for t in set(terms) if edit_distance(w, t) <= distance)
    vocabulary = spark.createDataFrame([(w,) for w in words], "word string")
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    assert rows(matching.edit_matches(vocabulary, wanted, distance, inline=0)) == expected
    assert rows(matching.edit_matches(vocabulary, wanted, distance, inline=1000)) == expected


FULLTEXT = [
    ("thing", {"a", "d", "e"}),
    ("thing running", {"a", "d", "e"}),
    ("needle", set()),
    ("nothing, |thing", {"a", "b", "d", "e"}),
    ("thing, -fast", set()),
    ("prefix:no", {"b"}),
    ("prefix:in, -ink", set()),
    ("-thing", set()),
    ("-thing, |nothing", {"b"}),
    ("|ink, |nothing, -prefix:here", {"c"}),
    (" ,; ", set()),
    ("fast prefix:runn", {"a", "d", "e"}),
]


@pytest.mark.parametrize("inline", [None, 0])
def test_fulltext_operators(spark, docs, inline):
    asked = requests(spark, *[(q, 10, None) for q, _ in FULLTEXT])
    got = {i: set() for i in range(1, len(FULLTEXT) + 1)}
    for r in search.fulltext_search(docs, asked, inline=inline).collect():
        got[r["query_id"]].add(r["key"])
    assert [got[i] for i in sorted(got)] == [keys for _, keys in FULLTEXT]


def test_fulltext_ways_agree_on_real_requests(spark, folder):
    docs = derived.kb_documents(spark, folder)
    words = derived.kb_queries(spark, folder).withColumn("query", F.substring("query", 1, 14))
    odd = F.concat(F.lit("prefix:th, |"), "query", F.lit(", -le"))
    asked = words.unionByName(
        words.select(F.col("query_id") + 1_000_000, odd.alias("query"), "max_results", "min_score")
        .withColumnRenamed("(query_id + 1000000)", "query_id")
    )
    inlined = search.fulltext_matches(docs, asked, inline=10_000)
    joined = search.fulltext_matches(docs, asked, inline=0)
    assert inlined.count() > 0
    assert rows(inlined) == rows(joined)


def test_limit_takes_the_first_keys(spark, docs):
    found = search.fulltext_search(docs, requests(spark, ("thing", 2, None)))
    assert rows(found) == [(1, 1, "a"), (1, 2, "d")]


@pytest.mark.parametrize("inline", [None, 0])
def test_fuzzy_equals_difflib(spark, folder, inline):
    docs = derived.kb_documents(spark, folder)
    queries = ["die ungen keit der einheit und zu", "que le leau, eaux", "the of"]
    asked = requests(spark, *[(q, 1000, 0.25) for q in queries])
    expected = []
    for i, query in enumerate(queries, 1):
        cleaned = " ".join(query.replace(",", "").split())
        terms = [t for t in cleaned.split() if t not in text.STOP_WORDS]
        for d in docs.select("key", "title", "content").collect():
            body = (d["title"] + " " + d["content"]).lower()
            if any(t in body for t in terms):
                score = SequenceMatcher(None, body, cleaned).ratio()
                if score >= 0.25:
                    expected.append((i, d["key"], score))
    got = search.fuzzy_search(docs, asked, inline)
    assert rows(got.select("query_id", "key", "score")) == sorted(expected)
    assert expected


@pytest.mark.parametrize("inline", [None, 0])
def test_typo_score_is_the_share_of_terms(spark, docs, inline):
    terms = ["runing", "thong", "zzzzzzz"]
    expected = {}
    for d in docs.collect():
        words = re.findall(r"[a-z0-9]+", (d["title"] + " " + d["content"]).lower())
        close = sum(any(edit_distance(w, t) <= 2 for w in words) for t in terms)
        if close:
            expected[d["key"]] = round(close / 3, 6)
    found = search.typo_search(docs, requests(spark, ("thong runing, zzzzzzz", 10, 0.3)), inline=inline)
    assert {r["key"]: round(r["score"], 6) for r in found.collect()} == expected
    assert set(expected.values()) == {0.333333, 0.666667}


def test_keyword_requests_are_clamped_and_dispatched(spark, docs):
    asked = spark.createDataFrame(
        [(1, "thing", 0, "content"), (2, "x", 99, "TAGS"), (3, "copy", 5, "title"), (4, "thing", 5, "summary")],
        "query_id long, query string, max_results int, search_in string",
    )
    got = rows(search.keyword_search(docs, asked).select("query_id", "rank", "key"))
    assert got == [(1, 1, "a"), (2, 1, "a"), (3, 1, "d"), (3, 2, "e")]


def test_listing_skips_blank_requests(spark, docs):
    asked = spark.createDataFrame([(1, "  "), (2, " thing ")], "query_id long, query string")
    assert rows(search.search_listing(docs, asked).select("query_id", "key", "preview")) == [
        (2, "a", "The thing was RUNNING, fast things."),
        (2, "d", "The thing was RUNNING, fast things."),
        (2, "e", "s"),
    ]


def test_retrieve_takes_three_by_default(spark, docs):
    asked = requests(spark, ("thing", None, None))
    assert [r["key"] for r in search.retrieve_knowledge(docs, asked).orderBy("rank").collect()] == list("ade")


def test_tag_counts_count_repeats(spark, docs):
    counts = {r["tag"]: (r["uses"], r["documents"]) for r in suggest.tag_counts(docs).collect()}
    assert counts["x"] == (2, 1) and counts["y"] == (2, 2) and counts["go"] == (1, 1)


@pytest.mark.parametrize("inline", [None, 0])
def test_related_terms(spark, docs, inline):
    terms = spark.createDataFrame([("thing",), ("go",), ("absent",)], "term string")
    got = {
        (r["term"], r["word"]): r["documents"]
        for r in suggest.related_terms(docs, terms, limit=50, inline=inline).collect()
    }
    assert got[("thing", "fast")] == 3
    assert got[("thing", "y")] == 2  # tags count, whatever their length
    assert ("thing", "thing") not in got
    assert got[("go", "go")] == 1  # a tag may equal the term
    assert not [k for k in got if k[0] == "absent"]


@pytest.mark.parametrize("inline", [None, 0])
def test_similar_queries(spark, docs, inline):
    asked = requests(spark, ("fast, things!", 3, None), ("the", 3, None))
    got = rows(suggest.similar_queries(docs, asked, inline=inline))
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (1, 3)]
    assert all(g[2].startswith("fast things ") for g in got)
    assert not {"fast things fast", "fast things things"} & {g[2] for g in got}


def test_blank_prefix_suggests_tags_and_words_keep_punctuation(spark, docs):
    asked = requests(spark, ("!", 2, None), ("g", 5, None))
    got = rows(suggest.suggest_terms(docs, asked).select("query_id", "rank", "term", "source"))
    assert got == [(1, 1, "x", "tag"), (1, 2, "y", "tag"), (2, 1, "Go", "tag"), (2, 2, "go", "tag")]


@pytest.mark.parametrize("find", [search.smart_search, search.fulltext_search, search.fuzzy_search, search.typo_search])
def test_both_ways_agree_on_types_and_limits(spark, docs, find):
    rows = [("n", "running things", None, None), ("z", "running things", 0, 0.3), ("m", "running things", -1, -0.5)]
    rows += [("o", "running things", 2, 0.0), ("p", "other nothing", 1, 1.0), ("e", "", 5, 0.1)]
    asked = spark.createDataFrame(rows, "query_id string, query string, max_results int, min_score double")
    small, large = find(docs, asked), find(docs, asked, inline=0)
    assert [(f.name, f.dataType) for f in small.schema] == [(f.name, f.dataType) for f in large.schema]
    assert sorted(small.collect()) == sorted(large.collect())
    found = [r["query_id"] for r in small.collect()]
    assert found.count("n") > 0 and "z" not in found and "m" not in found


def test_fuzzy_threshold_of_zero_accepts_every_candidate(spark, docs):
    # Candidates have a term in title or content; "c" has one in its summary only.
    kind = "query_id int, query string, max_results int, min_score double"
    for least in (0.0, -1.0):
        asked = spark.createDataFrame([(1, "running things", 50, least)], kind)
        assert {r["key"] for r in search.fuzzy_search(docs, asked).collect()} == {"a", "d", "e"}
