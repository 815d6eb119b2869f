"""Links and the topic tree, with the awkward cases."""

import pytest
from pyspark.sql import functions as F

from lorecairn.operators import graph
from lorecairn.schemas import RELATIONSHIPS, TOPICS


@pytest.fixture(scope="module")
def links(spark):
    rows = [
        ("documents/a", "documents/b", "related", True),
        ("documents/a", "documents/b", "related", True),  # parallel
        ("documents/c", "documents/c", "cites", True),  # to itself
        ("documents/a", "documents/zz", "cites", True),  # to a missing document
        ("documents/d", "documents/a", "cites", False),
        ("documents/e", "documents/a", "cites", True),
        ("documents/a", "topics/t1", "belongs_to", False),
        ("documents/b", "topics/t1", "about", True),
        ("documents/zz", "topics/t1", "belongs_to", False),
        ("topics/t1", "documents/a", "covers", True),
    ]
    return spark.createDataFrame([(f, t, k, 0.5, b, None) for f, t, k, b in rows], RELATIONSHIPS)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_related_documents(docs, links):
    got = pairs(graph.related_documents(docs, links), "key", "related_key")
    assert got == [("a", "b"), ("a", "b"), ("a", "e"), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "a")]


def test_related_distinct_and_for_some_keys(spark, docs, links):
    keys = spark.createDataFrame([("a",), ("missing",)], "key string")
    got = pairs(graph.related_documents(docs, links, keys, distinct=True), "key", "related_key")
    assert got == [("a", "b"), ("a", "e")]


def test_type_filters_both_directions_unless_legacy(docs, links):
    strict = graph.related_documents(docs, links, link_type="related", distinct=True)
    assert pairs(strict, "key", "related_key") == [("a", "b"), ("b", "a")]
    legacy = graph.related_documents(docs, links, link_type="related", legacy_precedence=True, distinct=True)
    assert pairs(legacy, "key", "related_key") == [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "a")]


def test_documents_by_topic_takes_any_link_type(docs, links):
    assert pairs(graph.documents_by_topic(docs, links), "topic_key", "key") == [("t1", "a"), ("t1", "b")]


def topics_of(spark, rows):
    return spark.createDataFrame([(k, n, "d", p, None) for k, n, p in rows], TOPICS)


def test_topic_contents_reports_every_request(spark, docs, links):
    topics = topics_of(spark, [("t1", "One", None), ("t2", "Two", None)])
    keys = spark.createDataFrame([("t1",), ("t2",), ("t9",), ("t1",)], "key string")
    got = pairs(graph.topic_contents(docs, links, topics, keys), "topic_key", "status", "documents", "key")
    assert got == [("t1", "ok", 2, "a"), ("t1", "ok", 2, "b"), ("t2", "empty", 0, None), ("t9", "not_found", 0, None)]


def test_detail_without_links_is_one_row(spark, docs, links):
    keys = spark.createDataFrame([("f",), ("a",), ("missing",)], "key string")
    got = graph.document_detail(docs, links, keys)
    assert pairs(got.where("key = 'f'"), "section", "summary") == [("document", None)]
    assert got.where("key = 'a' and section = 'related'").count() == 3
    assert got.where("key = 'missing'").count() == 0


def test_hierarchy_roots_cycles_and_depth(spark):
    rows = [("r", "root", None), ("e", "empty parent", ""), ("o", "orphan", "gone"), ("s", "self", "s")]
    rows += [("c1", "x", "c2"), ("c2", "y", "c1"), ("u", "under a cycle", "c1")]
    rows += [(f"n{i}", f"level {i}", f"n{i - 1}" if i else "r") for i in range(37)]
    tree = {r["key"]: r for r in graph.topic_hierarchy(topics_of(spark, rows)).collect()}
    assert set(tree) == {"r", "e", "o"} | {f"n{i}" for i in range(37)}
    assert [tree[k]["depth"] for k in ("r", "e", "o", "n0", "n36")] == [0, 0, 0, 1, 37]
    assert tree["n36"]["root"] == "r"
    assert tree["n1"]["path"] == ["root", "r", "level 0", "n0", "level 1", "n1"]


def test_outline_is_preorder_with_children_in_name_order(spark):
    rows = [("1", "B", None), ("2", "A", None), ("3", "z", "2"), ("4", "a", "2"), ("5", "q", "4"), ("6", "a", "2")]
    labels = [(r["key"], r["label"]) for r in graph.topic_outline(topics_of(spark, rows)).collect()]
    assert labels == [("2", "A"), ("4", "  a"), ("5", "    q"), ("6", "  a"), ("3", "  z"), ("1", "B")]


def test_only_cycles_gives_nothing(spark):
    assert graph.topic_hierarchy(topics_of(spark, [("a", "a", "b"), ("b", "b", "a")])).count() == 0
