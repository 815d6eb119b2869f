"""Text functions against plain Python."""

import string

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lorecairn.functions import text


def evaluate(spark, values, fn):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(fn(F.col("v")).alias("r"))
    return [r["r"] for r in rows.collect()]


TEXTS = [
    "",
    "  ",
    "The QUICK, brown-fox's!\tjumps\nover",
    "Éà ß   x",
    "a an the I of ox",
    "running runs kiss red ing s ed eds",
]


def test_clean_query_matches_python(spark):
    table = str.maketrans("", "", string.punctuation)
    expected = [" ".join(t.lower().translate(table).split()) for t in TEXTS]
    assert evaluate(spark, TEXTS, text.clean_query) == expected


def test_punctuation_is_the_ascii_set():
    assert text.PUNCTUATION == string.punctuation


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F, exclude_characters="\x00İ"), max_size=20), min_size=1, max_size=20))
def test_clean_query_on_random_texts(spark, values):
    table = str.maketrans("", "", string.punctuation)
    expected = [" ".join(t.lower().translate(table).split()) for t in values]
    assert evaluate(spark, values, text.clean_query) == expected


def test_terms_drop_stop_words_and_single_letters(spark):
    got = evaluate(spark, TEXTS, lambda c: text.extract_terms(text.clean_query(c)))
    assert got[0] == [] and got[1] == []
    assert got[4] == ["of", "ox"]
    assert got[5] == ["ed", "eds", "ing", "kiss", "red", "running", "runs"]


def test_expansion_keeps_terms_and_drops_empty_stems(spark):
    got = evaluate(
        spark,
        ["running runs kiss red ing ed eds"],
        lambda c: text.expand_terms(text.extract_terms(text.clean_query(c))),
    )[0]
    # "ing" and "ed" would leave nothing; "eds" and "runs" lose their s.
    assert got == sorted(["running", "runn", "runs", "run", "kiss", "red", "r", "ing", "ed", "eds"])


def test_parse_tags(spark):
    got = evaluate(spark, [" a, b ,,c c ,", None, " , "], text.parse_tags)
    assert got == [["a", "b", "c c"], [], []]


@pytest.mark.parametrize(
    "tags,add,remove,expected",
    [
        (["x", "x", "y"], ["z", "z", "y"], [], ["x", "x", "y", "z"]),
        (["x", "x", "y"], ["z"], ["y", "z"], ["x", "x"]),
        ([], ["b", "a"], [], ["b", "a"]),
    ],
)
def test_retag_keeps_order_and_duplicates(spark, tags, add, remove, expected):
    row = spark.createDataFrame([(tags, add, remove)], "t array<string>, a array<string>, r array<string>")
    assert row.select(text.retag(F.col("t"), F.col("a"), F.col("r"))).first()[0] == expected


def test_snippet_boundaries_and_preview(spark):
    assert evaluate(spark, ["x" * 200, "x" * 201], text.snippet) == ["x" * 200, "x" * 200 + "..."]
    got = evaluate(spark, ["body"], lambda c: F.array(
        text.preview(F.lit(None).cast("string"), c), text.preview(F.lit(""), c), text.preview(F.lit("s"), c)
    ))
    assert got == [["body", "body", "s"]]


def test_inline_content_only_below_the_limit(spark):
    assert evaluate(spark, ["x" * 999, "x" * 1000], text.inline_content) == ["x" * 999, None]


def test_embedding_text_keeps_the_gap_of_a_missing_summary(spark):
    got = evaluate(spark, ["c"], lambda c: F.array(
        text.embedding_text(F.lit("t"), F.lit(None).cast("string"), c),
        text.embedding_text(F.lit("t"), F.lit("s"), c),
    ))
    assert got == [["t  c", "t s c"]]


def test_related_words_split_at_single_spaces(spark):
    assert evaluate(spark, ["Some (words), here\nnext  far a"], text.related_words) == [
        ["some", "words", "here\nnext"]
    ]
