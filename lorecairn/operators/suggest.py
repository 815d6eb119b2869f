"""Tag and term statistics, suggestions, related terms and similar requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from . import matching
from .ranking import largest, top_per_request

# Fixed values -------------------------------------------------------------
TOP_TAGS = 5
RELATED_TERMS = 5
SIMILAR_QUERIES = 3
# ---------------------------------------------------------------------------


def tag_counts(docs: DataFrame) -> DataFrame:
    """Uses of every tag; ``uses`` counts repeats inside a document, ``documents`` does not."""
    tags = F.explode(F.array_distinct("tags")).alias("tag")
    # A document contributes one row per distinct tag that carries its repeats.
    per_document = docs.select("tags", tags).select(
        "tag", F.size(F.filter("tags", lambda t: t == F.col("tag"))).alias("repeats")
    )
    return per_document.groupBy("tag").agg(
        F.sum("repeats").alias("uses"), F.count(F.lit(1)).alias("documents")
    )


def list_tags(docs: DataFrame) -> DataFrame:
    return tag_counts(docs).orderBy(F.desc("uses"), "tag")


def top_tags(docs: DataFrame, limit: int = TOP_TAGS) -> DataFrame:
    return list_tags(docs).limit(limit)


def suggest_terms(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Terms that continue a partial request: ``(query_id, rank, term, source, uses)``.

    Title words and tags are counted apart, so a term can appear once as each.
    A blank request gets the most used tags.
    """
    asked = requests.select("query_id", "max_results", text.clean_query(F.col("query")).alias("prefix"))
    k = largest(requests, "max_results")
    typed = asked.where("prefix <> ''")
    title_words = (
        docs.select(F.explode(F.split(F.lower("title"), " ")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    tags = tag_counts(docs).select(F.col("tag").alias("term"), "uses")
    from_titles = matching.prefix_matches(title_words, typed).select(
        "query_id", "max_results", F.col("word").alias("term"), F.lit("word").alias("source"), "uses"
    )
    from_tags = matching.prefix_matches(
        tags.withColumn("word", F.lower("term")), typed
    ).select("query_id", "max_results", "term", F.lit("tag").alias("source"), "uses")
    # Every blank request gets the same k tags, carried as one short list.
    best = tags.orderBy(F.desc("uses"), "term").limit(k)
    best_tags = best.agg(F.collect_list(F.struct("term", "uses"))).scalar()
    for_blank = (
        asked.where("prefix = ''")
        .select("query_id", "max_results", F.explode(best_tags).alias("best"))
        .select("query_id", "max_results", "best.term", F.lit("tag").alias("source"), "best.uses")
    )
    found = from_titles.unionByName(from_tags).unionByName(for_blank)
    order = [F.desc("uses"), F.asc("term"), F.asc("source")]
    return top_per_request(found, ["query_id"], order, k, "max_results").select(
        "query_id", "rank", "term", "source", "uses"
    )


def related_terms(
    docs: DataFrame, terms: DataFrame, limit: int = RELATED_TERMS, inline: int | None = None
) -> DataFrame:
    """Words and tags that share documents with each term: ``(term, rank, word, documents)``.

    A document counts when its content or title contains the term or a tag
    equals it.
    """
    small = matching.inline_terms(terms, inline)
    title_and_content = F.array_union(
        text.related_words(F.col("content")), text.related_words(F.col("title"))
    )
    if small is not None:
        equal_tags = F.filter(
            matching.string_array(small), lambda t: F.array_contains(F.col("tags"), t)
        )
        inside = matching.terms_inside(small, [F.col("content"), F.col("title")])
        matched = docs.select(
            F.explode(F.array_union(inside, equal_tags)).alias("term"),
            title_and_content.alias("words"),
            "tags",
        )
    else:
        wanted = terms.select("term").distinct()
        by_text = matching.term_matches(docs, wanted, ["content", "title"], inline=0)
        by_tag = docs.select("key", F.explode("tags").alias("term")).join(wanted, "term")
        pairs = by_text.unionByName(by_tag.select("key", "term")).distinct()
        matched = pairs.join(
            docs.select("key", title_and_content.alias("words"), "tags"), "key"
        )
    # Tags keep their case and length; only words are filtered against the term.
    vocabulary = F.array_union(
        F.filter("words", lambda w: w != F.col("term")), F.array_distinct("tags")
    )
    counted = (
        matched.select("term", F.explode(vocabulary).alias("word"))
        .groupBy("term", "word")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
    order = [F.desc("documents"), F.asc("word")]
    return top_per_request(counted, ["term"], order, limit).select(
        "term", "rank", "word", "documents"
    )


def similar_queries(
    docs: DataFrame,
    requests: DataFrame,
    limit: int = SIMILAR_QUERIES,
    inline: int | None = None,
) -> DataFrame:
    """Requests extended by a related term: ``(query_id, rank, suggestion)``."""
    cleaned = text.clean_query(F.col("query"))
    asked = requests.select("query_id", cleaned.alias("cleaned"))
    wanted = asked.select(
        "query_id", F.explode(text.extract_terms(F.col("cleaned"))).alias("term")
    )
    related = related_terms(docs, wanted, inline=inline).select("term", "word", "documents")
    fresh = (
        wanted.join(related, "term")
        .groupBy("query_id", "word")
        .agg(F.max("documents").alias("documents"))
        .join(wanted.withColumnRenamed("term", "word"), ["query_id", "word"], "left_anti")
    )
    order = [F.desc("documents"), F.asc("word")]
    return (
        top_per_request(fresh, ["query_id"], order, limit)
        .join(asked, "query_id")
        .select("query_id", "rank", F.concat_ws(" ", "cleaned", "word").alias("suggestion"))
    )
