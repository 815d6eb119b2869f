"""Stored inverted index: the corpus is tokenised once, requests read only the buckets of their words.

A folder holds two tables.

* ``postings`` (bucket, word, key): one row per word and document, in one folder per
  bucket of words, sorted by word and key.  A bucket is split over several files by the key, so
  no task holds a word; row groups of other words are skipped when a word is read.
* ``words`` (word, documents, bucket): document frequencies, sorted by word over all files, so
  that a prefix reads a small part of it.

A request is answered from these two alone, without the texts: its rarest required clause gives
candidates, the other clauses are looked up for the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..session import bounded_rows, cut_lineage
from . import matching
from .ranking import largest, top_per_request, with_limits
from .search import fold_clauses, text_requests

#: Buckets of words.  More buckets make reads narrower and files smaller.
BUCKETS = 64
#: Classes of buckets that are dealt together, and characters of text whose words a task sorts.
CLASSES, PART_CHARS = 8, 16_000_000
#: Up to this many asked words travel with the scan of the postings.
SENT_WORDS = 100_000
_WORDS = "word string, documents long, bucket int"


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, column: str = "content", buckets: int = BUCKETS) -> None:
    """Index the words of a text column of ``docs`` in a new folder; a null text has no words.

    Keys that occur several times are one document that has the words of all its rows.
    """
    if buckets < 1:
        raise ValueError("an index needs a bucket")
    spark = docs.sparkSession
    dealt = _dealt(docs.where(F.col(column).isNotNull()).select("key", F.col(column).alias("text")), buckets)
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema(_postings_schema(docs)).parquet(f"{path}/postings")
    counted = written.groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.first("bucket").alias("bucket"))
    counted.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/words")


def _dealt(texts: DataFrame, buckets: int) -> DataFrame:
    """``(word, key, bucket)`` of each word and document once, in sorted partitions that hold a few buckets each.

    A document sends its words as one row per class of buckets, which is far smaller than a row per word.
    """
    worded = texts.select("key", F.array_distinct(text.tokens(F.col("text"))).alias("words"))
    size = texts.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    classes = min(CLASSES, buckets)
    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = -(-max(cores, -(-size // PART_CHARS)) // classes)
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")

    # Rows of one key are one document; only the words of keys that repeat are made distinct by a shuffle.
    repeated = cut_lineage(texts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("key").alias("repeated")))
    together = None
    if bounded_rows(repeated, 0) is None:
        same = F.col("key").eqNullSafe(F.col("repeated"))
        single = worded.join(repeated, same, "left_semi").select("key", F.explode("words").alias("word")).distinct()
        worded = worded.join(repeated, same, "left_anti")
        together = single.select("key", F.pmod(bucket_of(F.col("word"), buckets), F.lit(classes)).alias("class"), "word")
    numbered = F.transform("words", lambda w: F.struct(w.alias("word"), F.pmod(bucket_of(w, buckets), F.lit(classes)).alias("class")))
    # The one-element outer array numbers the words once per row.
    by_class = F.transform(
        F.array(numbered),
        lambda found: F.transform(
            F.sequence(F.lit(0), F.lit(classes - 1)),
            lambda c: F.struct(
                c.alias("class"),
                F.array_join(F.transform(F.filter(found, lambda w: w["class"] == c), lambda w: w["word"]), " ").alias("word"),
            ),
        ),
    )[0]
    packed = worded.select("key", F.explode(by_class).alias("some")).select("key", "some.class", "some.word").where("word <> ''")
    if together is not None:
        packed = packed.unionByName(together)
    sent = packed.repartitionById(classes * parts, F.col("class") * parts + part)
    # Tokens hold letters and digits only, so a space parts them.
    words = sent.select(F.explode(F.split("word", " ")).alias("word"), "key")
    return words.withColumn("bucket", bucket_of(F.col("word"), buckets)).sortWithinPartitions("bucket", "word", "key")


def _postings_schema(docs: DataFrame) -> str:
    return f"word string, key {docs.schema['key'].dataType.simpleString()}, bucket int"


class TextIndex:
    """An index that :func:`write_index` has written."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string") -> None:
        self.postings = spark.read.schema(f"word string, key {key_type}, bucket int").parquet(f"{path}/postings")
        self.words = spark.read.schema(_WORDS).parquet(f"{path}/words")

    def lookups(self, clauses: DataFrame) -> DataFrame:
        """``(query_id, i, prefix, word, documents, bucket)``: the indexed words that each clause stands for."""
        named = ["query_id", "i", "prefix", "word", "documents", "bucket"]
        exact = clauses.where("not prefix").join(self.words, "word").select(*named)
        begins = clauses.where("prefix").select("query_id", "i", "prefix", F.col("word").alias("beginning"))
        # A few beginnings become ranges, which skip the row groups of all other words.
        words = self.words
        few = bounded_rows(begins.select("beginning").distinct(), 64)
        if few is not None:
            ranges = F.lit(False)
            for row in few:
                ranges = ranges | F.startswith(F.col("word"), F.lit(row["beginning"]))
            words = words.where(ranges)
        found = matching.prefix_matches(words, begins.select("query_id", "i", F.col("prefix").alias("is_prefix"), F.col("beginning").alias("prefix")))
        return exact.unionByName(found.select("query_id", "i", F.col("is_prefix").alias("prefix"), "word", "documents", "bucket"))

    def asked(self, lookups: DataFrame) -> DataFrame:
        """Postings of the buckets that hold the words of ``lookups``; other buckets are not read.

        At most as many bucket numbers as there are buckets reach the driver.
        """
        buckets = [r["bucket"] for r in lookups.select("bucket").distinct().collect()]
        return self.postings.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    @staticmethod
    def _of_words(postings: DataFrame, lookups: DataFrame) -> DataFrame:
        """The postings of the words of ``lookups`` alone, unless those are too many to travel with the scan."""
        words = lookups.select("word").distinct()
        if words.limit(SENT_WORDS + 1).count() > SENT_WORDS:
            return postings
        return postings.join(F.broadcast(words), "word", "left_semi")

    def matches(self, requests: DataFrame) -> DataFrame:
        """All ``(query_id, key, max_results)`` whose words satisfy the request, as :func:`search.fulltext_matches` gives."""
        prepared = cut_lineage(text_requests(requests))
        last_or = F.array_max(F.transform("clauses", lambda c, i: F.when(c["op"] == "|", i).otherwise(0)))
        clauses = prepared.select("query_id", last_or.alias("last_or"), F.posexplode("clauses").alias("i", "clause")).select(
            "query_id", "i", "last_or", "clause.*"
        )
        lookups = cut_lineage(self.lookups(clauses))
        postings = self._of_words(self.asked(lookups), lookups).select("word", "key")

        # Clauses behind the last "|" must all hold; the rarest of them finds the candidates.
        # A request that ends in "|" needs the words of all its clauses.
        opening = (F.col("i") == 0) & (F.col("last_or") == 0)
        narrowing = opening | ((F.col("op") == "+") & (F.col("i") > F.col("last_or")))
        positive = clauses.where("op <> '-'").select("query_id", "i", narrowing.alias("required"))
        cost = positive.join(lookups.groupBy("query_id", "i").agg(F.sum("documents").alias("documents")), ["query_id", "i"], "left")
        cheapest = Window.partitionBy("query_id").orderBy(F.desc("required"), F.coalesce("documents", F.lit(0)), "i")
        chosen = (
            cost.withColumn("position", F.row_number().over(cheapest))
            .withColumn("any_required", F.max("required").over(Window.partitionBy("query_id")))
            .where((F.col("position") == 1) | ~F.col("any_required"))
            .select("query_id", "i")
        )
        leading = lookups.join(chosen, ["query_id", "i"]).select("query_id", "word").distinct()
        candidates = cut_lineage(leading.join(postings, "word").select("query_id", "key").distinct())

        # A word is looked up for each candidate; the many words of a prefix are looked up once.
        exact = candidates.join(lookups.where("not prefix").select("query_id", "i", "word"), "query_id")
        exact = exact.join(postings, ["word", "key"], "left_semi").select("query_id", "key", "i")
        begun = lookups.where("prefix").select("query_id", "i", "word").join(postings, "word")
        begun = begun.join(candidates, ["query_id", "key"], "left_semi").select("query_id", "key", "i")
        # At most one entry per clause of the request.
        hits = exact.unionByName(begun).groupBy("query_id", "key").agg(F.collect_set("i").alias("hits"))
        held = fold_clauses(F.col("clauses"), lambda clause, i: F.array_contains("hits", i))
        return hits.join(prepared, "query_id").where(held).select("query_id", "key", "max_results")

    def search(self, requests: DataFrame) -> DataFrame:
        """First ``max_results`` (10 if null) matches per request by key: ``(query_id, rank, key)``."""
        k = largest(with_limits(requests), "max_results")
        top = top_per_request(self.matches(requests), ["query_id"], [F.asc("key")], k, "max_results")
        return top.select("query_id", "rank", "key")
