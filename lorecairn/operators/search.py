"""Full-text, weighted multi-field, fuzzy and typo-tolerant search over request tables.

Requests are rows.  A few requests are inlined into one scan of the documents;
a large request table goes through equi joins.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import DataType

from ..functions import text
from ..functions.fuzzy import ratio
from ..session import bounded_rows, cut_lineage
from . import matching, pairs
from .ranking import DEFAULT_SCORE, EPSILON, attach_documents, clamp_results, largest, top_per_request, with_limits

#: Up to this many requests are inlined into the document scan.
INLINE_REQUESTS = 64
#: ... as long as their terms stay below this many characters.
INLINE_CHARS = 16_384

# Fixed values -------------------------------------------------------------
# Field weights in tenths, so that scores are exact whole numbers until the end.
TITLE, CONTENT, SUMMARY, TAGS = 10, 5, 8, 7
FIELDS = 4
MAX_DISTANCE = 2
RETRIEVE_LIMIT = 3
LISTING_LIMIT = 20
SEARCH_FIELDS = ("content", "title", "summary")
# ---------------------------------------------------------------------------


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc("key")]


def _inline(requests: DataFrame, inline: int | None) -> list[Row] | None:
    rows = bounded_rows(requests, INLINE_REQUESTS if inline is None else inline)
    if rows is not None and sum(len(str(r)) for r in rows) > INLINE_CHARS:
        return None
    return rows


# --- weighted multi-field search -------------------------------------------


def _search_requests(requests: DataFrame) -> DataFrame:
    expanded = text.expand_terms(text.extract_terms(text.clean_query(F.col("query"))))
    return with_limits(requests, score=DEFAULT_SCORE).select(
        "query_id", "max_results", F.col("min_score").cast("double"), expanded.alias("terms")
    ).where(F.size("terms") > 0)


def _short_fields() -> Column:
    """Lower-cased fields that are cheap to test; tags are joined by a character no term has."""
    return F.struct(
        F.lower("title").alias("title"),
        F.lower(F.coalesce("summary", F.lit(""))).alias("summary"),
        F.lower(F.array_join("tags", "\n")).alias("tags"),
    )


def _short_score(fields: Column, terms: Column) -> Column:
    def weight(field: str, term: Column, tenths: int) -> Column:
        return F.when(F.contains(fields[field], term), tenths).otherwise(0)

    return F.aggregate(
        terms,
        F.lit(0),
        lambda total, t: total
        + weight("title", t, TITLE)
        + weight("summary", t, SUMMARY)
        + weight("tags", t, TAGS),
    )


def _content_score(content: Column, terms: Column) -> Column:
    return F.transform(
        F.array(F.lower(content)),
        lambda c: F.aggregate(
            terms,
            F.lit(0),
            lambda total, t: total + F.when(F.contains(c, t), CONTENT).otherwise(0),
        ),
    )[0]


def _needed(min_score: Column, terms: Column) -> Column:
    """Tenths a document has to reach."""
    return (min_score - EPSILON) * (10 * FIELDS) * F.size(terms)


def _finish(partial: DataFrame) -> DataFrame:
    """Add the content score and keep the rows that reach their threshold."""
    total = F.col("short") + _content_score(F.col("content"), F.col("terms"))
    # Exploding a one-element list scores every row once; a plain filter would
    # be merged with the projection and score it twice.
    passing = F.filter(F.array(total), lambda t: t >= F.col("needed"))
    return partial.select(
        "query_id", "key", "max_results", "terms", F.explode(passing).alias("tenths")
    ).select(
        "query_id",
        "key",
        "max_results",
        (F.col("tenths") / (10.0 * FIELDS * F.size("terms"))).alias("score"),
    )


def smart_search(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Weighted search: ``(query_id, rank, key, score)``.

    ``requests`` has query_id, query, max_results and min_score.  Every expanded
    term scores per field (title 1.0, summary 0.8, tags 0.7, content 0.5); the
    score is the mean over terms and fields.  A request without terms has no
    results; null limits are 10 results and a score of 0.3.
    """
    prepared = _search_requests(requests)
    rows = _inline(prepared, inline)
    if rows is not None:
        k = max((r["max_results"] for r in rows), default=0)
        scored = _finish(_smart_scan(docs, rows, prepared.schema["query_id"].dataType))
    else:
        k, scored = _smart_join(docs, prepared)
    top = top_per_request(scored, ["query_id"], _best_first(), k, "max_results")
    return top.select("query_id", "rank", "key", "score")


def _smart_scan(docs: DataFrame, rows: list[Row], id_type: DataType) -> DataFrame:
    if not rows:
        return docs.limit(0).select(
            F.lit(None).cast(id_type).alias("query_id"),
            "key",
            "content",
            F.lit(0).alias("max_results"),
            F.array().cast("array<string>").alias("terms"),
            F.lit(0).alias("short"),
            F.lit(0.0).alias("needed"),
        )
    inlined = F.array(
        *[
            F.struct(
                F.lit(r["query_id"]).cast(id_type).alias("query_id"),
                F.lit(r["max_results"]).alias("max_results"),
                F.lit(float(r["min_score"])).alias("min_score"),
                matching.string_array(r["terms"]).alias("terms"),
            )
            for r in rows
        ]
    )
    hits = F.transform(
        F.array(_short_fields()),
        lambda fields: F.filter(
            F.transform(
                inlined,
                lambda q: F.struct(
                    q["query_id"].alias("query_id"),
                    q["max_results"].alias("max_results"),
                    q["terms"].alias("terms"),
                    _short_score(fields, q["terms"]).alias("short"),
                    _needed(q["min_score"], q["terms"]).alias("needed"),
                ),
            ),
            lambda h: h["short"] + CONTENT * F.size(h["terms"]) >= h["needed"],
        ),
    )[0]
    return docs.select("key", "content", F.explode(hits).alias("hit")).select(
        "key", "content", "hit.*"
    )


def _smart_join(docs: DataFrame, requests: DataFrame) -> tuple[int, DataFrame]:
    requests = cut_lineage(requests)
    bounds = requests.agg(F.max("max_results").alias("k"), F.min("min_score").alias("low")).first()
    # With a threshold above what content alone can give, some term must occur
    # in a short field, and the long contents need not be indexed at all.
    content_alone = CONTENT / (10.0 * FIELDS)
    short_only = bounds["low"] is not None and bounds["low"] - EPSILON > content_alone
    columns = ["title", "summary", "tag_text"] + ([] if short_only else ["content"])
    per_term = TITLE + SUMMARY + TAGS + (0 if short_only else CONTENT)
    spare = CONTENT if short_only else 0

    n = F.size("terms")
    needed = _needed(F.col("min_score"), F.col("terms"))
    least_matches = F.greatest(F.lit(1), F.ceil((needed - spare * n) / per_term).cast("int"))
    wanted = requests.select(
        "query_id", F.explode("terms").alias("term"), (n - least_matches + 1).alias("prefix")
    )
    k = int(bounds["k"] or 0)
    if short_only:
        # The pairs are too many to be written: requests travel with scans of the texts.
        lowered = docs.select("key", _short_fields().alias("fields"), F.lower("content").alias("content"))
        texts, again = pairs.grouped(lowered.select("key", "fields.*", "content"))
        opened = wanted.select("query_id", "term").withColumn("opens", F.lit(True))
        if again or pairs.repeats(requests, "query_id"):
            # Weights of repeated rows add up, so a pair may reach its bar without any of the rarest terms.
            rare = _rarest(_matches(docs, wanted, columns), wanted).distinct().withColumn("opens", F.lit(True))
            opened = wanted.select("query_id", "term").join(rare, ["query_id", "term"], "left")
        bars = requests.groupBy("query_id").agg(F.min(needed - CONTENT * n).alias("bar"))
        rows = requests.withColumn("needed", needed).select("query_id", "max_results", "needed", "terms")
        return k, pairs.reaching(texts, opened, bars, rows, k, (TITLE, SUMMARY, TAGS, CONTENT))
    # Used for the frequencies and for the candidates, so it is computed once.
    matches = cut_lineage(_matches(docs, wanted, columns))
    rare = _rarest(matches, wanted)
    fields = docs.select("key", _short_fields().alias("fields")).select("key", "fields.*")

    def weight(field: str, tenths: int) -> Column:
        return F.when(F.contains(F.col(field), F.col("term")), tenths).otherwise(0)

    tenths = weight("title", TITLE) + weight("summary", SUMMARY) + weight("tags", TAGS)
    candidates = matches.join(rare, "term").select("query_id", "key")
    if bounds["low"] is not None and bounds["low"] <= EPSILON:
        # Documents without any match pass too.  They rank last, by key, so the
        # first k keys of the table hold all of them a request can still take.
        first = docs.select("key").orderBy("key").limit(k).agg(F.collect_list("key")).scalar()
        candidates = candidates.unionByName(
            requests.where(F.col("min_score") <= EPSILON).select(
                "query_id", F.explode(first).alias("key")
            )
        )
    candidates = candidates.distinct()
    # The short fields decide which pairs fetch the long content at all.  Terms
    # are rows here, so that millions of pairs stay in generated code.
    short = (
        candidates.join(fields, "key")
        .join(wanted.select("query_id", "term"), "query_id")
        .groupBy("query_id", "key")
        .agg(F.sum(tenths).cast("int").alias("short"))
    )
    return k, _finish(_reaching(docs, requests, short))


def _matches(docs: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    fields = docs.select(
        "key", "title", "summary", F.array_join("tags", "\n").alias("tag_text"), "content"
    )
    return matching.term_matches(fields, wanted, columns, inline=0)


def _rarest(matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """The terms that generate candidates; hot terms only take part in scoring.

    A document that matches m of n terms matches one of any n - m + 1 of them, so also of the rarest.
    """
    frequency = matches.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    order = Window.partitionBy("query_id").orderBy(
        F.coalesce("documents", F.lit(0)), F.col("term")
    )
    return (
        wanted.join(frequency, "term", "left")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= F.col("prefix"))
        .select("query_id", "term")
    )


def _reaching(docs: DataFrame, requests: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs that a content could still lift to their threshold, with the content."""
    needed = _needed(F.col("min_score"), F.col("terms"))
    partial = (
        short.join(requests.withColumn("needed", needed).drop("min_score"), "query_id")
        .where(F.col("short") + CONTENT * F.size("terms") >= F.col("needed"))
        .select("query_id", "key", "max_results", "terms", "needed", "short")
    )
    return partial.join(docs.select("key", "content"), "key")


# --- full-text search --------------------------------------------------------


def _clauses(query: Column) -> Column:
    """Clauses of a full-text request, in order.

    Words are separated by white space or commas.  ``|w`` adds documents,
    ``-w`` removes documents, ``prefix:w`` matches word beginnings and all
    other words narrow the result.
    """
    parts = F.filter(F.split(F.lower(query), r"[\s,]+"), lambda p: p != "")

    def parse(part: Column) -> Column:
        op = F.left(part, F.lit(1))
        has_op = op.isin("|", "-", "+")
        body = F.when(has_op, F.substring(part, F.lit(2), F.length(part))).otherwise(part)
        is_prefix = F.startswith(body, F.lit("prefix:"))
        word = F.when(is_prefix, F.substring(body, F.lit(8), F.length(body))).otherwise(body)
        return F.transform(
            text.tokens(word),
            lambda t: F.struct(
                F.when(has_op, op).otherwise("+").alias("op"),
                is_prefix.alias("prefix"),
                t.alias("word"),
            ),
        )

    return F.flatten(F.transform(parts, parse))


def fold_clauses(clauses: Column, hit: Callable[[Column, Column], Column]) -> Column:
    """Evaluate the clauses from left to right; ``hit`` says whether a clause, given with its place, is met."""
    numbered = F.transform(clauses, lambda c, i: F.struct(c.alias("clause"), i.alias("i")))

    def step(so_far: Column, item: Column) -> Column:
        clause, i = item["clause"], item["i"]
        met = hit(clause, i)
        return (
            F.when(clause["op"] == "-", so_far & ~met)
            .when((clause["op"] == "|") | (i == 0), so_far | met)
            .otherwise(so_far & met)
        )

    return F.aggregate(numbered, F.lit(False), step)


def _fold(clauses: Column, found: Column) -> Column:
    """Evaluate the clauses against the tokens of a document."""

    def hit(clause: Column, i: Column) -> Column:
        return F.when(
            clause["prefix"], F.exists(found, lambda t: F.startswith(t, clause["word"]))
        ).otherwise(F.array_contains(found, clause["word"]))

    return fold_clauses(clauses, hit)


def text_requests(requests: DataFrame) -> DataFrame:
    """Requests that have clauses, with their limits."""
    return with_limits(requests).select(
        "query_id", "max_results", _clauses(F.col("query")).alias("clauses")
    ).where(F.size("clauses") > 0)


def fulltext_matches(
    docs: DataFrame, requests: DataFrame, column: str = "content", inline: int | None = None
) -> DataFrame:
    """All ``(query_id, key, max_results)`` whose words satisfy the request."""
    prepared = text_requests(requests)
    rows = _inline(prepared, inline)
    searched = docs.where(F.col(column).isNotNull())
    if rows is not None:
        return _fulltext_scan(searched, rows, column, prepared.schema["query_id"].dataType)
    return _fulltext_join(searched, prepared, column)


def fulltext_search(
    docs: DataFrame, requests: DataFrame, column: str = "content", inline: int | None = None
) -> DataFrame:
    """First ``max_results`` (10 if null) matches per request by key: ``(query_id, rank, key)``."""
    matches = fulltext_matches(docs, requests, column, inline)
    k = largest(with_limits(requests), "max_results")
    top = top_per_request(matches, ["query_id"], [F.asc("key")], k, "max_results")
    return top.select("query_id", "rank", "key")


def _fulltext_scan(docs: DataFrame, rows: list[Row], column: str, id_type: DataType) -> DataFrame:
    if not rows:
        return docs.limit(0).select(
            F.lit(None).cast(id_type).alias("query_id"), "key", F.lit(0).alias("max_results")
        )
    inlined = F.array(
        *[
            F.struct(
                F.lit(r["query_id"]).cast(id_type).alias("query_id"),
                F.lit(r["max_results"]).alias("max_results"),
                F.array(
                    *[
                        F.struct(
                            F.lit(c["op"]).alias("op"),
                            F.lit(c["prefix"]).alias("prefix"),
                            F.lit(c["word"]).alias("word"),
                        )
                        for c in r["clauses"]
                    ]
                ).alias("clauses"),
            )
            for r in rows
        ]
    )

    hits = F.transform(
        F.array(text.tokens(F.col(column))),
        lambda found: F.filter(inlined, lambda q: _fold(q["clauses"], found)),
    )[0]
    return docs.select("key", F.explode(hits).alias("hit")).select(
        "hit.query_id", "key", "hit.max_results"
    )


def _fulltext_join(docs: DataFrame, requests: DataFrame, column: str) -> DataFrame:
    found = text.tokens(F.col(column))
    postings = docs.select("key", F.explode(F.array_distinct(found)).alias("word"))
    vocabulary = postings.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))

    # Narrowing clauses after the last "|" must all hold; one of them, the
    # rarest, finds the candidates.  A request that ends in "|" needs them all.
    last_or = F.array_max(
        F.transform("clauses", lambda c, i: F.when(c["op"] == "|", i).otherwise(0))
    )
    clauses = requests.select(
        "query_id", last_or.alias("last_or"), F.posexplode("clauses").alias("i", "clause")
    ).select("query_id", "i", "last_or", "clause.*")
    narrowing = (F.col("op") == "+") & (F.col("i") > F.col("last_or"))
    opening = (F.col("op") != "-") & (F.col("i") == 0) & (F.col("last_or") == 0)
    positive = clauses.where("op <> '-'").withColumn("required", narrowing | opening)
    exact = positive.where("not prefix").join(vocabulary, "word", "left").select(
        "query_id", "i", "required", "word", F.coalesce("documents", F.lit(0)).alias("documents")
    )
    begins = positive.where("prefix").select("query_id", "i", "required", F.col("word").alias("prefix"))
    extended = matching.prefix_matches(vocabulary, begins).select(
        "query_id", "i", "required", "word", "documents"
    )
    lookups = exact.unionByName(extended)
    cost = positive.select("query_id", "i", "required").join(
        lookups.groupBy("query_id", "i").agg(F.sum("documents").alias("documents")),
        ["query_id", "i"],
        "left",
    )
    cheapest = Window.partitionBy("query_id").orderBy(
        F.desc("required"), F.coalesce("documents", F.lit(0)), F.col("i")
    )
    chosen = (
        cost.withColumn("position", F.row_number().over(cheapest))
        .withColumn("any_required", F.max("required").over(Window.partitionBy("query_id")))
        .where((F.col("position") == 1) | ~F.col("any_required"))
        .select("query_id", "i")
    )
    candidates = (
        lookups.select("query_id", "i", "word")
        .join(chosen, ["query_id", "i"])
        .join(postings, "word")
        .select("query_id", "key")
        .distinct()
    )
    return (
        candidates.join(docs.select("key", found.alias("found")), "key")
        .join(requests, "query_id")
        .where(_fold(F.col("clauses"), F.col("found")))
        .select("query_id", "key", "max_results")
    )


def keyword_search(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Dispatch on ``requests.search_in`` (content, title, summary or tags).

    Gives numbered display rows.  A tag request takes the documents carrying
    exactly that tag, newest first; the other fields use full-text search.
    """
    wanted = requests.withColumn("max_results", clamp_results(F.col("max_results")))
    field = F.lower("search_in")
    known = wanted.withColumn(
        "field", F.when(field.isin("title", "summary", "tags"), field).otherwise("content")
    )
    by_text = [
        fulltext_search(docs, known.where(F.col("field") == name), name, inline)
        for name in SEARCH_FIELDS
    ]
    results = by_text[0].unionByName(by_text[1]).unionByName(by_text[2])
    results = results.unionByName(_tag_search(docs, known.where(F.col("field") == "tags")))
    return attach_documents(results, docs, listing_columns()).select(
        "query_id", "rank", "key", "title", "preview", "tags", "created"
    )


def _tag_search(docs: DataFrame, requests: DataFrame) -> DataFrame:
    tagged = docs.select(
        "key", "metadata.created", F.explode(F.array_distinct("tags")).alias("query")
    )
    matches = tagged.join(requests.select("query_id", "query", "max_results"), "query")
    order = [F.desc("created"), F.asc("key")]
    k = largest(requests, "max_results")
    top = top_per_request(matches, ["query_id"], order, k, "max_results")
    return top.select("query_id", "rank", "key")


def listing_columns() -> list[Column]:
    return [
        F.col("title"),
        text.preview(F.col("summary"), F.col("content")).alias("preview"),
        F.array_join("tags", ", ").alias("tags"),
        F.col("metadata.created").alias("created"),
    ]


def search_listing(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Full-text listing of at most 20 documents per non-blank request."""
    asked = requests.withColumn("query", text.strip(F.col("query"))).where("query <> ''")
    wanted = asked.withColumn("max_results", F.lit(LISTING_LIMIT))
    return attach_documents(fulltext_search(docs, wanted, inline=inline), docs, listing_columns())


def retrieve_knowledge(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Whole top documents of a full-text request, three unless the request says otherwise."""
    wanted = requests.withColumn(
        "max_results", F.coalesce(F.col("max_results"), F.lit(RETRIEVE_LIMIT))
    )
    shown = [
        F.col("title"),
        F.array_join("tags", ", ").alias("tags"),
        F.col("metadata.updated").alias("updated"),
        F.col("confidence"),
        F.col("content"),
    ]
    return attach_documents(fulltext_search(docs, wanted, inline=inline), docs, shown)


# --- fuzzy and typo-tolerant search ------------------------------------------


def _fuzzy_requests(requests: DataFrame) -> DataFrame:
    cleaned = text.clean_query(F.col("query"))
    return with_limits(requests, score=DEFAULT_SCORE).select(
        "query_id",
        "max_results",
        F.col("min_score").cast("double"),
        cleaned.alias("cleaned"),
        text.extract_terms(cleaned).alias("terms"),
    ).where(F.size("terms") > 0)


def _length_bound(document: Column, query: Column) -> Column:
    """Largest ratio two texts of these lengths can reach."""
    return F.coalesce(2.0 * F.least(document, query) / F.nullif(document + query, F.lit(0)), F.lit(1.0))


def fuzzy_search(docs: DataFrame, requests: DataFrame, inline: int | None = None) -> DataFrame:
    """Sequence-ratio search: ``(query_id, rank, key, score)``.

    Candidates contain a request term in title or content.  The ratio of the
    whole text to the whole cleaned request is only computed where the lengths
    allow the threshold.  Null limits are 10 results and a score of 0.3; a threshold
    of 0 or less accepts every candidate.
    """
    prepared = _fuzzy_requests(requests).withColumn("query_size", F.length("cleaned"))
    searched = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    sized = docs.withColumn("size", F.length(searched))
    # No request can accept a document longer than the loosest of them does.
    bounds = prepared.agg(
        F.max("max_results").alias("k"),
        F.max(F.when(F.col("min_score") > 0, F.col("query_size") * (2.0 / F.col("min_score") - 1.0))).alias("longest"),
        F.max((F.col("min_score") <= 0).cast("int")).alias("any_length"),
    ).first()
    if bounds["longest"] is not None and not bounds["any_length"]:
        sized = sized.where(F.col("size") <= bounds["longest"] + 1.0)
    fits = _length_bound(F.col("size"), F.col("query_size")) >= F.col("min_score") - EPSILON
    wanted = prepared.select(
        "query_id", "query_size", "min_score", F.explode("terms").alias("term")
    )
    candidates = (
        matching.term_matches(sized, wanted, ["title", "content"], inline, carry=("size",))
        .join(wanted, "term")
        .where(fits)
        .select("query_id", "key")
        .distinct()
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = sized.select("key", text.searchable_text(F.col("title"), F.col("content")).alias("text"))
    scored = (
        candidates.join(texts, "key")
        .join(prepared.select("query_id", "cleaned", "min_score", "max_results"), "query_id")
        # The ratio costs far more than its bytes suggest, so the number of
        # tasks is fixed here and a hot request spreads over all of them.
        .repartition(tasks, "key", "query_id")
        .withColumn("score", ratio("text", "cleaned"))
        .where(F.col("score") >= F.col("min_score"))
        .select("query_id", "key", "score", "max_results")
    )
    k = int(bounds["k"] or 0)
    top = top_per_request(scored, ["query_id"], _best_first(), k, "max_results")
    return top.select("query_id", "rank", "key", "score")


def typo_matches(
    docs: DataFrame,
    requests: DataFrame,
    max_distance: int = MAX_DISTANCE,
    inline: int | None = None,
) -> DataFrame:
    """Share of a request's terms that have a word within ``max_distance`` edits.

    Gives ``(query_id, key, matched, terms, score)`` for every document with a match.
    """
    prepared = requests.select(
        "query_id", text.extract_terms(text.clean_query(F.col("query"))).alias("terms")
    ).where(F.size("terms") > 0)
    wanted = prepared.select("query_id", F.explode("terms").alias("term"))
    body = F.concat(F.col("title"), F.lit(" "), F.col("content"))
    postings = docs.select(
        "key", F.explode(F.array_distinct(text.tokens(body))).alias("word")
    )
    vocabulary = postings.select("word").distinct()
    pairs = matching.edit_matches(vocabulary, wanted, max_distance, inline)
    found = postings.join(pairs, "word").select("key", "term").distinct()
    counted = found.join(wanted, "term").groupBy("query_id", "key").agg(
        F.count(F.lit(1)).alias("matched")
    )
    return counted.join(
        prepared.select("query_id", F.size("terms").alias("terms")), "query_id"
    ).withColumn("score", F.col("matched") / F.col("terms"))


def typo_search(
    docs: DataFrame,
    requests: DataFrame,
    max_distance: int = MAX_DISTANCE,
    inline: int | None = None,
) -> DataFrame:
    """Best typo-tolerant matches per request, filtered by ``min_score``; null limits are 10 and 0.3."""
    requests = with_limits(requests, score=DEFAULT_SCORE)
    limits = requests.select("query_id", "max_results", "min_score")
    scored = (
        typo_matches(docs, requests, max_distance, inline)
        .join(limits, "query_id")
        .where(F.col("score") >= F.col("min_score") - EPSILON)
    )
    k = largest(requests, "max_results")
    top = top_per_request(scored, ["query_id"], _best_first(), k, "max_results")
    return top.select("query_id", "rank", "key", "score")
