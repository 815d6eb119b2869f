"""Typed links between documents and topics, and the topic tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..schemas import DOCUMENT_PREFIX, TOPIC_PREFIX
from ..session import cut_lineage


def document_id(key: Column | str) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), key)


def topic_id(key: Column | str) -> Column:
    return F.concat(F.lit(TOPIC_PREFIX), key)


def _bare_key(column: str, prefix: str) -> Column:
    return F.substring(F.col(column), F.lit(len(prefix) + 1), F.length(column))


def documents_by_topic(
    docs: DataFrame, links: DataFrame, topics: DataFrame | None = None, distinct: bool = False
) -> DataFrame:
    """Documents linked to a topic, one row per link: ``topic_key`` and the document columns.

    ``topics`` (column key) restricts the topics.  Links of every type count,
    subtopics do not.  ``distinct`` drops repeats caused by parallel links.
    """
    into_topics = links.where(
        F.startswith("to_id", F.lit(TOPIC_PREFIX)) & F.startswith("from_id", F.lit(DOCUMENT_PREFIX))
    ).select(
        _bare_key("to_id", TOPIC_PREFIX).alias("topic_key"),
        _bare_key("from_id", DOCUMENT_PREFIX).alias("key"),
    )
    if topics is not None:
        into_topics = into_topics.join(
            topics.select(F.col("key").alias("topic_key")), "topic_key", "left_semi"
        )
    if distinct:
        into_topics = into_topics.distinct()
    return into_topics.join(docs, "key")


def related_pairs(
    links: DataFrame, link_type: str | None = None, legacy_precedence: bool = False
) -> DataFrame:
    """``(key, related_key, type)`` for outgoing links and incoming bidirectional links.

    A type filters both directions; with ``legacy_precedence`` it only filters
    the incoming ones.  A link from a document to itself counts once.
    """
    between = links.where(
        F.startswith("from_id", F.lit(DOCUMENT_PREFIX)) & F.startswith("to_id", F.lit(DOCUMENT_PREFIX))
    ).select(
        _bare_key("from_id", DOCUMENT_PREFIX).alias("source"),
        _bare_key("to_id", DOCUMENT_PREFIX).alias("target"),
        "type",
        "bidirectional",
    )
    outgoing, incoming = between, between.where(
        F.col("bidirectional") & (F.col("source") != F.col("target"))
    )
    if link_type is not None:
        incoming = incoming.where(F.col("type") == link_type)
        if not legacy_precedence:
            outgoing = outgoing.where(F.col("type") == link_type)
    return outgoing.select(
        F.col("source").alias("key"), F.col("target").alias("related_key"), "type"
    ).unionByName(
        incoming.select(F.col("target").alias("key"), F.col("source").alias("related_key"), "type")
    )


def related_documents(
    docs: DataFrame,
    links: DataFrame,
    keys: DataFrame | None = None,
    link_type: str | None = None,
    legacy_precedence: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """``(key, related_key, related_title)`` for all documents or for a key table."""
    pairs = related_pairs(links, link_type, legacy_precedence).select("key", "related_key")
    pairs = pairs.join((docs if keys is None else keys).select("key"), "key", "left_semi")
    if distinct:
        pairs = pairs.distinct()
    titles = docs.select(F.col("key").alias("related_key"), F.col("title").alias("related_title"))
    return pairs.join(titles, "related_key").select("key", "related_key", "related_title")


def document_detail(docs: DataFrame, links: DataFrame, keys: DataFrame) -> DataFrame:
    """All display fields of the requested documents, followed by their related titles.

    A document gives one row with ``section = 'document'`` and one row with
    ``section = 'related'`` per related document.  Rows instead of a list keep
    a document with very many links out of a single cell.
    """
    asked = docs.join(keys.select("key").distinct(), "key", "left_semi")
    head = asked.select(
        "key",
        F.lit("document").alias("section"),
        "title",
        F.nullif("summary", F.lit("")).alias("summary"),
        F.array_join("tags", ", ").alias("tags"),
        F.col("metadata.created").alias("created"),
        F.col("metadata.updated").alias("updated"),
        F.col("metadata.version").alias("version"),
        F.col("metadata.source").alias("source"),
        F.col("metadata.creator").alias("creator"),
        "confidence",
        "content",
    )
    related = related_documents(docs, links, asked).withColumn("section", F.lit("related"))
    return head.unionByName(related, allowMissingColumns=True)


def topic_contents(docs: DataFrame, links: DataFrame, topics: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested topics with their documents, one row per link.

    ``status`` is ``not_found`` for an unknown topic, ``empty`` for a topic
    without documents and ``ok`` otherwise; ``documents`` counts the links.
    """
    asked = keys.select(F.col("key").alias("topic_key")).distinct()
    named = asked.join(
        topics.select(F.col("key").alias("topic_key"), F.col("name").alias("topic_name")),
        "topic_key",
        "left",
    )
    known = named.where(F.col("topic_name").isNotNull()).select(F.col("topic_key").alias("key"))
    shown = documents_by_topic(docs, links, known).select(
        "topic_key",
        "key",
        "title",
        F.nullif("summary", F.lit("")).alias("summary"),
        F.array_join("tags", ", ").alias("tags"),
        text.inline_content(F.col("content")).alias("content"),
    )
    # Counted from the links alone, before any text is attached.
    counts = (
        documents_by_topic(docs.select("key"), links, known)
        .groupBy("topic_key")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
    return (
        named.join(counts, "topic_key", "left")
        .join(shown, "topic_key", "left")
        .withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))
        .withColumn(
            "status",
            F.when(F.col("topic_name").isNull(), "not_found")
            .when(F.col("documents") == 0, "empty")
            .otherwise("ok"),
        )
    )


def topic_hierarchy(topics: DataFrame) -> DataFrame:
    """Reachable topics with their depth and path: ``(key, name, root, depth, path)``.

    A topic without a parent, or with a parent that does not exist, is a root.
    Topics in or below a cycle are not reachable and do not appear.  ``path``
    alternates names and keys from the root down; sorting by it lists the tree
    in preorder with children in name order.

    Every round joins the topics to themselves and doubles the distance each of
    them looks up, so a tree of depth d takes about log2(d) rounds.
    """
    bare = topics.select("key", "name", "description", "parent_topic")
    parents = bare.select(F.col("key").alias("parent_topic"), F.lit(True).alias("known"))
    start = bare.join(parents, "parent_topic", "left").select(
        "key",
        "name",
        "description",
        F.when(F.col("known"), F.col("parent_topic")).alias("above"),
        F.array("name", "key").alias("path"),
    )
    reached = cut_lineage(start)
    open_topics = reached.where(F.col("above").isNotNull()).count()
    while open_topics:
        upper = reached.select(
            F.col("key").alias("above"),
            F.col("above").alias("next_above"),
            F.col("path").alias("upper_path"),
        )
        reached = cut_lineage(
            reached.join(upper, "above", "left").select(
                "key",
                "name",
                "description",
                F.col("next_above").alias("above"),
                F.when(
                    F.col("upper_path").isNotNull(), F.concat("upper_path", "path")
                ).otherwise(F.col("path")).alias("path"),
            )
        )
        still_open = reached.where(F.col("above").isNotNull()).count()
        if still_open == open_topics:
            # A tree has topics at every depth down to its deepest, so a round
            # that finishes none leaves only topics in or below cycles.
            break
        open_topics = still_open
    return reached.where(F.col("above").isNull()).select(
        "key",
        "name",
        "description",
        F.col("path")[1].alias("root"),
        (F.size("path") / 2 - 1).cast("int").alias("depth"),
        "path",
    )


def topic_outline(topics: DataFrame) -> DataFrame:
    """The tree in preorder, with a label indented by depth."""
    tree = topic_hierarchy(topics)
    return tree.orderBy("path").select(
        "key", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name").alias("label"), "path"
    )
