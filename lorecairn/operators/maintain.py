"""Batch forms of the write operations: command tables in, new tables and outcomes out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..functions.vectors import hash_embedding
from .. import schemas
from ..session import cut_lineage
from .graph import document_id, topic_id
from .replay import apply_tag_changes, fold_tag_operations


@dataclass(frozen=True)
class Change:
    """Result of a command table: the tables after it and one outcome per command."""

    outcomes: DataFrame
    documents: DataFrame | None = None
    topics: DataFrame | None = None
    links: DataFrame | None = None


def _embedding(title: str, summary: str, content: str) -> Column:
    return hash_embedding(text.embedding_text(F.col(title), F.col(summary), F.col(content)))


def content_key(*columns: str) -> Column:
    """Deterministic key of a row that came without one."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def with_keys(commands: DataFrame, *columns: str) -> DataFrame:
    """``commands`` with a key in every row: repeats of one content are numbered, so each gets its own."""
    hashed = commands.withColumn("__content", content_key(*columns))
    order = [F.col(c) for c in ("seq",) if c in commands.columns] or [F.monotonically_increasing_id()]
    nth = F.row_number().over(Window.partitionBy("__content").orderBy(*order))
    # Only rows without a key are numbered.
    bare = hashed.where("key is null").withColumn("__nth", nth)
    made = F.when(F.col("__nth") == 1, F.col("__content")).otherwise(F.concat_ws("-", "__content", "__nth"))
    named = bare.withColumn("key", made).select(*commands.columns)
    return hashed.where("key is not null").select(*commands.columns).unionByName(named)


def _known(commands: DataFrame, table: DataFrame, column: str, flag: str) -> DataFrame:
    """Add ``flag``: whether ``column`` is a key of ``table``."""
    keys = table.select(F.col("key").alias(column), F.lit(True).alias(flag))
    return commands.join(keys, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def link_metadata(now: str) -> Column:
    return F.create_map(
        F.lit("created"), F.lit(now), F.lit("creator"), F.lit(schemas.DEFAULT_CREATOR)
    )


def new_documents(commands: DataFrame, now: str) -> DataFrame:
    """Document rows of store commands: key, title, content, tags_csv, summary, creator.

    Key, summary and creator may be null.
    """
    keyed = with_keys(commands, "title", "content")
    metadata = F.struct(
        F.lit(schemas.DEFAULT_SOURCE).alias("source"),
        F.coalesce("creator", F.lit(schemas.DEFAULT_CREATOR)).alias("creator"),
        F.lit(now).alias("created"),
        F.lit(now).alias("updated"),
        F.lit(1).alias("version"),
    )
    return keyed.select(
        "key",
        "title",
        "content",
        text.parse_tags(F.col("tags_csv")).alias("tags"),
        metadata.alias("metadata"),
        "summary",
        F.lit(schemas.DEFAULT_CONFIDENCE).alias("confidence"),
        _embedding("title", "summary", "content").alias("embedding"),
        F.lit(schemas.DEFAULT_STATUS).alias("status"),
    )


def topic_links(pairs: DataFrame, now: str) -> DataFrame:
    """Link rows from ``(key, topic_key)``: document belongs to topic."""
    return pairs.select(
        document_id("key").alias("from_id"),
        topic_id("topic_key").alias("to_id"),
        F.lit(schemas.TOPIC_LINK_TYPE).alias("type"),
        F.lit(schemas.TOPIC_LINK_STRENGTH).alias("strength"),
        F.lit(False).alias("bidirectional"),
        link_metadata(now).alias("metadata"),
    )


def store_documents(
    commands: DataFrame, topics: DataFrame, now: str, docs: DataFrame | None = None
) -> Change:
    """New documents and topic links of a batch of store commands.

    A document whose topic does not exist is stored without a link.  With ``docs``, the
    documents so far, commands with a key that is there already are refused, and so
    are all but one of the commands that name one key; keyless copies are numbered.
    """
    keyed = with_keys(commands, "title", "content")
    refused = None
    if docs is not None:
        first = F.row_number().over(Window.partitionBy("key").orderBy("title", "content"))
        judged = _known(keyed.withColumn("first", first), docs, "key", "taken")
        refused = judged.where("taken or first > 1").select("key", F.lit("key_exists").alias("status"))
        keyed = judged.where("not taken and first = 1").select(*commands.columns)
    checked = _known(
        keyed.select("key", F.nullif("topic_key", F.lit("")).alias("topic_key")),
        topics,
        "topic_key",
        "topic_known",
    )
    outcomes = checked.select(
        "key",
        F.when(F.col("topic_key").isNull(), "stored")
        .when(F.col("topic_known"), "stored_and_linked")
        .otherwise("stored_topic_not_found")
        .alias("status"),
    )
    return Change(
        outcomes=outcomes if refused is None else outcomes.unionByName(refused),
        documents=new_documents(keyed, now),
        links=topic_links(checked.where("topic_known"), now),
    )


def _blank_to_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _fold_updates(commands: DataFrame) -> DataFrame:
    """One row per key with the net effect of its update commands in ``seq`` order."""
    ordered = commands if "seq" in commands.columns else commands.withColumn("seq", F.lit(0))

    def last(column: Column) -> Column:
        return F.max_by(column, F.when(column.isNotNull(), F.col("seq")))

    fields = ordered.groupBy("key").agg(
        last(_blank_to_null("title")).alias("new_title"),
        last(_blank_to_null("content")).alias("new_content"),
        last(F.col("summary")).alias("new_summary"),
        F.count(F.lit(1)).cast("int").alias("updates"),
    )

    def operations(column: str, adds: bool) -> DataFrame:
        # Within one command tags are added in list order and removed afterwards.
        return ordered.select(
            "key", "seq", F.posexplode(text.parse_tags(F.col(column))).alias("position", "tag")
        ).select(
            "key",
            "tag",
            F.lit(adds).alias("adds"),
            F.struct("seq", F.lit(0 if adds else 1).alias("phase"), "position").alias("at"),
        )

    tags = fold_tag_operations(
        operations("add_tags", True).unionByName(operations("remove_tags", False))
    )
    return fields.join(tags, "key", "left")


def update_documents(docs: DataFrame, commands: DataFrame, now: str) -> Change:
    """Apply updates: key, title, content, summary, add_tags, remove_tags and, optionally, seq.

    A null or empty title or content keeps the old one.  A null summary keeps
    the old one and an empty one clears it.  Tags are added where absent and
    removed afterwards.  Every update counts a version up, and the document is
    embedded anew.  ``seq`` orders several updates of one key.
    """
    folded = _fold_updates(commands)
    touched = (
        docs.join(folded, "key")
        .withColumn("title", F.coalesce("new_title", "title"))
        .withColumn("content", F.coalesce("new_content", "content"))
        .withColumn("summary", F.coalesce("new_summary", "summary"))
        .withColumn("tags", apply_tag_changes(F.col("tags"), F.col("removed"), F.col("added")))
        .withColumn(
            "metadata",
            F.col("metadata")
            .withField("updated", F.lit(now))
            .withField("version", F.col("metadata.version") + F.col("updates")),
        )
        .withColumn("embedding", _embedding("title", "summary", "content"))
        .select(*docs.columns)
    )
    untouched = docs.join(commands.select("key"), "key", "left_anti")
    outcomes = _known(commands.select("key"), docs, "key", "known").select(
        "key", F.when(F.col("known"), "updated").otherwise("not_found").alias("status")
    )
    return Change(outcomes=outcomes, documents=touched.unionByName(untouched))


def _without(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links that touch none of ``ids.id``, as two equi joins."""
    return links.join(ids, links["from_id"] == ids["id"], "left_anti").join(
        ids, links["to_id"] == ids["id"], "left_anti"
    )


def delete_documents(docs: DataFrame, links: DataFrame, keys: DataFrame) -> Change:
    """Delete documents together with every link from or to them."""
    asked = keys.select("key").distinct()
    existing = asked.join(docs.select("key"), "key", "left_semi")
    outcomes = _known(asked, docs, "key", "known").select(
        "key", F.when(F.col("known"), "deleted").otherwise("not_found").alias("status")
    )
    return Change(
        outcomes=outcomes,
        documents=docs.join(asked, "key", "left_anti"),
        links=_without(links, existing.select(document_id("key").alias("id"))),
    )


def create_topics(topics: DataFrame, commands: DataFrame, now: str) -> Change:
    """Create topics from key, name, description and parent_topic.

    A key that is there already is refused, and so is an unknown parent; a parent may come
    from the same table.  Keyless copies are numbered.
    """
    keyed = with_keys(commands, "name", "description")
    wanted = keyed.withColumn("parent_topic", _blank_to_null("parent_topic"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("name", "description"))
    fresh = _known(wanted.withColumn("first", first), topics, "key", "taken").withColumn(
        "taken", F.col("taken") | (F.col("first") > 1)
    )
    # A parent may be created by the same table: each pass accepts one more level below what exists.
    judged = cut_lineage(fresh.withColumn("accepted", ~F.col("taken") & F.col("parent_topic").isNull()))
    before = -1
    while (accepted := judged.where("accepted").count()) != before:
        before = accepted
        there = topics.select("key").unionByName(judged.where("accepted").select("key"))
        step = _known(judged, there, "parent_topic", "parent_known")
        judged = cut_lineage(
            step.withColumn("accepted", ~F.col("taken") & (F.col("parent_topic").isNull() | F.col("parent_known"))).drop("parent_known")
        )
    checked = judged
    metadata = F.create_map(
        F.lit("created"),
        F.lit(now),
        F.lit("creator"),
        F.lit(schemas.DEFAULT_CREATOR),
        F.lit("importance"),
        F.lit(schemas.DEFAULT_IMPORTANCE),
    )
    created = checked.where("accepted").select(
        "key", "name", "description", "parent_topic", metadata.alias("metadata")
    )
    outcomes = checked.select(
        "key",
        F.when(F.col("taken"), "key_exists").when(F.col("accepted"), "created").otherwise("parent_not_found").alias("status"),
    )
    return Change(outcomes=outcomes, topics=created)


def update_topics(topics: DataFrame, commands: DataFrame) -> Change:
    """Apply updates: key, name, description, parent_topic and, optionally, seq.

    Empty or null name and description keep the old value.  A null parent keeps
    the old one, an empty one makes the topic a root and any other must exist,
    or the whole command is refused.  ``seq`` orders several updates of one key.
    """
    ordered = commands if "seq" in commands.columns else commands.withColumn("seq", F.lit(0))
    checked = _known(
        _known(ordered, topics, "key", "known"), topics, "parent_topic", "parent_known"
    )
    names_parent = F.coalesce(F.col("parent_topic") != "", F.lit(False))
    judged = checked.withColumn(
        "status",
        F.when(~F.col("known"), "not_found")
        .when(names_parent & ~F.col("parent_known"), "parent_not_found")
        .otherwise("updated"),
    )

    def last(column: Column) -> Column:
        return F.max_by(column, F.when(column.isNotNull(), F.col("seq")))

    accepted = judged.where("status = 'updated'").groupBy("key").agg(
        last(_blank_to_null("name")).alias("new_name"),
        last(_blank_to_null("description")).alias("new_description"),
        last(F.col("parent_topic")).alias("new_parent"),
    )
    fixed = ("key", "name", "description", "parent_topic")
    updated = topics.join(accepted, "key", "left").select(
        "key",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_description", "description").alias("description"),
        F.nullif(F.coalesce("new_parent", "parent_topic"), F.lit("")).alias("parent_topic"),
        *[c for c in topics.columns if c not in fixed],
    )
    return Change(outcomes=judged.select("key", "status"), topics=updated)


def delete_topics(docs: DataFrame, links: DataFrame, topics: DataFrame, keys: DataFrame) -> Change:
    """Delete topics without documents, together with their links.

    A topic that any existing document links to is refused.  Children keep
    their parent key and so become roots.
    """
    asked = keys.select("key").distinct()
    ids = asked.select("key", topic_id("key").alias("to_id"))
    # The links of the asked topics first, then the check that their documents exist.
    used = (
        links.join(ids, "to_id")
        .join(docs.select(document_id("key").alias("from_id")), "from_id", "left_semi")
        .select("key")
        .distinct()
    )
    judged = _known(
        _known(asked, topics, "key", "known"), used, "key", "used"
    ).select(
        "key",
        F.when(~F.col("known"), "not_found")
        .when(F.col("used"), "has_documents")
        .otherwise("deleted")
        .alias("status"),
    )
    gone = judged.where("status = 'deleted'")
    return Change(
        outcomes=judged,
        topics=topics.join(gone, "key", "left_anti"),
        links=_without(links, gone.select(topic_id("key").alias("id"))),
    )


def link_documents(docs: DataFrame, commands: DataFrame, now: str) -> Change:
    """Links between existing documents: from_key, to_key, type, bidirectional.

    A null type or direction takes the default.
    """
    checked = _known(
        _known(commands, docs, "from_key", "from_known"), docs, "to_key", "to_known"
    )
    links = checked.where("from_known and to_known").select(
        document_id("from_key").alias("from_id"),
        document_id("to_key").alias("to_id"),
        F.coalesce("type", F.lit(schemas.DOCUMENT_LINK_TYPE)).alias("type"),
        F.lit(schemas.DOCUMENT_LINK_STRENGTH).alias("strength"),
        F.coalesce("bidirectional", F.lit(True)).alias("bidirectional"),
        link_metadata(now).alias("metadata"),
    )
    outcomes = checked.select(
        "from_key",
        "to_key",
        F.when(~F.col("from_known"), "from_not_found")
        .when(~F.col("to_known"), "to_not_found")
        .otherwise("linked")
        .alias("status"),
    )
    return Change(outcomes=outcomes, links=links)


def refresh_embeddings(
    docs: DataFrame, keys: DataFrame | None = None, dry_run: bool = False, embed=hash_embedding
) -> Change:
    """Embed all documents, or those of a key table, from title, summary and content.

    ``dry_run`` only reports.  Unknown keys are reported and skipped.
    """
    body = text.embedding_text(F.col("title"), F.col("summary"), F.col("content"))
    done = F.lit("would_update" if dry_run else "updated")
    if keys is None:
        outcomes = docs.select("key", done.alias("status"))
        chosen, rest = docs, None
    else:
        asked = keys.select("key").distinct()
        outcomes = _known(asked, docs, "key", "known").select(
            "key", F.when(F.col("known"), done).otherwise("not_found").alias("status")
        )
        chosen = docs.join(asked, "key", "left_semi")
        rest = docs.join(asked, "key", "left_anti")
    if dry_run:
        return Change(outcomes=outcomes, documents=docs)
    fresh = chosen.withColumn("embedding", embed(body))
    return Change(
        outcomes=outcomes, documents=fresh if rest is None else fresh.unionByName(rest)
    )


def outcome_counts(change: Change) -> DataFrame:
    return change.outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("commands"))
