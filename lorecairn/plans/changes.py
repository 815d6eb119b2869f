"""Queries that run the maintenance jobs over derived command tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.vectors import dot
from ..operators import maintain, replay
from ..sources import derived
from . import sql
from .registry import register

#: The moment the commands are applied; passed in, never read from a clock.
NOW = "2024-06-01T00:00:00"


def _key(column: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _rows(kind: str, table: DataFrame, *columns: Column) -> DataFrame:
    """Rows of several tables in one result: what they are, and their values as text."""
    return table.select(
        F.lit(kind).alias("kind"),
        F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns]).alias("row"),
    )


def _text_row(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)


# --- documents ---------------------------------------------------------------


@register(
    "store_documents",
    sql.query(
        f"""SELECT i.key, i.title, i.content,
                   'chat, assistant, t' || CAST(i.turn % 3 AS VARCHAR) AS tags,
                   'mcp_conversation' AS source, 'system' AS creator, '{NOW}' AS created,
                   CAST(1 AS INTEGER) AS version, CAST(0.9 AS DOUBLE) AS confidence,
                   round(e.total, 4) AS embedding_total,
                   CASE WHEN t.key IS NULL THEN 'stored_topic_not_found'
                        ELSE 'stored_and_linked' END AS outcome,
                   'topics/' || t.key AS linked_to,
                   CASE WHEN t.key IS NOT NULL THEN CAST(0.9 AS DOUBLE) END AS strength
            FROM kb_ingest i LEFT JOIN kb_topics t ON t.key = i.topic_key
            LEFT JOIN (SELECT key, sum(CAST(value AS DOUBLE)) AS total FROM cells GROUP BY key) e
                   ON e.key = i.key""",
        "kb_ingest",
        "kb_topics",
        cells=sql.hash_cells(
            "(SELECT key, title || '  ' || content AS body FROM kb_ingest)", "key", "body"
        ),
    ),
)
def store_documents(spark: SparkSession, folder: str) -> DataFrame:
    commands = derived.kb_ingest(spark, folder)
    change = maintain.store_documents(commands, derived.kb_topics(spark, folder), NOW)
    links = change.links.select(
        F.substring_index("from_id", "/", -1).alias("key"), F.col("to_id").alias("linked_to"), "strength"
    )
    outcomes = change.outcomes.select("key", F.col("status").alias("outcome"))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return (
        change.documents.join(outcomes, "key")
        .join(links, "key", "left")
        .select(
            "key",
            "title",
            "content",
            F.array_join("tags", ", ").alias("tags"),
            "metadata.source",
            "metadata.creator",
            "metadata.created",
            "metadata.version",
            "confidence",
            F.round(total, 4).alias("embedding_total"),
            "outcome",
            "linked_to",
            "strength",
        )
    )


def _update_commands(spark: SparkSession, folder: str) -> DataFrame:
    """A review of every labelled document, a second one of the good ones, and unknown keys."""
    labels = derived.raw(spark, folder, "labels")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    nothing = F.lit(None).cast("string")
    first = labels.select(
        _key("doc_id").alias("key"),
        F.lit(1).alias("seq"),
        F.when(good, F.concat(F.lit("good "), "doc_id")).otherwise("").alias("title"),
        F.when(toxic, "withdrawn").alias("content"),
        F.when(toxic, "").alias("summary"),
        F.lit("reviewed, reviewed,, ").alias("add_tags"),
        F.lit(" short ,zzz").alias("remove_tags"),
    )
    second = labels.where(good).select(
        _key("doc_id").alias("key"),
        F.lit(2).alias("seq"),
        nothing.alias("title"),
        nothing.alias("content"),
        F.lit("kept").alias("summary"),
        F.lit("short").alias("add_tags"),
        nothing.alias("remove_tags"),
    )
    unknown = derived.raw(spark, folder, "supplier").select(
        _key("s_suppkey", "none-").alias("key"),
        F.lit(1).alias("seq"),
        F.lit("x").alias("title"),
        *[nothing.alias(c) for c in ("content", "summary", "add_tags", "remove_tags")],
    )
    return first.unionByName(second).unionByName(unknown)


@register(
    "update_documents",
    sql.query(
        f"""SELECT 'document' AS kind, {_text_row('key', 'title', 'summary', 'tags', 'updated',
                   'version', 'content_chars')} AS row
            FROM (SELECT d.key,
                         CASE WHEN l.quality = 1 THEN 'good ' || d.key ELSE d.title END AS title,
                         CASE WHEN l.quality = 1 THEN 'kept' WHEN l.toxic = 1 THEN ''
                              ELSE d.summary END AS summary,
                         array_to_string(CASE WHEN l.doc_id IS NULL THEN d.tags
                             ELSE list_concat(list_filter(d.tags, lambda t: t <> 'short'),
                                  CASE WHEN l.quality = 1 THEN ['reviewed', 'short']
                                       ELSE ['reviewed'] END) END, ',') AS tags,
                         CASE WHEN l.doc_id IS NULL THEN d.created ELSE '{NOW}' END AS updated,
                         CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 + (l.quality = 1)::INTEGER END AS version,
                         length(CASE WHEN l.toxic = 1 THEN 'withdrawn' ELSE d.content END) AS content_chars
                  FROM kb_documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
            UNION ALL
            SELECT 'outcome', CAST(doc_id AS VARCHAR) || '|updated' FROM labels
            UNION ALL
            SELECT 'outcome', CAST(doc_id AS VARCHAR) || '|updated' FROM labels WHERE quality = 1
            UNION ALL
            SELECT 'outcome', 'none-' || CAST(s_suppkey AS VARCHAR) || '|not_found' FROM supplier""",
        "kb_documents",
    ),
)
def update_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = derived.kb_documents(spark, folder)
    change = maintain.update_documents(docs, _update_commands(spark, folder), NOW)
    # The rows have no embedding, so it is checked here, or Spark would leave it out of the job.
    unit = F.abs(dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-3
    fresh = (F.col("metadata.updated") != NOW) | F.coalesce(unit, F.lit(False))
    documents = _rows(
        "document",
        change.documents,
        F.when(fresh, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("not embedded anew: "), "key"))),
        F.col("title"),
        F.col("summary"),
        F.array_join("tags", ","),
        F.col("metadata.updated"),
        F.col("metadata.version"),
        F.length("content"),
    )
    return documents.unionByName(_rows("outcome", change.outcomes, F.col("key"), F.col("status")))


def _link_row() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("from_id", "to_id", "type"))


@register(
    "delete_documents",
    sql.query(
        f"""SELECT 'document' AS kind, key AS row FROM kb_documents
            WHERE key NOT IN (SELECT key FROM asked)
            UNION ALL
            SELECT 'link', {_text_row('from_id', 'to_id', 'type')} FROM kb_links
            WHERE from_id NOT IN (SELECT 'documents/' || key FROM asked)
              AND to_id NOT IN (SELECT 'documents/' || key FROM asked)
            UNION ALL
            SELECT 'outcome', a.key || '|' || CASE WHEN d.key IS NULL THEN 'not_found'
                                                   ELSE 'deleted' END
            FROM asked a LEFT JOIN kb_documents d USING (key)""",
        "kb_documents",
        "kb_links",
        asked="""SELECT CAST(doc_id AS VARCHAR) AS key FROM labels WHERE toxic = 1
                 UNION SELECT 'none-' || CAST(s_suppkey AS VARCHAR) FROM supplier""",
    ),
)
def delete_documents(spark: SparkSession, folder: str) -> DataFrame:
    toxic = derived.raw(spark, folder, "labels").where("toxic = 1").select(_key("doc_id").alias("key"))
    unknown = derived.raw(spark, folder, "supplier").select(_key("s_suppkey", "none-").alias("key"))
    change = maintain.delete_documents(
        derived.kb_documents(spark, folder),
        derived.kb_links(spark, folder),
        toxic.unionByName(unknown),
    )
    return (
        _rows("document", change.documents, F.col("key"))
        .unionByName(_rows("link", change.links, *_link_row()))
        .unionByName(_rows("outcome", change.outcomes, F.col("key"), F.col("status")))
    )


# --- topics ------------------------------------------------------------------


@register(
    "create_topics",
    sql.query(
        f"""SELECT 'topic' AS kind, {_text_row('c.key', 'c.name', 'c.description', 'c.parent')} AS row
            FROM commands c WHERE (parent IS NULL OR parent IN (SELECT key FROM kb_topics))
                  AND key NOT IN (SELECT key FROM kb_topics)
            UNION ALL
            SELECT 'outcome', c.key || '|' || CASE WHEN key IN (SELECT key FROM kb_topics) THEN 'key_exists'
                       WHEN parent IS NULL OR parent IN (SELECT key FROM kb_topics) THEN 'created'
                       ELSE 'parent_not_found' END
            FROM commands c""",
        "kb_topics",
        commands="""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS key, p_name AS name,
                           p_type AS description,
                           CASE WHEN p_partkey % 31 > 0
                                THEN 'n' || CAST(p_partkey % 31 - 1 AS VARCHAR) END AS parent
                    FROM part""",
    ),
)
def create_topics(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.col("p_partkey") % 31
    commands = derived.raw(spark, folder, "part").select(
        _key("p_partkey", "p").alias("key"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.when(slot > 0, F.concat(F.lit("n"), (slot - 1).cast("string")))
        .otherwise("")
        .alias("parent_topic"),
    )
    change = maintain.create_topics(derived.kb_topics(spark, folder), commands, NOW)
    columns = [F.col(c) for c in ("key", "name", "description", "parent_topic")]
    return _rows("topic", change.topics, *columns).unionByName(
        _rows("outcome", change.outcomes, F.col("key"), F.col("status"))
    )


@register(
    "update_topics",
    sql.query(
        f"""SELECT 'topic' AS kind, {_text_row('key', 'name', 'description', 'parent')} AS row
            FROM (SELECT t.key, coalesce(nullif(c.name, ''), t.name) AS name,
                         coalesce(nullif(c.description, ''), t.description) AS description,
                         nullif(coalesce(c.parent, t.parent_topic), '') AS parent
                  FROM kb_topics t LEFT JOIN judged c ON c.key = t.key AND c.status = 'updated')
            UNION ALL SELECT 'outcome', key || '|' || status FROM judged""",
        "kb_topics",
        commands="""SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS key, '' AS name,
                           'nation ' || n_name AS description,
                           CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'zz'
                                ELSE 'r' || CAST(n_nationkey % 5 AS VARCHAR) END AS parent FROM nation
                    UNION ALL
                    SELECT DISTINCT 's' || substr(source, 4), upper(source), CAST(NULL AS VARCHAR),
                           CAST(NULL AS VARCHAR) FROM documents
                    UNION ALL
                    SELECT 'none-' || CAST(s_suppkey AS VARCHAR), 'x', NULL, NULL FROM supplier""",
        judged="""SELECT c.*, CASE WHEN key NOT IN (SELECT key FROM kb_topics) THEN 'not_found'
                                   WHEN parent <> '' AND parent NOT IN (SELECT key FROM kb_topics)
                                   THEN 'parent_not_found' ELSE 'updated' END AS status
                  FROM commands c""",
    ),
)
def update_topics(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    slot = F.col("n_nationkey") % 5
    nations = derived.raw(spark, folder, "nation").select(
        _key("n_nationkey", "n").alias("key"),
        F.lit("").alias("name"),
        F.concat(F.lit("nation "), "n_name").alias("description"),
        F.when(slot == 0, "")
        .when(slot == 2, "zz")
        .when(slot > 2, F.concat(F.lit("r"), slot.cast("string")))
        .alias("parent_topic"),
    )
    sources = (
        derived.raw(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            F.concat(F.lit("s"), F.substring("source", F.lit(4), F.length("source"))).alias("key"),
            F.upper("source").alias("name"),
            nothing.alias("description"),
            nothing.alias("parent_topic"),
        )
    )
    unknown = derived.raw(spark, folder, "supplier").select(
        _key("s_suppkey", "none-").alias("key"),
        F.lit("x").alias("name"),
        nothing.alias("description"),
        nothing.alias("parent_topic"),
    )
    commands = nations.unionByName(sources).unionByName(unknown)
    change = maintain.update_topics(derived.kb_topics(spark, folder), commands)
    columns = [F.col(c) for c in ("key", "name", "description", "parent_topic")]
    return _rows("topic", change.topics, *columns).unionByName(
        _rows("outcome", change.outcomes, F.col("key"), F.col("status"))
    )


@register(
    "delete_topics",
    sql.query(
        f"""SELECT 'topic' AS kind, {_text_row('key', 'name', 'parent_topic')} AS row FROM kb_topics
            WHERE key NOT IN (SELECT key FROM judged WHERE status = 'deleted')
            UNION ALL
            SELECT 'link', {_text_row('from_id', 'to_id', 'type')} FROM kb_links
            WHERE to_id NOT IN (SELECT 'topics/' || key FROM judged WHERE status = 'deleted')
              AND from_id NOT IN (SELECT 'topics/' || key FROM judged WHERE status = 'deleted')
            UNION ALL SELECT 'outcome', key || '|' || status FROM judged""",
        "kb_documents",
        "kb_topics",
        "kb_links",
        asked="""SELECT key FROM kb_topics
                 UNION SELECT 'none-' || CAST(s_suppkey AS VARCHAR) FROM supplier""",
        judged="""SELECT key, CASE WHEN key NOT IN (SELECT key FROM kb_topics) THEN 'not_found'
                              WHEN 'topics/' || key IN (
                                  SELECT to_id FROM kb_links WHERE from_id IN
                                      (SELECT 'documents/' || key FROM kb_documents))
                              THEN 'has_documents' ELSE 'deleted' END AS status
                  FROM asked""",
    ),
)
def delete_topics(spark: SparkSession, folder: str) -> DataFrame:
    topics = derived.kb_topics(spark, folder)
    unknown = derived.raw(spark, folder, "supplier").select(_key("s_suppkey", "none-").alias("key"))
    change = maintain.delete_topics(
        derived.kb_documents(spark, folder),
        derived.kb_links(spark, folder),
        topics,
        topics.select("key").unionByName(unknown),
    )
    columns = [F.col(c) for c in ("key", "name", "parent_topic")]
    return (
        _rows("topic", change.topics, *columns)
        .unionByName(_rows("link", change.links, *_link_row()))
        .unionByName(_rows("outcome", change.outcomes, F.col("key"), F.col("status")))
    )


# --- links and embeddings ----------------------------------------------------


@register(
    "link_documents",
    sql.query(
        """SELECT 'link' AS kind,
                  'documents/' || from_key || '|documents/' || to_key || '|'
                  || CASE WHEN l_linenumber = 1 THEN 'related' ELSE 'cites' END || '|0.5|'
                  || CASE WHEN l_returnflag = 'N' THEN 'false' ELSE 'true' END AS row
           FROM judged WHERE status = 'linked'
           UNION ALL
           SELECT 'outcome', status || '|' || CAST(count(*) AS VARCHAR) FROM judged GROUP BY status""",
        "kb_documents",
        judged="""SELECT CAST(l_orderkey AS VARCHAR) AS from_key, CAST(l_partkey AS VARCHAR) AS to_key,
                         l_linenumber, l_returnflag,
                         CASE WHEN CAST(l_orderkey AS VARCHAR) NOT IN (SELECT key FROM kb_documents)
                              THEN 'from_not_found'
                              WHEN CAST(l_partkey AS VARCHAR) NOT IN (SELECT key FROM kb_documents)
                              THEN 'to_not_found' ELSE 'linked' END AS status
                  FROM lineitem""",
    ),
)
def link_documents(spark: SparkSession, folder: str) -> DataFrame:
    commands = derived.raw(spark, folder, "lineitem").select(
        _key("l_orderkey").alias("from_key"),
        _key("l_partkey").alias("to_key"),
        F.when(F.col("l_linenumber") != 1, "cites").alias("type"),
        F.when(F.col("l_returnflag") == "N", False).alias("bidirectional"),
    )
    change = maintain.link_documents(derived.kb_documents(spark, folder), commands, NOW)
    columns = [*_link_row(), F.col("strength"), F.col("bidirectional")]
    return _rows("link", change.links, *columns).unionByName(
        _rows("outcome", maintain.outcome_counts(change), F.col("status"), F.col("commands"))
    )


@register(
    "refresh_embeddings",
    sql.query(
        """SELECT a.key, CASE WHEN d.key IS NULL THEN 'not_found' ELSE 'updated' END AS status,
                  CASE WHEN d.key IS NOT NULL THEN CAST(384 AS INTEGER) END AS dimensions,
                  round(e.total, 4) AS total
           FROM asked a LEFT JOIN kb_documents d USING (key)
           LEFT JOIN (SELECT key, sum(CAST(value AS DOUBLE)) AS total FROM cells GROUP BY key) e
                  USING (key)""",
        "kb_documents",
        asked="""SELECT CAST(doc_id AS VARCHAR) AS key FROM labels
                 UNION SELECT 'none-' || CAST(s_suppkey AS VARCHAR) FROM supplier""",
        cells=sql.hash_cells(
            f"""(SELECT key, {sql.EMBEDDING_TEXT} AS body FROM kb_documents
                 WHERE key IN (SELECT key FROM asked))""",
            "key",
            "body",
        ),
    ),
)
def refresh_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    labelled = derived.raw(spark, folder, "labels").select(_key("doc_id").alias("key"))
    unknown = derived.raw(spark, folder, "supplier").select(_key("s_suppkey", "none-").alias("key"))
    docs = derived.kb_documents(spark, folder, embedded=True)
    change = maintain.refresh_embeddings(docs, labelled.unionByName(unknown))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    fresh = change.documents.select("key", "embedding")
    return change.outcomes.join(fresh, "key", "left").select(
        "key", "status", F.size("embedding").alias("dimensions"), F.round(total, 4).alias("total")
    )


# --- replay ------------------------------------------------------------------

_REPLAY = {
    "judged": """
        SELECT *, CASE WHEN op = 'insert' AND live THEN 'rejected'
                       WHEN op <> 'insert' AND NOT live THEN 'not_found' ELSE 'applied' END AS status
        FROM (SELECT *, coalesce(last_value(CASE op WHEN 'insert' THEN TRUE WHEN 'delete' THEN FALSE END
                                            IGNORE NULLS)
                                 OVER (PARTITION BY key ORDER BY ts, event_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS live
              FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n
                    FROM kb_changes))""",
    "epochs": """SELECT key, max(n) AS start FROM judged
                 WHERE op = 'insert' AND status = 'applied' GROUP BY key""",
    "recent": """SELECT j.* FROM judged j JOIN epochs e ON e.key = j.key AND j.n >= e.start
                 WHERE j.status = 'applied'""",
    "removed": "SELECT key, tag, max(n) AS n FROM recent WHERE op = 'remove_tag' GROUP BY key, tag",
    "tagged": """SELECT a.key, a.tag, min(a.n) AS n FROM recent a
                 LEFT JOIN removed r ON r.key = a.key AND r.tag = a.tag
                 WHERE a.op = 'add_tag' AND (r.n IS NULL OR a.n > r.n) GROUP BY a.key, a.tag""",
    "final_tags": "SELECT key, string_agg(tag, ',' ORDER BY n) AS tags FROM tagged GROUP BY key",
    "counts": """SELECT key, count(*) FILTER (status = 'applied') AS applied,
                        count(*) FILTER (status = 'rejected') AS rejected,
                        count(*) FILTER (status = 'not_found') AS not_found
                 FROM judged GROUP BY key""",
    "versions": """SELECT key, count(*) FILTER (op IN ('insert', 'set_title', 'add_tag', 'remove_tag'))
                              AS version,
                          bool_and(op <> 'delete') AS live,
                          arg_max(title, n) FILTER (op IN ('insert', 'set_title')) AS title
                   FROM recent GROUP BY key""",
}


@register(
    "replay_changes",
    sql.query(
        """SELECT c.key, coalesce(v.live, FALSE) AS live,
                  CAST(coalesce(v.version, 0) AS INTEGER) AS version, v.title,
                  coalesce(t.tags, '') AS tags, c.applied, c.rejected, c.not_found
           FROM counts c LEFT JOIN versions v USING (key) LEFT JOIN final_tags t USING (key)""",
        "kb_changes",
        **_REPLAY,
    ),
)
def replay_changes(spark: SparkSession, folder: str) -> DataFrame:
    final = replay.replay(derived.kb_changes(spark, folder))
    return final.select(
        "key",
        "live",
        "version",
        "title",
        F.array_join("tags", ",").alias("tags"),
        "applied",
        "rejected",
        "not_found",
    )
