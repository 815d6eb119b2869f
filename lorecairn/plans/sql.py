"""SQL building blocks for the independent checks of the queries.

Every check starts from the raw tables and repeats the derivation of the
knowledge-base tables as common table expressions.
"""

from __future__ import annotations

from ..functions import text

TABLES = {
    "kb_documents": """
        SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, n_chars, lang AS raw_lang,
               substr(replace(text, chr(10), ' '), 1, 60) AS title, text AS content,
               CASE doc_id % 3 WHEN 1 THEN substr(text, 1, 120) WHEN 2 THEN '' END AS summary,
               list_value(CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END, source,
                          CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END) AS tags,
               '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || 'T'
                   || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00:00' AS created,
               source AS raw_source
        FROM documents""",
    "kb_embedded": """
        SELECT d.*, e.embedding
        FROM kb_documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "kb_topics": """
        SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS key, r_name AS name,
               CAST(NULL AS VARCHAR) AS parent_topic, 'about ' || r_name AS description FROM region
        UNION ALL
        SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name,
               'r' || CAST(n_regionkey AS VARCHAR), 'about ' || n_name FROM nation
        UNION ALL
        SELECT DISTINCT 's' || substr(source, 4), source, 'n' || substr(source, 4),
               'about ' || source FROM documents
        UNION ALL
        SELECT * FROM (VALUES ('x1', 'orphan', 'zz', 'about orphan'),
                              ('c1', 'cyc1', 'c2', 'about cyc1'),
                              ('c2', 'cyc2', 'c1', 'about cyc2'),
                              ('p0', 'self', 'p0', 'about self'))""",
    "kb_links": """
        SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS from_id,
               'topics/s' || substr(source, 4) AS to_id, 'belongs_to' AS type,
               CAST(0.9 AS DOUBLE) AS strength, FALSE AS bidirectional FROM documents
        UNION ALL
        SELECT 'documents/' || CAST(doc_id AS VARCHAR),
               'documents/' || CAST((doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS VARCHAR),
               CASE WHEN doc_id % 2 = 0 THEN 'related' ELSE 'cites' END,
               CAST(0.5 AS DOUBLE), doc_id % 3 = 0 FROM documents""",
    "kb_changes": """
        SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'set_title'
                    WHEN 'click' THEN 'add_tag' WHEN 'purchase' THEN 'remove_tag'
                    WHEN 'error' THEN 'delete' END AS op,
               'title-' || CAST(event_id AS VARCHAR) AS title,
               't' || CAST(event_id % 10 AS VARCHAR) AS tag
        FROM events""",
    "kb_ingest": """
        SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key,
               substr(text, 1, 60) AS title, text AS content,
               ' chat, ' || role || ' ,, t' || CAST(turn % 3 AS VARCHAR) AS tags_csv,
               'r' || CAST(conv_id % 7 AS VARCHAR) AS topic_key, turn
        FROM conversations WHERE role = 'assistant'""",
    "kb_queries": """
        SELECT conv_id * 1000 + turn AS query_id, text AS query,
               5 AS max_results, CAST(0.3 AS DOUBLE) AS min_score
        FROM conversations WHERE role = 'user'""",
}
_NEEDS = {"kb_embedded": ["kb_documents"]}


def quote(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def values(columns: list[str], rows: list[tuple]) -> str:
    """A literal request table."""
    body = ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"


def query(final: str, *tables: str, recursive: bool = False, **extra: str) -> str:
    """``final`` preceded by the named tables and, in order, the extra expressions."""
    names: list[str] = []
    for table in tables:
        for name in [*_NEEDS.get(table, []), table]:
            if name not in names:
                names.append(name)
    parts = [f"{n} AS ({TABLES[n]})" for n in names]
    parts += [f"{n.replace('__', '')} AS ({body})" for n, body in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + final


def cleaned(column: str) -> str:
    punctuation = quote(text.PUNCTUATION)
    spaces = quote(text.WHITE_SPACE)
    bare = f"translate(lower({column}), {punctuation}, '')"
    return f"trim(regexp_replace({bare}, {spaces}, ' ', 'g'))"


def terms(clean: str) -> str:
    stop = ", ".join(quote(w) for w in text.STOP_WORDS)
    return (
        f"list_sort(list_distinct(list_filter(string_split({clean}, ' '), "
        f"lambda t: length(t) > 1 AND t NOT IN ({stop}))))"
    )


def expanded(term_list: str) -> str:
    stem = (
        "CASE WHEN t LIKE '%ing' THEN left(t, length(t) - 3) "
        "WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) "
        "WHEN t LIKE '%ed' THEN left(t, length(t) - 2) ELSE '' END"
    )
    stems = f"list_filter(list_transform({term_list}, lambda t: {stem}), lambda t: t <> '')"
    return f"list_sort(list_distinct(list_concat({term_list}, {stems})))"


def token_list(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


def preview() -> str:
    snippet = "CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END"
    return f"coalesce(nullif(summary, ''), {snippet})"


def hash_cells(source: str, key: str, body: str) -> str:
    """Non-zero cells of the character embedding: (key, cell, value)."""
    return f"""
        SELECT key, cell, CAST(weight / sqrt(sum(weight * weight) OVER (PARTITION BY key)) AS FLOAT) AS value
        FROM (SELECT key, cell, sum(1.0::DOUBLE / position) AS weight
              FROM (SELECT key, unicode(letter) % 384 AS cell, position
                    FROM (SELECT {key} AS key, unnest(string_split({body}, '')) AS letter,
                                 generate_subscripts(string_split({body}, ''), 1) AS position
                          FROM {source} WHERE {body} <> ''))
              GROUP BY key, cell)"""


EMBEDDING_TEXT = "(title || ' ' || coalesce(summary, '') || ' ' || content)"
