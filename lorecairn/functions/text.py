"""Column functions over text and tag lists.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------
#: ASCII punctuation removed from a request before it is cut into terms.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that never become search terms.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by")
#: Punctuation that separates words when related terms are counted.
WORD_BREAKS = r"[.,;:!?()\[\]{}]"
#: Every character that counts as white space (regular expression class, Java and RE2).
WHITE_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
#: Separator of full-text tokens.
TOKEN_BREAKS = r"[^\p{L}\p{N}]+"
SNIPPET_CHARS = 200
INLINE_CHARS = 1000
# ---------------------------------------------------------------------------


def clean_query(query: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    bare = F.translate(F.lower(query), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, F.lit(WHITE_SPACE), F.lit(" ")))


def extract_terms(cleaned: Column) -> Column:
    """Distinct terms of a cleaned request: no stop words, at least two characters, sorted."""
    kept = F.filter(
        F.split(cleaned, " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)
    )
    return F.sort_array(F.array_distinct(kept))


def _stem(term: Column) -> Column:
    cut = (
        F.when(term.endswith("ing"), 3)
        .when(term.endswith("s") & ~term.endswith("ss"), 1)
        .when(term.endswith("ed"), 2)
    )
    return F.left(term, F.length(term) - cut)


def expand_terms(terms: Column) -> Column:
    """The terms plus their naive stems; an empty stem is dropped."""
    stems = F.filter(F.transform(terms, _stem), lambda s: F.length(s) > 0)
    return F.sort_array(F.array_union(terms, stems))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"^{WHITE_SPACE}|{WHITE_SPACE}$"), F.lit(""))


def parse_tags(csv: Column) -> Column:
    """Comma separated tags as a list of trimmed, non-empty strings; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), strip)
    return F.filter(parts, lambda t: t != "")


def retag(tags: Column, add: Column, remove: Column) -> Column:
    """Append the tags of ``add`` that are absent, then drop every tag of ``remove``.

    Order and duplicates of the remaining tags are kept.
    """
    fresh = F.filter(F.array_distinct(add), lambda t: ~F.array_contains(tags, t))
    return F.filter(F.concat(tags, fresh), lambda t: ~F.array_contains(remove, t))


def tokens(text: Column) -> Column:
    """Full-text tokens: lower case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAKS), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), WHITE_SPACE), lambda w: w != "")


def related_words(text: Column) -> Column:
    """Words of more than three characters, split at single spaces after removing punctuation."""
    spaced = F.lower(F.regexp_replace(text, F.lit(WORD_BREAKS), F.lit(" ")))
    return F.filter(F.split(spaced, " "), lambda w: F.length(w) > 3)


def snippet(content: Column) -> Column:
    return F.when(
        F.length(content) > SNIPPET_CHARS,
        F.concat(F.substring(content, 1, SNIPPET_CHARS), F.lit("...")),
    ).otherwise(content)


def preview(summary: Column, content: Column) -> Column:
    """The summary, or the snippet when the summary is missing or empty."""
    return F.coalesce(F.nullif(summary, F.lit("")), snippet(content))


def inline_content(content: Column) -> Column:
    """Content of a small document, null for a large one."""
    return F.when(F.length(content) < INLINE_CHARS, content)


def embedding_text(title: Column, summary: Column, content: Column) -> Column:
    """Text a document is embedded from; a missing summary leaves two spaces."""
    return F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")), F.lit(" "), content)


def searchable_text(title: Column, content: Column) -> Column:
    return F.lower(F.concat(title, F.lit(" "), content))
