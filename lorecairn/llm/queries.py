"""One driver query per operator, over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, language, merkle, mixing, ngram_join, pieces, quality_model, quality_rules, sharding, substring, token_counts, toxicity
from .tables import held_out, read, written

#: Setting of the folder with the vocabulary files, read by the driver alone, and where it is if unset.
TOKENIZERS, TOKENIZERS_FOLDER = "spark.lorecairn.tokenizers", "/opt/tokenizers"
#: Public vocabularies: byte-level pairs, and pieces with byte fallback.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tokenizer(spark: SparkSession, name: str) -> str:
    """Place of a vocabulary file."""
    return f"{spark.conf.get(TOKENIZERS, TOKENIZERS_FOLDER)}/{name}"


def tokenizer_bytes(spark: SparkSession, name: str) -> bytes:
    with open(tokenizer(spark, name), "rb") as file:
        return file.read()


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles overlap by nine tenths."""
    return ngram_join.joined(read(spark, folder, "documents"))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule measures, posterior quality and verdict of every document."""
    return quality_rules.judge(read(spark, folder, "documents"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return token_counts.token_counts(read(spark, folder, "documents"), token_counts.byte_pieces(tokenizer(spark, BYTE_LEVEL)))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-word sequences that a smaller id has too."""
    return substring.deduplicated(read(spark, folder, "documents"), with_text=False)


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; one fold in four is never learned from."""
    docs = read(spark, folder, "documents")
    profiles = language.learn(docs, ~held_out(4, 2) & F.col("doc_id").isNotNull())
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document; one fold in four is never learned from."""
    docs = read(spark, folder, "documents")
    weights = toxicity.learn(docs, read(spark, folder, "labels"), ~held_out(4, 2))
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes from every document."""
    docs = read(spark, folder, "documents")
    rows = mixing.plan(docs).apply(docs)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies"
    )


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document; shard counts are at most one apart."""
    docs = read(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shuffled(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents, one row per pair."""
    return decontaminate.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; one fold in three is never learned from."""
    docs = read(spark, folder, "documents")
    model = quality_model.learn(docs, read(spark, folder, "labels"), ~held_out(3, 1))
    scored = quality_model.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= quality_model.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, with the end id, and the text they decode to."""
    model = tokenizer_bytes(spark, PIECES)
    rows = pieces.decode(pieces.encode(read(spark, folder, "documents"), model, end=True), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root its possibly changed text leads to."""
    docs = read(spark, folder, "documents")
    changed = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    text = F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, 3, {"given": merkle.leaf({"text": text})})
    root, led_to = merkle.hexed(F.col("root")), merkle.folded(F.col("given"), F.col("path"))
    rows = rows.select(
        "doc_id",
        merkle.hexed(F.col("leaf")).alias("leaf"),
        merkle.hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        led_to.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers that end together in every document, and how usual their links are."""
    docs = read(spark, folder, "documents")
    vocabularies = tokenizer_bytes(spark, BYTE_LEVEL), tokenizer_bytes(spark, PIECES)
    aligned = written(alignment.align(docs, *vocabularies, packed=True), "aligned")
    return alignment.describe(aligned, alignment.link_counts(aligned))


# What SQL can express.  The others have learned models or random draws and are
# tested against brute force, planted cases or held-out rows.
_WORDS = r"""list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

CHECKS["op1_ngram_join"] = f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
      FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
           FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * shared >= 90 * (p.size + q.size - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
    SELECT a, b FROM edges
    UNION
    SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r USING (doc_id)"""

CHECKS["op4_substring_dedup"] = f"""
WITH
w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS sequence
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
first AS (SELECT sequence, min(doc_id) AS least FROM windows GROUP BY sequence),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS place
         FROM windows JOIN first USING (sequence) WHERE doc_id > least),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w WHERE len(words) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
         FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
#: The last bit of a check sum's state, bit by bit; the check sum itself has the opposite bit.
_STATE = """list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
          lambda c: list_transform(range(0, 8), lambda i: CAST((unicode(c) >> CAST(i AS INTEGER)) & 1 AS UBIGINT))))),
          lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384::UBIGINT)) & 1"""


def _tree(name: str, start: str) -> str:
    """Levels of trees of three: nodes, and the siblings of each on both sides."""
    return f"""
{name}(level, tree, idx, n, h) AS (
    SELECT 0, tree, row_number() OVER (PARTITION BY tree ORDER BY {start}) - 1, count(*) OVER (PARTITION BY tree), h FROM {name}_rows
    UNION ALL
    SELECT any_value(level) + 1, tree, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY tree, idx // 3),
{name}_beside AS (
    SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
    FROM {name} a LEFT JOIN {name} b ON a.level = b.level AND a.tree = b.tree AND a.idx // 3 = b.idx // 3
    WHERE a.n > 1 GROUP BY a.level, a.tree, a.idx)"""


def _climb(name: str, start: str) -> str:
    """From each start up to the root of its tree: the siblings on the way and the hash."""
    return f"""
{name}_way(row, level, tree, idx, proof, folded) AS (
    {start}
    UNION ALL
    SELECT row, w.level + 1, tree, idx // 3, proof || before || after, sha256(before || folded || after)
    FROM {name}_way w JOIN {name}_beside b USING (level, tree, idx)),
{name}_up AS (SELECT row, max_by(proof, level) AS proof, max_by(folded, level) AS folded FROM {name}_way GROUP BY row)"""


CHECKS["op12_merkle_manifest"] = f"""
WITH RECURSIVE
given AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_FIELDS} AS fields, text,
                 CASE WHEN {_STATE} = 1 THEN replace(text, chr(10), '') ELSE text END AS changed
          FROM documents),
leaf_rows AS (SELECT doc_id, tree, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS h,
                     sha256(fields || coalesce(strlen(changed) || ':' || changed, '-')) AS changed_h FROM given),
{_tree("leaf", "doc_id, h")},
rows AS (SELECT row_number() OVER () AS row, * FROM (
             SELECT doc_id, tree, h, changed_h, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS idx FROM leaf_rows)),
top_rows AS (SELECT '' AS tree, tree AS named, h FROM leaf WHERE n = 1),
{_tree("top", "named")},
{_climb("leaf", "SELECT row, 0, tree, idx, '', changed_h FROM rows")},
places AS (SELECT named, row_number() OVER (ORDER BY named) - 1 AS idx FROM top_rows),
{_climb("top", "SELECT row, 0, '', p.idx, '', u.folded FROM rows r JOIN leaf_up u USING (row) JOIN places p ON p.named = r.tree")}
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, t.h AS root, sha256(u.proof || v.proof) AS proof_sha256,
       v.folded AS folded_root, v.folded = t.h AS verified
FROM rows r JOIN leaf_up u USING (row) JOIN top_up v USING (row) JOIN leaf s ON s.tree = r.tree AND s.n = 1
JOIN top t ON t.n = 1"""
