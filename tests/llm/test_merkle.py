"""Merkle manifests against hashing by hand."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorecairn.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, path string, tree string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, arity):
    """Root of a list of nodes, and (before, after) of every node level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            lo = at - at % arity
            paths[i].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + arity])))
        nodes = [h(*nodes[lo : lo + arity]) for lo in range(0, len(nodes), arity)]
        place = [at // arity for at in place]
    return nodes[0], paths


def by_hand(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    groups = defaultdict(list)
    for row in rows:
        changed = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(*row), leaf(*row[:4], row[4].replace("\n", "") if changed else row[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, below = [], {}
    for name in names:
        groups[name].sort()
        root, below[name] = tree([x[2] for x in groups[name]], arity)
        roots.append(root)
    top, above = tree(roots, arity)
    out = []
    for name, subroot, up in zip(names, roots, above, strict=True):
        for (known, doc_id, own, led), path in zip(groups[name], below[name], strict=True):
            whole = path + up
            for before, after in whole:
                led = h(before, led, after)
            out.append((doc_id if known else None, own, subroot, top, h(*(a + b for a, b in whole)), led))
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", None) for r in rows], SCHEMA)


def digests(docs, arity):
    changed = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    text = F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, arity, {"given": merkle.leaf({"text": text})})
    return rows.select(
        "doc_id", *(merkle.hexed(F.col(x)) for x in ("leaf", "subroot", "root")), merkle.proof_digest(F.col("path")), merkle.folded(F.col("given"), F.col("path"))
    )


ROWS = [(i, f"s{'ab'[i % 2]}" if i % 7 else None, "en", i, f"a\n{i}") for i in range(70)]
ROWS += [(3, "sa", None, None, None), (3, "sa", None, None, None), (None, "sa", "en", 1, "x\ny"), (None, None, None, None, None)]
ROWS += [(500, "alone", "én", -5, ""), (501, "", "de", 0, "Ü\n" * 30000), (10**12, "é", "de", 0, "\n"), (4, "sa", "de", 0, "later")]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_hashing_by_hand(spark, arity):
    got = Counter(map(tuple, digests(made(spark, ROWS).repartition(5), arity).collect()))
    assert got == Counter(by_hand(ROWS, arity))


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:2], [(i, "one", "en", 1, "t") for i in range(9)], [(1, None, None, None, "t")] * 4])
def test_small_and_full_trees(spark, rows):
    got = Counter(map(tuple, digests(made(spark, rows), 3).collect()))
    assert got == Counter(by_hand(rows, 3) if rows else [])


def test_query(spark, folder):
    docs = queries.read(spark, folder, "documents")
    want = Counter((*x, x[5] == x[3]) for x in by_hand([tuple(r) for r in docs.select(*merkle.COLUMNS).collect()], 3))
    assert Counter(map(tuple, queries.op12_merkle_manifest(spark, folder).collect())) == want


def test_large_source_is_spread(spark):
    rows = spark.range(20000).selectExpr("'s' AS tree", "id", "id AS doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.numbered(rows, "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where("idx <> doc or n <> 20000").count() == 0
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 10000


def test_a_node_has_room_for_two(spark):
    with pytest.raises(ValueError, match="room for two"):
        merkle.manifest(made(spark, ROWS), 1)
