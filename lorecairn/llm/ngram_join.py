"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a given part.

Two sets link when ``100 * |intersection| >= percent * |union|``.

*Support.*  Two linked sets share so many of their smallest hashes (see :func:`prefix`)
that a set can only link when that many of its own are in other sets too.  The rest,
most of a corpus, goes no further.

*Tiles.*  Sizes are cut into bands so that sets that link are in one band or in
neighbouring ones.  For each band the 64-bit hashes are cut into more ranges than
two linked sets can differ in, so they agree in one range at least.  The contents of a
range, with band and range, name a tile, and only documents in one tile are compared.
A shared passage alone puts no two documents in one tile.  Sets with so many empty
ranges that the count fails also get tiles of their smallest hashes (prefix
filter), so no link is lost.

*Stars.*  Each member of a tile is a pair with the tile's smallest id.  The pair with
most common tiles is compared first, one for every member.

*Rest.*  Tiles with common members make a cluster, which no link leaves.  A shared
passage may chain sets of all sizes, so a cluster that still holds several components
is compared within bands of sizes, block by block: bit tables of 2,048 bits bound each intersection from above by counting bits, and what passes is
intersected as sorted arrays.  Pairs of one component are skipped, also of those
that have just met, so a task sends at most one link per member.

Documents of equal sets are one node from the start.  A block of documents sends a
tile's name once, so a group of copies of any size sends a few rows per block.

Words are between ASCII white space, A-Z in lower case.  A text with fewer words than
an n-gram is one n-gram; null and blank texts have none and link with nothing.  Rows
with a null id link with nothing and have a null component; rows that share an id
are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .components import bit_place, components, few_parts, maybe, member_bits
from .postings import BLOCK_ENTRIES, bucket_of, pack, packed_schema, runs, spread, unpack
from .tables import WORD
from .textarrays import Chunk, chunks, mix, ngram_hash, words

BITMAP_BITS = 2048
#: Members of one side of a block comparison.
TILE_ROWS = 2048
_ENTRY = {"key": np.dtype("<u8"), "doc": np.dtype("<i8"), "behind": np.dtype("<i8")}
_STAR = "leader long, member long, tiles long"
_SHARE = {"key": np.dtype("<u8"), "owner": np.dtype("<u8"), "times": np.dtype("<u4")}
#: In place of a set: several sets of a block.
_SEVERAL = np.uint64(0)


def shingles(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every document, one after the other, and where each begins."""
    found = words(chunk, lower_ascii=True)
    size = np.diff(found.first)
    grams = ngram_hash(found.hash, n)
    count = np.maximum(size - n + 1, 0)
    row = np.repeat(np.arange(chunk.rows), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + found.first[row]
    hashes = grams[at]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = [ngram_hash(found.hash[found.first[r] : found.first[r + 1]], int(size[r]), 1)[0] for r in short.tolist()]
        hashes, row = np.append(hashes, np.array(whole, dtype=np.uint64)), np.append(row, short)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(chunk.rows + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each range of ``values``, modulo 2**64."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[first[1:]] - total[first[:-1]]


def _digest(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    return _sums(mix(hashes), first), _sums(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), first)


def links(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


@cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, its number of ranges, and how many ranges linked sets may differ in."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    edges = [1]
    while edges[-1] < 1 << 40:
        # Equal sets have one size, but a band may hold more: they need only one range.
        edges.append(100 * edges[-1] // min(percent, 99) + 1)
    first = np.array(edges, dtype=np.int64)
    largest = first[1:] - 1
    differ = (largest + 100 * largest // percent) * (100 - percent) // (100 + percent)
    ranges = differ + 1
    empty = ranges * np.exp(-first[:-1] / ranges)
    ranges = ranges + np.ceil(1.5 * empty + 2 * np.sqrt(empty) - 0.2).astype(np.int64).clip(0)
    return first, ranges, differ


def tile_keys(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tiles of every set, and the row of each name."""
    edges, ranges, differ = bands(percent)
    size = np.diff(first)
    own = np.searchsorted(edges, size, side="right") - 1
    row = np.repeat(np.arange(len(size)), size)
    keys, rows = [], []
    high = hashes >> np.uint64(32)
    mixed = mix(hashes)
    for lower in (0, 1):
        # A set meets those of its own band and, as the larger one, those of the band below.
        band = own - lower
        fits = (size > 0) & (band >= 0)
        if lower:
            fits &= percent * size <= 100 * (edges[np.maximum(band, 0) + 1] - 1)
        count = ranges[np.maximum(band, 0)]
        part = ((high * count[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        begins = np.ones(len(hashes), dtype=bool)
        begins[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(begins)
        if not len(head):
            continue
        filled = np.bincount(row[head], minlength=len(size))
        total = _sums(mixed, np.append(head, len(hashes)))
        name = mix(total + band[row[head]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part[head].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        used = fits[row[head]]
        keys.append(name[used])
        rows.append(row[head][used])
        # Empty ranges may be all that two sets agree in: such sets meet by their smallest hashes.
        sparse = np.flatnonzero(fits & (count - filled >= count - differ[np.maximum(band, 0)]))
        for r in sparse.tolist():
            prefix = int(size[r]) - -(-percent * int(size[r]) // 100) + 1
            keys.append(mix(hashes[first[r] : first[r] + prefix] ^ np.uint64(0x94D049BB133111EB)))
            rows.append(np.full(prefix, r))
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def bitmaps(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ``BITMAP_BITS`` bits per set; the bits are those of its elements' hashes."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flags = np.zeros((len(first) - 1, BITMAP_BITS), dtype=np.uint8)
    flags[row, (mix(hashes) >> np.uint64(32)).astype(np.int64) % BITMAP_BITS] = 1
    return np.packbits(flags, axis=1).view(np.uint64)


def most_common(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Bound from above on the intersections of rows of bit tables, by broadcasting.

    A bit that is set on one side only stands for an element that the other side lacks.
    """
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(a_size - only_a, b_size - only_b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def prefix(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its smallest hashes a set shows, and how many of them every set it links with shows as well.

    Linked sets of sizes a and b have ``o >= ceil(percent * max(a, b) / 100)`` hashes in common.  The k-th
    smallest of those is among the first ``a - o + k`` of one set and the first ``b - o + k`` of the other.
    """

    def least(x: np.ndarray) -> np.ndarray:
        return -(-percent * x // 100)

    def spare(x: np.ndarray) -> np.ndarray:
        return x - least(x) + 1

    # The other set has least(size) hashes or more, and spare() never falls with the size.
    return np.minimum(size, 2 * spare(size) - 1), np.minimum(spare(least(size)), least(size))


def _needed(size: str, percent: int) -> Column:
    """The second number of :func:`prefix`, for a column."""
    least = F.expr(f"({percent} * {size} + 99) div 100")
    again = F.expr(f"({percent} * (({percent} * {size} + 99) div 100) + 99) div 100")
    return F.least(least - again + 1, least)


def supported(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """one, shared: how many hashes of the prefix of each set (by the first half of its digest) other sets show.

    Sets without any are left out.  Copies in several blocks may count a hash more than once, never less.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        entries, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            key, owner = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            order = np.argsort(key)
            key, owner = key[order], owner[order]
            head, run = runs(key)
            several = np.diff(np.append(head, len(key))) > 1
            # Sets that share a hash within the block know it; other blocks hear of them once.
            name, times = np.unique(owner[several[run]], return_counts=True)
            told = np.where(several, _SEVERAL, owner[head])
            bucket = np.concatenate([bucket_of(mix(key[head])), bucket_of(mix(name))])
            columns = {
                "key": np.concatenate([key[head], np.zeros(len(name), dtype=np.uint64)]),
                "owner": np.concatenate([told, name]),
                "times": np.concatenate([np.zeros(len(head), dtype=np.uint32), times.astype(np.uint32)]),
            }
            yield from pack(bucket, columns)

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                hashes, first = shingles(chunk, n)
                one, _ = _digest(hashes, first)
                size = np.diff(first)
                fresh = np.array([not (x in seen or seen.add(x)) for x in one.tolist()], dtype=bool)
                shown = np.where(fresh, prefix(size, percent)[0], 0)
                row = np.repeat(np.arange(chunk.rows), shown)
                at = np.arange(len(row)) - np.repeat(np.cumsum(shown) - shown, shown) + first[row]
                parts.append((hashes[at], one[row]))
                entries += len(at)
                if entries >= BLOCK_ENTRIES:
                    yield from flush()
                    parts, entries = [], 0
                    seen.clear()
        if entries:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(batches, _SHARE)
        told = own["times"] > 0
        key, owner = own["key"][~told], own["owner"][~told]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        head, run = runs(key)
        several = np.diff(np.append(head, len(key))) > 1
        here = owner[several[run] & (owner != _SEVERAL)] if len(key) else owner
        name, at = np.unique(np.concatenate([here, own["owner"][told]]), return_inverse=True)
        weight = np.concatenate([np.ones(len(here), dtype=np.int64), own["times"][told].astype(np.int64)])
        shared = np.zeros(len(name), dtype=np.int64)
        np.add.at(shared, at, weight)
        for lo in range(0, len(name), 1 << 16):
            here = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(name[here].view(np.int64)), pa.array(shared[here])], ["one", "shared"])

    known = docs.where("doc_id is not null and text is not null").select("text")
    met = spread(known.mapInArrow(send, packed_schema(_SHARE))).mapInArrow(meet, "one long, shared long")
    return met.groupBy("one").agg(F.sum("shared").alias("shared"))


def measured(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and the 128-bit digest of the set of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            one, two = size.astype(np.uint64), size.astype(np.uint64)
            for chunk in chunks(batch.column("text")):
                hashes, first = shingles(chunk, n)
                here = slice(chunk.lo, chunk.hi)
                size[here] = np.diff(first)
                one[here], two[here] = _digest(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["doc_id", "n_shingles", "one", "two"],
            )

    fields = [docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("n_shingles", "one", "two"))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def _pair_counts(leader: np.ndarray, member: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (leader, member) once, with its tiles added up."""
    order = np.lexsort((member, leader))
    leader, member, tiles = leader[order], member[order], tiles[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (leader[1:] != leader[:-1]) | (member[1:] != member[:-1])
    head = np.flatnonzero(new)
    return leader[head], member[head], np.add.reduceat(tiles, head) if len(head) else tiles


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id as long, text and the place of the id in a table of :func:`member_bits`."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.withColumn("place", bit_place("doc_id"))


def _asked(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    return batch.take(pa.array(np.flatnonzero(maybe(table, batch.column("place").to_numpy()))))


def stars(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """leader, member, tiles: every tile of several documents as a star around a small id.

    Of the documents in ``wanted`` (node), and a few more.  ``tiles`` counts those of the pair in one place; a pair may come from several places.
    """
    table = docs.sparkSession.sparkContext.broadcast(member_bits(wanted, "node"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        entries, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            # Of a tile's members in the block the first goes on; the others are pairs with it already.
            key, doc = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            head, run = runs(key)
            leader = doc[head][run]
            other = np.ones(len(key), dtype=bool)
            other[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            other &= doc != leader
            settled, member, tiles = _pair_counts(leader[other], doc[other], np.ones(int(other.sum()), dtype=np.int64))
            # A pair travels as an entry with the number of its tiles in place of a tile's name.
            names = np.concatenate([key[head], tiles.astype(np.uint64)])
            behind = np.concatenate([np.zeros(len(head), dtype=np.int64), member - settled])
            bucket = np.concatenate([bucket_of(key[head]), bucket_of(mix(member.astype(np.uint64)))])
            yield from pack(bucket, {"key": names, "doc": np.concatenate([doc[head], settled]), "behind": behind})

        for batch in batches:
            batch = _asked(batch, table.value)
            ids = batch.column("doc_id").to_numpy()
            for chunk in chunks(batch.column("text")):
                hashes, first = shingles(chunk, n)
                # Equal sets are linked by their digests; one of them stands for all of the block.
                digests = list(zip(*(x.tolist() for x in _digest(hashes, first)), strict=True))
                fresh = np.zeros(chunk.rows, dtype=bool)
                for row, digest in enumerate(digests):
                    if digest not in seen:
                        seen.add(digest)
                        fresh[row] = True
                if not fresh.all():
                    size = np.diff(first)
                    hashes = hashes[np.repeat(fresh, size)]
                    first = np.append(0, np.cumsum(np.where(fresh, size, 0)))
                key, row = tile_keys(hashes, first, percent)
                parts.append((key, ids[chunk.lo + row]))
                entries += len(key)
                if entries >= BLOCK_ENTRIES:
                    yield from flush()
                    parts, entries = [], 0
                    seen.clear()
        if entries:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(batches, _ENTRY)
        settled = own["behind"] != 0
        leader, tiles = own["doc"][settled], own["key"][settled].astype(np.int64)
        member = leader + own["behind"][settled]
        key, doc = own["key"][~settled], own["doc"][~settled]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        head, run = runs(key)
        first = doc[head][run] if len(run) else doc
        other = (doc != first) & np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
        more = np.ones(int(other.sum()), dtype=np.int64)
        columns = _pair_counts(*(np.concatenate(x) for x in ((leader, first[other]), (member, doc[other]), (tiles, more))))
        for lo in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in columns], ["leader", "member", "tiles"])

    return spread(_placed(docs).mapInArrow(send, packed_schema(_ENTRY))).mapInArrow(meet, _STAR)


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """doc, hashes (sorted, 8 bytes each), bits: the sets of the documents in ``wanted`` (node), and a few more.

    A task gives a row once, however often it is repeated.
    """
    table = docs.sparkSession.sparkContext.broadcast(member_bits(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            batch = _asked(batch, table.value)
            ids = batch.column("doc_id")
            for chunk in chunks(batch.column("text")):
                hashes, first = shingles(chunk, n)
                named = zip(ids[chunk.lo : chunk.hi].to_pylist(), *(x.tolist() for x in _digest(hashes, first)), strict=True)
                new = [(r, x) for r, x in enumerate(named) if x not in seen and not seen.add(x)]
                bits = bitmaps(hashes, first)
                rows = [r for r, _ in new]
                sets = [hashes[first[r] : first[r + 1]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for _, x in new], pa.int64()), pa.array(sets, pa.binary()), pa.array([bits[r].tobytes() for r in rows], pa.binary())],
                    ["doc", "hashes", "bits"],
                )

    return _placed(docs).mapInArrow(run, "doc long, hashes binary, bits binary").where("octet_length(hashes) > 0")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bit counts first, then the sorted arrays."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for x in ("a_bits", "b_bits")]
            size = [batch.column(x).to_numpy() for x in ("a_size", "b_size")]
            yield batch.filter(pa.array(links(most_common(*bits, *size), *size, percent))).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                keep.append(bool(links(_common(a, b), len(a), len(b), percent)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    # One exchange of each column serves both sides.
    dealt = {column: sets.select("doc", column, F.octet_length("hashes").alias("bytes")).repartition("doc") for column in ("bits", "hashes")}

    def side(name: str, column: str) -> DataFrame:
        return dealt[column].select(F.col("doc").alias(name), F.col(column).alias(f"{name}_{column}"), (F.col("bytes") / 8).cast("long").alias(f"{name}_size"))

    near = pairs.select("a", "b").join(side("a", "bits"), "a").join(side("b", "bits"), "b").mapInArrow(bounded, "a long, b long")
    return near.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").mapInArrow(exact, "a long, b long").distinct()


def banded(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (cluster, node, component, size) with band: its own and, as the larger one, the band below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bands(percent)[0]
        for batch in batches:
            size = batch.column("size").to_numpy()
            own = np.searchsorted(edges, size, side="right") - 1
            below = np.flatnonzero((own > 0) & (percent * size <= 100 * (edges[own] - 1)))
            for row, band in ((np.arange(len(own)), own), (below, own[below] - 1)):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(band)], [*columns, "band"])

    columns = ["cluster", "node", "component", "size"]
    return members.select(*columns).mapInArrow(run, ", ".join(f"{x} long" for x in [*columns, "band"]))


def _cluster_links(members: DataFrame, sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b) between components within clusters: enough to connect them, or every link.

    ``members`` has cluster, node and component.  Sets that link have a band in common, so
    the members of a cluster in one band are cut into blocks of bounded size, and every two
    blocks meet in one task.
    """
    sets = sets.withColumnRenamed("doc", "node").withColumn("size", (F.octet_length("hashes") / 8).cast("long"))
    # An id of several sets has a row for each size.
    groups = cut_lineage(banded(members.join(sets.select("node", "size").distinct(), "node"), percent))
    group = ["cluster", "band"]
    sizes = groups.groupBy(*group).agg(
        F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    # Members of one component have nothing left to compare.
    sizes = sizes.where("low <> high").select(*group, "blocks")
    placed = groups.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each member goes to as many comparisons as there are blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread_out = placed.withColumn("other", other).select(
        F.xxhash64(*group, F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") > F.col("other")).alias("right"),
        "node",
        "size",
        "component",
    )
    rows = spread_out.join(sets, ["node", "size"]).repartition("task").sortWithinPartitions("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            task = table.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1])) if len(task) else 0
            yield from _compare_tasks(table.slice(0, cut), percent, every)
            rest = table.slice(cut)
        if rest is not None:
            yield from _compare_tasks(rest, percent, every)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _compare_tasks(table: pa.Table, percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    task, node, component = (table.column(x).to_numpy() for x in ("task", "node", "component"))
    right = table.column("right").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(sets), -1)
    size = np.array([len(x) for x in sets])
    head = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
    found: list[tuple[int, int]] = []
    for lo, hi in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
        group = np.arange(lo, hi)
        ahead, behind = group[~right[lo:hi]], group[right[lo:hi]]
        # A block against itself has no right side.
        behind = behind if len(behind) else ahead
        parent = {c: c for c in component[lo:hi].tolist()}

        def root(c: int, parent: dict[int, int] = parent) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i in ahead.tolist():
            rest = behind[component[behind] != component[i]]
            rest = rest[links(np.minimum(size[rest], size[i]), size[rest], size[i], percent)]
            if not len(rest):
                continue
            rest = rest[links(most_common(bits[i], bits[rest], size[i], size[rest]), size[rest], size[i], percent)]
            for j in rest.tolist():
                a, b = root(int(component[i])), root(int(component[j]))
                if (every or a != b) and links(_common(sets[i], sets[j]), size[i], size[j], percent):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["a", "b"])


def _paired(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every id with the representative of its set, the pairs of representatives in a star, and their sets."""
    sets_known = rows.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "one", "two"]
    # Rows of one id are one node: the id's smallest representative links them all.
    first = sets_known.groupBy(*same).agg(F.min("doc_id").cast("long").alias("rep"))
    nodes = few_parts(cut_lineage(sets_known.join(first, same).select(F.col("doc_id").cast("long").alias("doc"), "rep")))
    # Only sets that share enough with others go on, each by its representative.
    alive = first.join(supported(docs, n, percent), "one").where(F.col("shared") >= _needed("n_shingles", percent))
    alive = alive.select(F.col("rep").alias("node"))
    # Copies stand for their set: pairs are of different sets, and few documents' sets are needed.
    pairs = stars(docs, alive, n, percent).groupBy("leader", "member").agg(F.sum("tiles").alias("tiles"))
    for side, name in (("leader", "a"), ("member", "b")):
        pairs = pairs.join(nodes.select(F.col("doc").alias(side), F.col("rep").alias(name)), side)
    pairs = few_parts(cut_lineage(pairs.where("a <> b").groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes, pairs, cut_lineage(sets_of(docs, wanted, n))


def linked(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Every link (a, b) with a < b between different sets, each named by its smallest id.

    Ids of equal sets link as well; see :func:`link_counts`.  The links of a group of
    near copies grow with the square of its sets, as the result does.
    """
    _, pairs, sets = _paired(docs, cut_lineage(measured(docs, n)), n, percent)
    return _every_link(pairs, sets, percent)


def _every_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    members = components(pairs).select(F.col("component").alias("cluster"), "node", F.col("node").alias("component"))
    return _cluster_links(cut_lineage(members), sets, percent, every=True)


def link_counts(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id and n_links of every id with words: how many other ids it links with, by equal sets or by :func:`linked`.

    For an id with rows of different sets, the links of each are counted.
    """
    nodes, pairs, sets = _paired(docs, cut_lineage(measured(docs, n)), n, percent)
    nodes = cut_lineage(nodes.distinct())
    size = nodes.groupBy("rep").agg((F.count("*") - 1).alias("copies"))
    found = cut_lineage(_every_link(pairs, sets, percent))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum(F.col("copies") + 1).alias("near"))
    total = size.join(near.withColumnRenamed("a", "rep"), "rep", "left")
    total = total.select("rep", (F.col("copies") + F.coalesce("near", F.lit(0))).alias("n_links"))
    return nodes.join(total, "rep").groupBy(F.col("doc").alias("doc_id")).agg(F.sum("n_links").alias("n_links"))


def joined(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    rows = cut_lineage(measured(docs, n))
    nodes, pairs, sets = _paired(docs, rows, n, percent)
    by_digest = nodes.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    # Each member first tries the leader with which it shares most tiles.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("tiles", -F.col("a"))).alias("a"))
    edges = few_parts(cut_lineage(verified(best, sets, percent).unionByName(by_digest)))
    labels = components(edges)

    # Sets that share tiles, directly or by others, make a cluster; links never leave it.
    clusters = components(pairs).withColumnRenamed("component", "cluster")
    members = clusters.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A cluster of two has been compared as a whole.
    several = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    members = cut_lineage(members.join(several.where("n > 2 and x <> y"), "cluster", "left_semi"))
    if not members.isEmpty():
        rest = cut_lineage(_cluster_links(members, sets, percent))
        if not rest.isEmpty():
            labels = components(edges.unionByName(rest))
    named = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked documents - that of the smallest id - columns unchanged.

    Rows without words or without an id stay.  Of several rows of an id that stays the one with the
    smallest text does.  Only rows that may have to go, by a
    filter of bounded size, are shuffled.
    """
    found = joined(docs, n, percent)
    # Copies of a row share the smallest id of their group as well; one of them stays.
    repeated = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct().withColumn("__whole", F.lit(True))
    gone = cut_lineage(gone.unionByName(repeated.withColumn("__whole", F.lit(False))))
    table = docs.sparkSession.sparkContext.broadcast(member_bits(gone, "doc_id"))
    columns = docs.columns

    def picked(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column("__place")
                hit = np.zeros(batch.num_rows, dtype=bool)
                known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                hit[known] = maybe(table.value, place.take(pa.array(known)).to_numpy().astype(np.int64))
                yield batch.filter(pa.array(hit == asked)).select(columns)

        return run

    placed = docs.withColumn("__place", F.when(F.col("doc_id").isNotNull(), bit_place(F.col("doc_id").cast("long"))))
    clear = placed.mapInArrow(picked(False), docs.schema)
    asked = placed.mapInArrow(picked(True), docs.schema).join(gone, "doc_id", "left")
    stays = F.col("__whole").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # A partial minimum on both sides of the shuffle, so that an id of many rows is no hot group.
    row = F.struct(*columns)
    once = asked.where(~stays & ~F.col("__whole")).groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("__row"))
    return clear.unionByName(asked.where(stays).select(*columns)).unionByName(once.select("__row.*"))
