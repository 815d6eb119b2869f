"""Benchmark decontamination by exact word counts, common subsequences and latent cosines.

1. Words are hashed to features, whose document frequencies are counted over all
   documents.
2. A randomised singular value decomposition of the benchmark's TF-IDF passages
   gives a low-rank space: tasks multiply their passages with the sketch, the driver
   factors the sums, whose size the sketch's width and the benchmark's words fix.
   Corpus passages take no part in the fit: they would only turn the space to words
   that are frequent in the corpus and tell no item from another.
3. Every document is cut into overlapping windows.  Window lengths double, and an
   item meets windows of one to two times its own length, a quarter of the window
   apart and read with a quarter more on both sides.  A window is a candidate for an
   item if it holds enough of the item's words for the common subsequence of step 4.
   Words share buckets, so the count is never too small, however frequent the item
   is and whatever stands around it: a candidate may fail step 4, but none is missed.
4. Candidates are read again: the longest common subsequence with the item must
   cover most of it, and so must that of the item's closing words, its answer.
5. The cosine of window and item in the latent space is given with each leak.  Items
   of fewer than ``COUNTED`` words, of which any text holds most by chance if they are
   frequent, are found wherever their words stand in a row; only for a changed copy of
   such an item is a cosine of ``COSINE`` a condition too.

Words are lower-case runs of letters, digits and the marks on them, in any script; quotes and dashes end them.  Null or empty texts and items
without words match nothing; each of several equal rows gets the same answer.
An empty benchmark or table gives no leaks.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .textarrays import Chunk, _runs, chunks, prefix_sums, range_hash

FEATURES, RANK, OVERSAMPLE, POWER = 1 << 15, 160, 16, 1
#: Benchmark items compared in one pass; more are taken in blocks.
ITEM_BLOCK = 20_000
SHORTEST = 24
COSINE, SHARE, ANSWER_SHARE = 0.42, 0.6, 0.5
#: Words of an item from which on its candidates are counted, not retrieved by cosine.
COUNTED = 13
#: Sets how many words share a bucket: fewer buckets let more candidates through, and lose none.
BUCKETS_PER_WORD = 4
BLOCK_BYTES = 1 << 18
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LEAKS = "array<struct<item_id:long,cosine:double,lcs_words:int,item_words:int>>"


@cache
def _in_words() -> np.ndarray:
    """Which code points stand in words: letters, digits and the marks on them."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), dtype=bool, count=0x110000)


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk of lower-case texts and the first word of each document."""
    data = chunk.data
    inside = _INSIDE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            longer = more >= k
            point[longer] = point[longer] << 6 | (data[lead[longer] + k] & 0x3F)
        other = ~_in_words()[point]
        lead, more = lead[other], more[other]
        for k in range(4):
            inside[lead[more >= k] + k] = False
    start, end = _runs(inside, chunk.offsets)
    return range_hash(prefix_sums(data), start, end), np.searchsorted(start, chunk.offsets)


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % FEATURES


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature; one row per feature reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            total[FEATURES] += batch.num_rows
            for chunk in chunks(batch.column("text"), BLOCK_BYTES, lower=True):
                hashes, first = terms(chunk)
                seen = np.zeros((chunk.rows, FEATURES), dtype=bool)
                seen[np.repeat(np.arange(chunk.rows), np.diff(first)), _feature(hashes)] = True
                total[:FEATURES] += seen.sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "docs"])

    rows = docs.select("text").mapInArrow(count, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
    found = dict(rows.collect())
    count_ = np.array([found.get(i, 0) for i in range(FEATURES)])
    return np.log((found.get(FEATURES, 0) + 1) / (count_ + 1)).astype(np.float32) + np.float32(1e-3)


@dataclass
class Windows:
    """Windows of four steps, one step apart: their first and last words, and with one more step on both sides; their documents.

    ``step_of`` has the step of every word and ``step`` the first step of every window, both counted over all documents.
    """

    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray
    step_of: np.ndarray
    step: np.ndarray


def _windows(first: np.ndarray, step: int) -> Windows:
    """Windows of all documents; a document of fewer steps than a window has one."""
    size = np.diff(first)
    steps = -(-size // step)
    count = np.where(size > 0, np.maximum(steps - 4, 0) + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + number * step
    word = np.arange(first[-1]) - np.repeat(first[:-1], size)
    base = np.cumsum(steps) - steps
    return Windows(
        start,
        np.minimum(start + 4 * step, first[row + 1]),
        np.maximum(start - step, first[row]),
        np.minimum(start + 5 * step, first[row + 1]),
        row,
        np.repeat(base, size) + word // step,
        base[row] + number,
    )


@dataclass
class Features:
    """Weight of every feature, and which row of the space it has; those that no item has share the last, zero row."""

    idf: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.row.max()) + 1


def item_features(items: DataFrame, idf: np.ndarray) -> Features:
    """The features of the benchmark; at most one row each reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), lower=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_feature(terms(chunk)[0])))], ["feature"])

    used = sorted(r["feature"] for r in items.select("text").mapInArrow(run, "feature long").distinct().collect())
    row = np.full(FEATURES, len(used), dtype=np.int32)
    row[used] = np.arange(len(used))
    return Features(idf, row)


def _sums(hashes: np.ndarray, space: np.ndarray, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' latent vectors and of their squared weights."""
    feature = _feature(hashes)
    vectors = np.zeros((len(hashes) + 1, space.shape[1]), dtype=np.float32)
    np.cumsum(space[features.row[feature]], axis=0, out=vectors[1:])
    return vectors, np.append(0.0, np.cumsum(features.idf[feature].astype(np.float64) ** 2))


def latent_space(items: DataFrame, features: Features, seed: int = 3) -> np.ndarray:
    """Latent vector of every feature of the benchmark: its weight times its right singular vectors."""
    passages = cut_lineage(items.select("text").repartition(4))
    context = items.sparkSession.sparkContext
    size = features.rows
    weight = np.zeros((size, 1))
    weight[features.row, 0] = features.idf
    weight[-1] = 0

    def total(right: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over passages of A^T (A right), or of (A right)^T (A right)."""
        shared = context.broadcast(((right * weight).astype(np.float32), features))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, features = shared.value
            out = np.zeros((space.shape[1],) * 2 if gram else space.shape)
            for batch in batches:
                for chunk in chunks(batch.column("text"), BLOCK_BYTES, lower=True):
                    hashes, first = terms(chunk)
                    first = first[np.append(True, np.diff(first) > 0)]
                    if not len(hashes):
                        continue
                    vectors, squares = _sums(hashes, space, features)
                    length = np.sqrt(np.maximum(np.diff(squares[first]), 1e-9))[:, None]
                    left = np.diff(vectors[first], axis=0) / length
                    if gram:
                        out += left.T @ left
                    else:
                        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                        np.add.at(out, features.row[_feature(hashes)], (left / length)[owner])
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], ["sums"])

        # Four tasks send a matrix of the sketch's width and one row per feature at most.
        shape = (right.shape[1],) * 2 if gram else right.shape
        out = np.zeros(shape)
        for row in passages.mapInArrow(run, "sums binary").collect():
            out += np.frombuffer(bytes(row["sums"]), dtype=np.float32).reshape(shape)
        shared.unpersist()
        return out if gram else out * weight

    sketch = np.random.default_rng(seed).standard_normal((size, RANK + OVERSAMPLE))
    for _ in range(1 + POWER):
        sketch, _ = np.linalg.qr(total(sketch, False))
    values, vectors = np.linalg.eigh(total(sketch, True))
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > 1e-6 * max(values.max(), 1e-12)]
    return (sketch @ vectors[:, best] * weight).astype(np.float32)


def common_length(item: dict[int, int], text: list[int], size: int) -> int:
    """Longest common subsequence; ``item`` maps a word to the bits of its places among ``size``."""
    full = (1 << size) - 1
    row = full
    for word in text:
        match = row & item.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return size - row.bit_count()


def _bits(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, word in enumerate(words):
        out[word] |= 1 << i
    return dict(out)


@dataclass
class Items:
    """Benchmark items of one window length: ids, latent vectors, and their words as bit tables.

    The vectors are scaled so that a window's product with an item is 1 for the item itself.  ``bucket`` has
    the bucket of each word of all items' vocabulary, -1 if no item here has it, and ``counts`` the items' words per
    bucket; without buckets, candidates are retrieved by cosine or, word for word, by ``rows``: the items of a number
    of words by the hash of all their words.
    """

    window: int
    ids: list[int]
    vectors: np.ndarray
    sizes: list[int]
    whole: list[dict[int, int]]
    answer: list[tuple[int, dict[int, int]]]
    rows: dict[int, dict[int, list[tuple[int, np.ndarray]]]]
    bucket: np.ndarray | None = None
    counts: np.ndarray | None = None


@dataclass
class Prepared:
    """The sorted word hashes of all items, their features, and the items by window length."""

    words: np.ndarray
    known: np.ndarray
    groups: list[Items]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a text the items have, and where in ``words`` each of them is."""
        place = np.flatnonzero(self.known[_feature(hashes)])
        at = np.minimum(np.searchsorted(self.words, hashes[place]), len(self.words) - 1)
        same = self.words[at] == hashes[place]
        return place[same], at[same]


def _in_a_row(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on."""
    count = max(len(hashes) - size + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return out


def _by_row(found: list[np.ndarray]) -> dict[int, dict[int, list[tuple[int, np.ndarray]]]]:
    out: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = defaultdict(lambda: defaultdict(list))
    for i, own in enumerate(found):
        out[len(own)][int(_in_a_row(own, len(own))[0])].append((i, own))
    return {size: dict(x) for size, x in out.items()}


def _buckets(found: list[np.ndarray], window: int, words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of ``words``, and the items' words per bucket; the most frequent words have buckets of their own."""
    buckets = min(1 << (BUCKETS_PER_WORD * window - 1).bit_length(), 1 << 12)
    own = np.searchsorted(words, np.unique(np.concatenate(found)))
    rank = np.empty(len(own), dtype=np.int64)
    rank[np.argsort(idf[_feature(words[own])], kind="stable")] = np.arange(len(own))
    half = buckets // 2
    bucket = np.full(len(words), -1)
    bucket[own] = np.where(rank < half, rank, half + (rank - half) % half)
    counts = np.zeros((len(found), buckets), dtype=np.float32)
    for i, item in enumerate(found):
        np.add.at(counts[i], bucket[np.searchsorted(words, item)], 1)
    return bucket, counts


def prepare(rows: list[tuple[int, str]], space: np.ndarray, features: Features) -> Prepared:
    groups: dict[tuple[int, bool], list[tuple[int, np.ndarray, np.ndarray]]] = defaultdict(list)
    for chunk in chunks(pa.array([text for _, text in rows], pa.string()), lower=True):
        hashes, first = terms(chunk)
        for row in range(chunk.rows):
            own = hashes[first[row] : first[row + 1]]
            if len(own):
                window = SHORTEST
                while window < len(own):
                    window *= 2
                vectors, squares = _sums(own, space, features)
                unit = vectors[-1] / np.sqrt(max(squares[-1], 1e-9))
                groups[window, len(own) >= COUNTED].append((rows[chunk.lo + row][0], own, unit / max(float(unit @ unit), 1e-9)))
    words = np.unique(np.concatenate([np.array([], dtype=np.uint64), *(x[1] for found in groups.values() for x in found)]))
    known = np.zeros(FEATURES, dtype=bool)
    known[_feature(words)] = True
    out = []
    for (window, counted), found in sorted(groups.items(), key=lambda x: x[0]):
        closing = [x[1][-max(3, len(x[1]) // 4) :].tolist() for x in found]
        buckets = _buckets([x[1] for x in found], window, words, features.idf) if counted else ()
        out.append(
            Items(
                window,
                [x[0] for x in found],
                np.stack([x[2] for x in found]).astype(np.float32),
                [len(x[1]) for x in found],
                [_bits(x[1].tolist()) for x in found],
                [(len(x), _bits(x)) for x in closing],
                {} if counted else _by_row([x[1] for x in found]),
                *buckets,
            )
        )
    return Prepared(words, known, out)


def _at_least(found: np.ndarray, need: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix where it is at least ``need``."""
    return np.divmod(np.flatnonzero(found >= need), found.shape[1])


def _counted(place: np.ndarray, at: np.ndarray, windows: Windows, group: Items) -> Iterator[tuple[int, int]]:
    """Every window and item of which it may hold ``SHARE`` of the words."""
    bucket = group.bucket[at]
    place, bucket = place[bucket >= 0], bucket[bucket >= 0]
    # Six steps from one before the window; those of a neighbouring document only add words.
    seen = np.zeros((int(windows.step_of[-1]) + 6, group.counts.shape[1]), dtype=np.uint8)
    seen[windows.step_of[place] + 1, bucket] = 1
    two = seen[:-1] | seen[1:]
    held = (two[:-4] | two[2:-2] | two[4:])[windows.step].astype(np.float32)
    # A little less than the share, so that rounding loses none.
    need = np.array(group.sizes, dtype=np.float32) * np.float32(SHARE) - np.float32(0.01)
    for lo in range(0, len(group.ids), 1024):
        window, item = _at_least(held @ group.counts[lo : lo + 1024].T, need[lo : lo + 1024])
        yield from zip(window.tolist(), (item + lo).tolist(), strict=True)


def _retrieved(hashes: np.ndarray, windows: Windows, group: Items, space: np.ndarray, features: Features) -> Iterator[tuple[int, int]]:
    """Every window and item with a cosine of ``COSINE``."""
    vectors, squares = _sums(hashes, space, features)
    length = np.sqrt(np.maximum(squares[windows.end] - squares[windows.start], 1e-9)).astype(np.float32)
    latent = (vectors[windows.end] - vectors[windows.start]) / length[:, None]
    for lo in range(0, len(group.ids), 1024):
        window, item = _at_least(latent @ group.vectors[lo : lo + 1024].T, COSINE)
        yield from zip(window.tolist(), (item + lo).tolist(), strict=True)


def _verbatim(hashes: np.ndarray, first: np.ndarray, windows: Windows, group: Items) -> Iterator[tuple[int, int]]:
    """For every item and document that holds it word for word, a window around the first such place."""
    step = group.window // 4
    for size, items in group.rows.items():
        value = _in_a_row(hashes, size)
        hit = np.flatnonzero(np.isin(value, np.array(list(items), dtype=np.uint64)))
        row = np.searchsorted(first, hit, side="right") - 1
        inside = hit + size <= first[row + 1]
        hit, row = hit[inside], row[inside]
        key = np.unique(np.stack([value[hit], row.astype(np.uint64)]), axis=1, return_index=True)[1]
        for place, doc in zip(hit[key].tolist(), row[key].tolist(), strict=True):
            lo, hi = np.searchsorted(windows.row, [doc, doc + 1]).tolist()
            for i, own in items[int(value[place])]:
                if np.array_equal(hashes[place : place + size], own):
                    yield min(lo + (place - int(first[doc])) // step, hi - 1), i


def find(
    hashes: np.ndarray, first: np.ndarray, space: np.ndarray, features: Features, items: Prepared
) -> dict[int, dict[int, tuple[float, int, int]]]:
    """For each document with leaks: item -> (best cosine, words in common, words of the item)."""
    leaks: dict[int, dict[int, tuple[float, int, int]]] = defaultdict(dict)
    if not len(hashes):
        return leaks
    place, at = items.places(hashes)
    for group in items.groups:
        windows = _windows(first, group.window // 4)
        if group.bucket is not None:
            candidates = _counted(place, at, windows, group)
        else:
            candidates = {*_retrieved(hashes, windows, group, space, features), *_verbatim(hashes, first, windows, group)}
        for w, i in candidates:
            text = hashes[windows.low[w] : windows.high[w]].tolist()
            common = common_length(group.whole[i], text, group.sizes[i])
            if common < SHARE * group.sizes[i]:
                continue
            size, answer = group.answer[i]
            if common_length(answer, text, size) < ANSWER_SHARE * size:
                continue
            vectors, squares = _sums(hashes[windows.start[w] : windows.end[w]], space, features)
            value = float(vectors[-1] @ group.vectors[i]) / max(squares[-1], 1e-9) ** 0.5
            best, most, _ = leaks[int(windows.row[w])].get(group.ids[i], (value, common, 0))
            leaks[int(windows.row[w])][group.ids[i]] = (max(best, value), max(most, common), group.sizes[i])
    return dict(leaks)


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each text, in order of their ids; empty if none."""
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    spark = docs.sparkSession
    features = item_features(items, inverse_frequencies(docs))
    space = latent_space(items, features)
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    out = docs.select(*kept).withColumn("leaks", F.array().cast(LEAKS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast((space, features, prepare(sorted((r["item_id"], r["text"]) for r in rows), space, features)))
        out = out.mapInArrow(_search(shared, kept), out.schema)
    return out


def _search(shared, kept: list[str]):
    """Adds the leaks of one block of items to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, features, items = shared.value
        for batch in batches:
            found = batch.column("leaks").to_pylist()
            for chunk in chunks(batch.column("text"), BLOCK_BYTES, lower=True):
                for doc, leaks in find(*terms(chunk), space, features, items).items():
                    new = [
                        {"item_id": item, "cosine": cosine, "lcs_words": common, "item_words": size}
                        for item, (cosine, common, size) in leaks.items()
                    ]
                    found[chunk.lo + doc] = sorted(found[chunk.lo + doc] + new, key=lambda x: x["item_id"])
            kind = batch.schema.field("leaks").type
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], [*kept, "leaks"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark).where(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` that no benchmark item was found in, columns unchanged."""
    columns = docs.columns
    return with_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*columns)
