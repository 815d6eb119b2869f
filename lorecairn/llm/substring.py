"""Removal of word sequences that a document with a smaller id also has.

A sequence of ``length`` words is looked for by doubling.  A window of half the
length that stands in one document only can't be part of a longer repeat, so
half windows are compared first and only those found in several documents are
extended to the whole length, to every window around them; none is left
after that, as a whole window is all that decides.

Of the half windows only the smallest hash in each whole window is compared: a
sequence that two documents share has the same smallest half window in both.

Whole windows are compared by 96 bits of hash.  A block of documents settles
repeats within itself and sends only the windows of the smallest id, so a passage
that a third of the corpus shares is sent once per block.

Null texts have no words.  Documents with a null id lose nothing and take nothing
from others; rows with one id never take words from each other.  Texts shorter
than ``length`` words stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .postings import BLOCK_ENTRIES, BUCKETS, bucket_of, pack, packed_schema, runs, spread, unpack
from .textarrays import chunks, mix, ngram_hash, words

LENGTH = 50
#: One posting: hash of the window, id and text of its document, place in it.
_HALF = {"key": np.dtype("<u8"), "doc": np.dtype("<i8"), "text_key": np.dtype("<i4"), "at": np.dtype("<i4"), "known": np.dtype("?")}
_WHOLE = {"key": np.dtype("<u8"), "check": np.dtype("<u4"), "doc": np.dtype("<i8"), "text_key": np.dtype("<i4"), "at": np.dtype("<i4"), "known": np.dtype("?")}
_PLACE = {"doc": np.dtype("<i8"), "text_key": np.dtype("<i4"), "at": np.dtype("<i4")}
_PLACES = "id long, text_key int, at array<int>"


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest hash among ``width`` values from each place on."""
    best, span = np.arange(len(hashes)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] < hashes[a], b, a)

    while span * 2 <= width:
        best = better(best[:-span], best[span:])
        span *= 2
    rest = width - span
    return better(best[: len(best) - rest], best[rest:]) if rest else best


def _inside(first: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that lie within one document."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Block:
    """Gathers entries and sends them on, thinned, in packed rows."""

    def __init__(self, fields: dict[str, np.dtype], thin) -> None:
        self.fields, self.thin = fields, thin
        self.parts: list[dict[str, np.ndarray]] = []
        self.entries = 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.entries += len(columns["key"])
        if self.entries >= BLOCK_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.entries:
            own = {name: np.concatenate([x[name] for x in self.parts]) for name in self.parts[0]}
            own = self.thin(own)
            # What is settled needs no key and is spread evenly.
            bucket = np.where(own["known"], np.arange(len(own["key"])) // 512 % BUCKETS, bucket_of(own["key"]))
            yield from pack(bucket, {name: own[name].astype(kind) for name, kind in self.fields.items()})
        self.parts, self.entries = [], 0


def _thin_half(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Half windows that the block has in several documents are known to repeat; two stand for all."""
    order = np.lexsort((own["doc"], own["key"]))
    own = {name: values[order] for name, values in own.items()}
    head, run = runs(own["key"])
    low, high = own["doc"][head], own["doc"][np.append(head[1:], len(run)) - 1]
    known = (low != high)[run]
    ends = np.zeros(len(run), dtype=bool)
    ends[head] = True
    ends[np.append(head[1:], len(run)) - 1] = True
    stands = known & ends
    out = {name: np.concatenate([values, values[stands]]) for name, values in own.items()}
    out["known"] = np.concatenate([known, np.zeros(stands.sum(), dtype=bool)])
    return out


def _thin_whole(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows that a smaller id of the block has too go for certain; the others are undecided."""
    order = np.lexsort((own["doc"], own["check"], own["key"]))
    own = {name: values[order] for name, values in own.items()}
    head, run = _whole_runs(own)
    own["known"] = own["doc"] > own["doc"][head][run]
    return own


def _whole_runs(own: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(own["key"]), dtype=bool)
    new[1:] = (own["key"][1:] != own["key"][:-1]) | (own["check"][1:] != own["check"][:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _places(own: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The places found in this task, packed by bucket of documents: few rows, however many documents."""
    bucket = (mix(own["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    yield from pack(bucket, {name: own[name].astype(kind) for name, kind in _PLACE.items()})


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all places found anywhere; a task has all entries of its documents."""
    own = unpack(batches, _PLACE)
    if not len(own["doc"]):
        return
    order = np.lexsort((own["at"], own["text_key"], own["doc"]))
    doc, text, at = (own[name][order] for name in ("doc", "text_key", "at"))
    other = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
    fresh = other | np.append(True, at[1:] != at[:-1])
    doc, text, at, head = doc[fresh], text[fresh], at[fresh], np.flatnonzero(other[fresh])
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array(at))
    yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(text[head]), lists], ["id", "text_key", "at"])


def _document_buckets(docs: DataFrame) -> int:
    return max(256, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _repeated_halves(docs: DataFrame, length: int) -> DataFrame:
    half = (length + 1) // 2
    width = length - half + 1
    buckets = _document_buckets(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(_HALF, _thin_half)
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for chunk in chunks(batch.column("text")):
                found = words(chunk)
                start = _inside(found.first, length)
                if not len(start):
                    continue
                hashes = ngram_hash(found.hash, half)
                at = np.unique(_smallest(hashes, width)[start])
                row = np.searchsorted(found.first, at, side="right") - 1
                own = chunk.lo + row
                yield from block.add(key=hashes[at], doc=ids[own], text_key=keys[own], at=(at - found.first[row]).astype(np.int32))
        yield from block.flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(batches, _HALF)
        sure = {name: values[own["known"]] for name, values in own.items()}
        open_ = {name: values[~own["known"]] for name, values in own.items()}
        order = np.lexsort((open_["doc"], open_["key"]))
        open_ = {name: values[order] for name, values in open_.items()}
        head, run = runs(open_["key"])
        if len(run):
            several = (open_["doc"][head] != open_["doc"][np.append(head[1:], len(run)) - 1])[run]
            open_ = {name: values[several] for name, values in open_.items()}
        yield from _places({name: np.concatenate([sure[name], open_[name]]) for name in own}, buckets)

    met = spread(docs.mapInArrow(send, packed_schema(_HALF))).mapInArrow(compare, packed_schema(_PLACE))
    return spread(met).mapInArrow(_gather, _PLACES)


def _repeated_wholes(found: DataFrame, length: int) -> DataFrame:
    """``found`` has text and the places of its repeated half windows."""
    half = (length + 1) // 2
    buckets = _document_buckets(found)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(_WHOLE, _thin_whole)
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            places = batch.column("at")
            for chunk in chunks(batch.column("text")):
                found = words(chunk)
                if len(found.hash) < length:
                    continue
                asked_at = np.flatnonzero(_windows_asked(chunk.rows, found.first, places, chunk.lo, length, half, len(found.hash)))
                allowed = np.zeros(len(found.hash), dtype=bool)
                allowed[_inside(found.first, length)] = True
                start = asked_at[allowed[asked_at]]
                row = np.searchsorted(found.first, start, side="right") - 1
                key = ngram_hash(found.hash, length)[start]
                check = ngram_hash(mix(found.hash ^ np.uint64(0x5851F42D4C957F2D)), length, 1)[start].astype(np.uint32)
                own = chunk.lo + row
                yield from block.add(key=key, check=check, doc=ids[own], text_key=keys[own], at=(start - found.first[row]).astype(np.int32))
        yield from block.flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpack(batches, _WHOLE)
        sure = {name: values[own["known"]] for name, values in own.items()}
        open_ = {name: values[~own["known"]] for name, values in own.items()}
        order = np.lexsort((open_["doc"], open_["check"], open_["key"]))
        open_ = {name: values[order] for name, values in open_.items()}
        head, run = _whole_runs(open_)
        if len(run):
            gone = open_["doc"] > open_["doc"][head][run]
            open_ = {name: values[gone] for name, values in open_.items()}
        yield from _places({name: np.concatenate([sure[name], open_[name]]) for name in own}, buckets)

    met = spread(found.mapInArrow(send, packed_schema(_WHOLE))).mapInArrow(compare, packed_schema(_PLACE))
    return spread(met).mapInArrow(_gather, _PLACES)


def _windows_asked(rows: int, first: np.ndarray, places: pa.Array, lo: int, length: int, half: int, n: int) -> np.ndarray:
    """Which window starts lie around one of the given half windows."""
    change = np.zeros(n + 1, dtype=np.int64)
    for row in range(rows):
        at = places[lo + row].values.to_numpy() + first[row]
        np.add.at(change, np.maximum(at - (length - half), first[row]), 1)
        np.subtract.at(change, at + 1, 1)
    return np.cumsum(change[:n]) > 0


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) with at: starts of the windows that go (null: none).

    The texts are dealt once: both joins have the same keys, which are never null, and
    the same columns, so that Spark reuses the exchange.
    """
    keyed = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.hash(F.col("doc_id").isNull(), "text").alias("text_key"),
    )
    known = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.lit(False), "text").alias("text_key"), "text"
    )
    halves = _repeated_halves(known, length)
    found = keyed.join(halves, ["id", "text_key"]).select("doc_id", "text", F.col("id"), "text_key", "at")
    wholes = _repeated_wholes(found, length)
    return keyed.join(wholes, ["id", "text_key"], "left").select("doc_id", "text", "at")


def deduplicated(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Kept words are joined by one space.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, at in zip(batch.column("text"), batch.column("at"), strict=True):
                found = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n_words.append(len(found))
                if at.is_valid and len(at):
                    change = np.zeros(len(found) + 1, dtype=np.int64)
                    start = at.values.to_numpy()
                    np.add.at(change, start, 1)
                    np.subtract.at(change, start + length, 1)
                    kept = np.cumsum(change[:-1]) == 0
                    found = [found[i] for i in np.flatnonzero(kept).tolist()]
                n_removed.append(n_words[-1] - len(found))
                text = b" ".join(found)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))
    rows = removals(docs.select("doc_id", "text"), length)
    return rows.mapInArrow(cut, T.StructType(fields))
