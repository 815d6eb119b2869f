"""SentencePiece encoding and decoding by vectorised merge rounds.

*Segments.*  A text is an array of symbols, one per character.  Two neighbours
that stand side by side in no piece never come together, so the text is cut there;
spaces begin segments that way.  Equal segments of a chunk are encoded once.

*Rounds.*  All segments of a chunk are one flat array.  In each round every segment finds
the best score among its pairs (a segmented minimum of ranks) and merges the
pairs of that score from left to right.  A segment stops behind a merge whose
new neighbours make a pair at least as good, as the library would take that one
next.  Segments without a pair leave the array, which is then compacted.

*Long segments.*  A segment of more than ``LONG`` symbols (white space or junk of
that length) is merged by a heap in the same order: rounds over it would grow
with its square.

*Decoding.*  The bytes of all pieces are gathered at once; the mark that encoding
sets before a text is taken away again.

Null and empty texts have no pieces, only the end id if one is asked for, and decode to
an empty text; a null list of ids does too.  Every row is handled by itself, so repeated rows, null ids and
other columns do not matter.  Long texts are merged in slices that end between segments;
memory is bounded by the slice and by some twenty bytes per byte of the longest text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textarrays import Chunk, chunks, code_points, prefix_sums, range_hash

#: U+2581, which stands for a space.
MARK = 0x2581
LONG = 2048
#: Texts are encoded in chunks of so many bytes and rows.
ENCODE_BYTES, ENCODE_ROWS = 1 << 19, 4096
#: Symbols of a chunk, or of one long text, that are merged at once.
SLICE = 1 << 19
#: Ids that are decoded at once, the longest list apart.
DECODE_IDS = 1 << 17
_NONE = np.iinfo(np.int32).max
_CHARACTERS = 0x110000
_SIEVE_BITS = 22
_SLOT_BITS = 20


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + length), one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


@dataclass
class PieceModel:
    """The pieces of a model file of the byte-pair kind: their texts, scores and kinds."""

    pieces: list[str]
    scores: list[float]
    #: Ids of the pieces that texts are made of, and of the 256 bytes.
    normal: list[int]
    bytes_: list[int]
    hidden: list[int]
    unknown: int
    end: int

    @classmethod
    def load(cls, model: bytes) -> PieceModel:
        """Read a serialised model; raises for kinds whose rules differ from those here."""
        from sentencepiece import sentencepiece_model_pb2 as format_

        read = format_.ModelProto()
        read.ParseFromString(model)
        rules, trained = read.normalizer_spec, read.trainer_spec
        kinds = format_.ModelProto.SentencePiece
        of = {kind: [i for i, p in enumerate(read.pieces) if p.type == kind] for kind in range(1, 7)}
        plain = rules.name == "identity" and not rules.precompiled_charsmap and rules.add_dummy_prefix
        plain &= not rules.remove_extra_whitespaces and rules.escape_whitespaces and not trained.treat_whitespace_as_suffix
        whole = trained.model_type == format_.TrainerSpec.BPE and trained.byte_fallback and len(of[kinds.BYTE]) == 256
        if not (plain and whole) or of[kinds.USER_DEFINED] or of[kinds.UNUSED]:
            raise ValueError("only byte-pair models with byte fallback and untouched text are supported")
        named = {p.piece: i for i, p in enumerate(read.pieces)}
        return cls(
            [p.piece for p in read.pieces],
            [p.score for p in read.pieces],
            of[kinds.NORMAL],
            [named[f"<0x{x:02X}>"] for x in range(256)],
            of[kinds.CONTROL],
            of[kinds.UNKNOWN][0],
            named[trained.eos_piece],
        )


@dataclass
class Encoder:
    """Tables for merging and for decoding.

    A symbol is the id of its piece; a character that is no piece is the number of
    pieces plus its code point.
    """

    model: PieceModel

    def __post_init__(self) -> None:
        model = self.model
        self.count = len(model.pieces)
        self.width = self.count + _CHARACTERS
        symbol = np.arange(_CHARACTERS, dtype=np.int64) + self.count
        for i in model.normal:
            if len(model.pieces[i]) == 1:
                symbol[ord(model.pieces[i])] = i
        self.symbol = symbol
        known = {model.pieces[i]: i for i in model.normal}
        # The best score has the smallest rank; equal scores have equal ranks.
        rank_of = {s: r for r, s in enumerate(sorted({model.scores[i] for i in model.normal}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        neighbours = set()
        for piece, made in known.items():
            for cut in range(1, len(piece)):
                sides = piece[:cut], piece[cut:]
                neighbours.add((ord(piece[cut - 1]), ord(piece[cut])))
                ids = [known.get(x, int(symbol[ord(x)]) if len(x) == 1 else None) for x in sides]
                if None not in ids:
                    pairs[ids[0] * self.width + ids[1]] = (rank_of[model.scores[made]], made)
        # The last place stands for no pair.
        self.none = len(pairs)
        self.keys = np.array([*sorted(pairs), -1], dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys[:-1].tolist()] + [_NONE], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys[:-1].tolist()] + [-1], dtype=np.int64)
        self.tables = self._tables()
        left, right = (np.array([x[i] for x in sorted(neighbours)], dtype=np.int64) for i in (0, 1))
        self.sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        self.sieve[self._sieve_place(left, right)] = True

    @staticmethod
    def _sieve_place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 0x9E3779B1 + right * 0x85EBCA6B >> 11) & ((1 << _SIEVE_BITS) - 1)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair of symbols in the tables; the last place stands for none."""
        key = left * self.width + right
        at = self.tables[0][self._slot(key, 0)]
        # An empty slot ends the search; a slot with another pair leads to the next table.
        open_ = np.flatnonzero((self.keys[at] != key) & (at != self.none))
        for i, table in enumerate(self.tables[1:], 1):
            at[open_] = table[self._slot(key[open_], i)]
            open_ = open_[(self.keys[at[open_]] != key[open_]) & (at[open_] != self.none)]
        at[open_] = self.none
        return at

    @staticmethod
    def _slot(key: np.ndarray, table: int) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x5851F42D4C957F2C * table & (1 << 64) - 1) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    def _tables(self) -> list[np.ndarray]:
        """Places of the pairs by hash; a pair whose slot is taken goes to the next table."""
        rest, tables = np.arange(self.none), []
        while len(rest) or not tables:
            slot = self._slot(self.keys[rest], len(tables))
            table = np.full(1 << _SLOT_BITS, self.none)
            table[slot] = rest
            tables.append(table)
            rest = rest[table[slot] != rest]
        return tables

    # --- encoding ----------------------------------------------------------

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts of a chunk, one after the other, and where each text begins."""
        points, offsets = code_points(chunk)
        points = np.where(points == 0x20, MARK, points).astype(np.int32)
        filled = np.flatnonzero(np.diff(offsets))
        points = np.insert(points, offsets[filled], MARK)
        offsets = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        heads = offsets[:-1][filled]
        parts, begins = [np.zeros(0, dtype=np.int64)], np.zeros(len(offsets), dtype=np.int64)
        lo = total = 0
        while lo < len(points):
            start, hi = self._segments(points, heads, lo)
            ids, ends = self._sliced(points, start, hi)
            here = slice(np.searchsorted(offsets, lo), np.searchsorted(offsets, hi))
            begins[here] = total + ends[np.searchsorted(start, offsets[here])]
            parts.append(ids)
            total, lo = total + len(ids), hi
        begins[np.searchsorted(offsets, lo) :] = total
        return np.concatenate(parts), begins

    def _segments(self, points: np.ndarray, heads: np.ndarray, lo: int) -> tuple[np.ndarray, int]:
        """Starts of the segments from ``lo`` on, and the end of the last, after about ``SLICE`` symbols."""
        size = SLICE
        while True:
            hi = min(lo + size, len(points))
            left, right = points[lo : hi - 1].astype(np.int64), points[lo + 1 : hi].astype(np.int64)
            first = np.ones(hi - lo, dtype=bool)
            first[1:] = ~self.sieve[self._sieve_place(left, right)]
            first[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo] = True
            start = np.flatnonzero(first) + lo
            if hi == len(points):
                return start, hi
            if len(start) > 1:
                # The last one may go on behind the slice.
                return start[:-1], int(start[-1])
            size *= 2

    def _sliced(self, points: np.ndarray, start: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the segments up to ``end``, and where each segment's begin."""
        size = np.diff(start, append=end)
        which, chosen = _distinct(points[start[0] : end], start - start[0], size)
        ids, at = self._merged(self.symbol[points[_ranges(start[chosen], size[chosen])]], size[chosen])
        count = np.diff(at)[which]
        return ids[_ranges(at[which], count)], np.append(0, np.cumsum(count))

    def _merged(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of segments of symbols, and where each segment begins."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        segment = np.repeat(np.arange(len(size)), size)
        long = size > LONG
        if long.any():
            begin = np.cumsum(size) - size
            for i in np.flatnonzero(long).tolist():
                merged = self._by_heap(symbols[begin[i] : begin[i] + size[i]].tolist())
                parts.append((np.full(len(merged), i), np.array(merged, dtype=np.int64)))
            short = ~long[segment]
            symbols, segment = symbols[short], segment[short]
        place = np.full(len(symbols), self.none)
        if len(symbols):
            inner = np.flatnonzero(segment[1:] == segment[:-1])
            place[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        while len(symbols):
            head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            rank = self.ranks[place]
            best = np.minimum.reduceat(rank, head)
            length = np.diff(head, append=len(symbols))
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, length)
                parts.append((segment[gone], symbols[gone]))
                symbols, segment, place, rank = symbols[~gone], segment[~gone], place[~gone], rank[~gone]
                best, length = best[~over], length[~over]
                if not len(symbols):
                    break
            wanted = np.repeat(best, length)
            at = self._leftmost(symbols, segment, place, np.flatnonzero(rank == wanted), wanted)
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            # Only the merged symbols and those before them have new neighbours.
            fresh = np.zeros(len(symbols), dtype=bool)
            fresh[at] = True
            symbols, segment, place, fresh = symbols[keep], segment[keep], place[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]
            fresh = np.flatnonzero(fresh)
            place[fresh] = self.none
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[segment[fresh] == segment[fresh + 1]]
            place[fresh] = self.pairs(symbols[fresh], symbols[fresh + 1])
        owner, merged = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        return self._as_ids(owner[order], merged[order], len(size))

    def _leftmost(self, symbols: np.ndarray, segment: np.ndarray, place: np.ndarray, hit: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of the pairs at ``hit``, those that the library merges before any other pair."""
        # Of overlapping pairs every second one, from the left.
        run = np.ones(len(hit), dtype=bool)
        run[1:] = hit[1:] != hit[:-1] + 1
        begin = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
        hit = hit[(hit - begin) % 2 == 0]
        made = self.made[place[hit]]
        n = len(symbols)
        touches = np.zeros(len(hit), dtype=bool)
        touches[1:] = hit[1:] == hit[:-1] + 2
        before = symbols[np.maximum(hit - 1, 0)]
        before[1:][touches[1:]] = made[:-1][touches[1:]]
        left = (hit > 0) & (segment[np.maximum(hit - 1, 0)] == segment[hit])
        right = (hit + 2 < n) & (segment[np.minimum(hit + 2, n - 1)] == segment[hit])
        better = np.zeros(len(hit), dtype=bool)
        better[left] = self.ranks[self.pairs(before[left], made[left])] <= wanted[hit[left]]
        better[right] |= self.ranks[self.pairs(made[right], symbols[hit[right] + 2])] <= wanted[hit[right]]
        if not better.any():
            return hit
        ahead = np.cumsum(better) - better
        own = segment[hit]
        begin = np.append(True, own[1:] != own[:-1])
        return hit[ahead == ahead[np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))]]

    @cached_property
    def _by_key(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made.tolist(), strict=False)}

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """Merge one segment pair by pair: best score first, then leftmost."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._by_key
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n:
                key = symbols[at] * self.width + symbols[after[at]]
                if key in table:
                    heapq.heappush(heap, (table[key][0], at, key))

        for at in range(n):
            offer(at)
        while heap:
            _, at, key = heapq.heappop(heap)
            # A pair that has changed meanwhile is passed over.
            if symbols[at] < 0 or after[at] >= n or symbols[at] * self.width + symbols[after[at]] != key:
                continue
            gone = after[at]
            symbols[at], symbols[gone] = table[key][1], -1
            after[at] = after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            offer(before[at])
            offer(at)
        return [x for x in symbols if x >= 0]

    def _as_ids(self, owner: np.ndarray, symbols: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of merged symbols: characters that are no piece become their bytes."""
        foreign = np.flatnonzero(symbols >= self.count)
        if len(foreign):
            points = symbols[foreign] - self.count
            data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8"), dtype=np.uint8)
            size = np.ones(len(symbols), dtype=np.int64)
            size[foreign] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            symbols, owner = np.repeat(symbols, size), np.repeat(owner, size)
            symbols[symbols >= self.count] = np.array(self.model.bytes_)[data]
        return symbols, np.searchsorted(owner, np.arange(segments + 1))

    # --- decoding ----------------------------------------------------------

    @cached_property
    def _shown(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, one after the other, and where each piece begins."""
        model = self.model
        shown = [p.replace(chr(MARK), " ").encode() for p in model.pieces]
        for byte, i in enumerate(model.bytes_):
            shown[i] = bytes([byte])
        for i in model.hidden:
            shown[i] = b""
        shown[model.unknown] = " ⁇ ".encode()
        size = np.array([len(x) for x in shown])
        return np.frombuffer(b"".join(shown), dtype=np.uint8), np.append(0, np.cumsum(size))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each piece."""
        return np.diff(self._shown[1])[ids]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all pieces, with the mark before each text."""
        data, at = self._shown
        return data[_ranges(at[ids], np.diff(at)[ids])]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of lists of ids, which begin at ``first``."""
        bounds = np.append(0, np.cumsum(self.sizes(ids)))
        ends = bounds[first].tolist()
        data = self.raw(ids).tobytes()
        visible = np.isin(ids, self.model.hidden, invert=True)
        marked = np.array([p.startswith(chr(MARK)) for p in self.model.pieces])
        seen = np.append(0, np.cumsum(visible))
        # The first visible piece of a text, if it has one.
        lead = np.searchsorted(seen, seen[first[:-1]], side="right") - 1
        strip = (lead < first[1:]) & marked[ids[np.minimum(lead, len(ids) - 1)]] if len(ids) else np.zeros(len(first) - 1, dtype=bool)
        inner: dict[int, list[int]] = {}
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for at in np.flatnonzero(~visible).tolist():
            if lead[row[at]] < at < first[row[at] + 1] - 1:
                inner.setdefault(int(row[at]), []).append(int(bounds[at]))
        texts = []
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            # Bytes on both sides of a hidden piece make no character together.
            cuts = [lo + int(strip[i]), *inner.get(i, ()), hi]
            texts.append("".join(_characters(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
        return texts


def _characters(data: bytes) -> str:
    """Decode, with one replacement character for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _distinct(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every segment its place among the different ones, and the first segment of each."""
    name = range_hash(prefix_sums(points.astype(np.uint64)), start, start + size)
    _, chosen, which = np.unique(name, return_index=True, return_inverse=True)
    # Hashes only propose; a segment that differs from its like is kept apart.
    same = size == size[chosen[which]]
    compare = np.flatnonzero(same)
    flat = points[_ranges(start[compare], size[compare])] != points[_ranges(start[chosen[which[compare]]], size[compare])]
    same[compare[np.repeat(np.arange(len(compare)), size[compare])[flat]]] = False
    other = np.flatnonzero(~same)
    which[other] = len(chosen) + np.arange(len(other))
    return which, np.append(chosen, other)


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """The tables of a model, made once per worker."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(PieceModel.load(model))
    return _encoders[key]


def encode(docs: DataFrame, model: bytes, end: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id and ids, the pieces of the whole text, closed by the end id if ``end``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for chunk in chunks(batch.column("text"), ENCODE_BYTES, rows=ENCODE_ROWS):
                ids, first = encoder.encode(chunk)
                if end:
                    ids = np.insert(ids, first[1:], encoder.model.end)
                    first = first + np.arange(len(first))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.rows), lists], ["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``rows`` (doc_id, ids): doc_id, ids and text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            first = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + DECODE_IDS, side="right")) - 1)
                hi = min(hi, lo + ENCODE_ROWS)
                texts = encoder.decode(ids[first[lo] : first[hi]].astype(np.int64), first[lo : hi + 1] - first[lo])
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                lo = hi

    schema = T.StructType([*rows.select("doc_id", "ids").schema, T.StructField("text", T.StringType())])
    return rows.select("doc_id", "ids").mapInArrow(run, schema)
