"""Text of an Arrow batch as NumPy arrays: words, code points and their hashes.

Everything works on a chunk of documents at a time, so the memory of a task is
bounded by the chunk and by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Short and empty texts have few bytes, but what is computed for each row has its size too.
CHUNK_ROWS = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        # A task's function may carry this object along; the powers are cheaper made than sent.
        return (_Powers, ())

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 21)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_powers = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of symbol values; see :func:`range_hash`."""
    up, _ = _powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [start, end), independent of where they stand."""
    _, down = _powers.to(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and where each document begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, lower: bool = False, rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``limit`` bytes and at most ``rows`` rows; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none of which crosses a document's border."""
    n = len(inside)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    here = np.zeros(n + 1, dtype=bool)
    here[:n] = inside
    return np.flatnonzero(here & (first | ~before)), np.flatnonzero(before & (first | ~here))


@dataclass
class Words:
    """Words of a chunk: byte (or code point) ranges, hash, and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """Row of each word within the chunk."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, lower_ascii: bool = False) -> Words:
    """Words between ASCII white space, as the contract of the queries defines them."""
    data = chunk.data
    if lower_ascii:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end = _runs(~_SPACES[data], chunk.offsets)
    return Words(start, end, range_hash(prefix_sums(data), start, end), np.searchsorted(start, chunk.offsets))


def ngram_hash(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes: one value per start position."""
    count = max(0, len(hashes) - n + 1)
    total = np.full(count, np.uint64(salt) * np.uint64(0xA0761D6478BD642F) + np.uint64(n), dtype=np.uint64)
    if count:
        sums = prefix_sums(hashes)
        at = np.arange(count)
        _, down = _powers.to(len(sums))
        total += (sums[n:] - sums[:count]) * down[at]
    return mix(total)


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and where each document begins among them."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    heads = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=heads[1:])
    return points, np.minimum(heads[chunk.offsets], len(points))


def letter_runs(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    return _runs(letters()[points], offsets)
