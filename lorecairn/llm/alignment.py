"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

*Tokens.*  A is a byte-level tokenizer, run over a space and the text; B is a piece model
(:mod:`pieces`), which sets that space itself.  Each token is a run of bytes, so the
tokens of a chunk of texts are two sorted arrays of ends over the same bytes.

*Merge path.*  Merging both arrays is a path through a grid; diagonals at equal
distances cut it into pieces of equal work.  A binary search finds where the path
crosses each diagonal, for all of them at once.  A piece emits the ends that both
sides have in it; where a diagonal parts two equal ends, the pieces beside it are stitched there.
Groups lie between successive common ends, and texts end at common ends, so neither a long
group nor a long text belongs to one piece.

*Links.*  The A and the B token that end together are linked.  Of two such tokens one's
bytes end with the other's, so each token has at most as many partners as bytes: the number
of different links is at most the bytes of both vocabularies, whatever the corpus.
That bounds the table of counts, which each task adds up before it is shuffled and
which is then broadcast.

The aligned table is written once, so texts are tokenised once; its lists travel as packed bytes,
which the JVM passes on without looking at each number.

Texts that are null, empty or not given back by both tokenizers (those with U+2581) have no
tokens.  Repeated rows count each time.  Texts go through A in parts that begin with a space between two visible
ASCII characters, where it cuts anyhow.  Equal parts of a chunk are tokenised once: short ones of ASCII and Latin letters
side by side through a faster library with the same merges, all others through the library of the file.  Memory is bounded by the longest
text, some two hundred bytes per byte of it where there is no such place.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import Encoder, _distinct, _ranges, encoder_of
from .textarrays import Chunk, chunks
from .token_counts import byte_of_character

#: Ends of both sides in one piece of the merge path.
PIECE = 1 << 14
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 4096
#: Parts of texts up to this size are left to the faster library, which is slow for very long words.
QUICK_BYTES = 512
# Fixed value: the pattern by which byte-level tokenizers cut text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
#: Bytes of ASCII and of U+00C0 to U+027F, which all libraries sort alike into letters, digits and the rest.
_QUICK = np.zeros(256, dtype=bool)
_QUICK[[*range(0xC0), *range(0xC3, 0xCA)]] = True
#: Tokens whose groups are written as text at once, the longest list apart.
DESCRIBE_TOKENS = 1 << 18
_LISTS = ("a", "b", "a_sizes", "b_sizes")


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` are among the first d ends of both, for each diagonal d; ``a`` goes first among equals."""
    lo, hi = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) // 2
        below = a[middle] <= b[diagonals[open_] - 1 - middle]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]
    return lo


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` there are up to and with each end that both have; both ascend."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    split_a = crossings(a, b, diagonals)
    split_b = diagonals - split_a
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, i_end, j, j_end in zip(split_a[:-1].tolist(), split_a[1:].tolist(), split_b[:-1].tolist(), split_b[1:].tolist(), strict=True):
        if i > 0 and j < len(b) and a[i - 1] == b[j]:
            # The diagonal has parted two equal ends.
            found.append((np.array([i]), np.array([j + 1])))
        own, other = a[i:i_end], b[j:j_end]
        at = np.searchsorted(other, own)
        inside = np.flatnonzero(at < len(other))
        same = inside[other[at[inside]] == own[inside]]
        found.append((same + (i + 1), at[same] + (j + 1)))
    return tuple(np.concatenate([f[side] for f in found]) if found else np.zeros(0, dtype=np.int64) for side in (0, 1))


class ByteTokenizer:
    """A byte-level tokenizer file: its library, and the bytes of its tokens."""

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        # Strings of special tokens in a text are plain text.
        self.library.encode_special_tokens = True
        byte = byte_of_character()
        described = json.loads(file)
        tokens = {i: bytes(byte[c] for c in token) for token, i in described["model"]["vocab"].items() if set(token) <= byte.keys()}
        self.quick = self._quick(described, tokens)
        tokens |= {x["id"]: x["content"].encode() for x in described.get("added_tokens", ()) if x["id"] not in tokens}
        shown = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(x) for x in shown])
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)

    def raw(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.at[ids], self.size[ids])]

    def _quick(self, described: dict, tokens: dict[int, bytes]):
        """A faster library for ASCII, if the file has its pattern and each merge makes the next id."""
        import tiktoken

        pretokenizer, merges = described.get("pre_tokenizer") or {}, described["model"]["merges"]
        plain = pretokenizer.get("type") == "ByteLevel" and pretokenizer.get("use_regex", True) and not described.get("normalizer")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        vocabulary = described["model"]["vocab"]
        if not plain or any(vocabulary["".join(pair)] != 256 + i for i, pair in enumerate(pairs)):
            return None
        ranks = {tokens[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of bytes, one after the other, and where each text begins."""
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
        start = segments(data, offsets)
        size = np.diff(start, append=len(data))
        which, chosen = _distinct(data, start, size)
        ids, begin, count = self._parts(data, start[chosen], size[chosen])
        count = count[which]
        upto = np.append(0, np.cumsum(count))
        return ids[_ranges(begin[which], count)], upto[np.searchsorted(start, offsets)]

    def _parts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts, and where those of each part begin and how many they are."""
        flat = data[_ranges(start, size)]
        head = np.cumsum(size) - size
        quick = np.logical_and.reduceat(_QUICK[flat], head) & (size > 1) & (size <= QUICK_BYTES) & (self.quick is not None)
        # Such parts may stand side by side: each is cut off again where its space begins.
        quick &= (flat[head] == 0x20) & _VISIBLE[flat[np.minimum(head + 1, len(flat) - 1)]] & _VISIBLE[flat[head + size - 1]]
        begin, count = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        found, total = [np.zeros(0, dtype=np.int64)], 0
        if quick.any():
            text = data[_ranges(start[quick], size[quick])].tobytes().decode()
            ids = self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size[quick])) + 1
            count[quick] = np.diff(ends, prepend=0)
            begin[quick] = ends - count[quick]
            found.append(ids)
            total = len(ids)
        slow = np.flatnonzero(~quick)
        texts = [data[lo:hi].tobytes().decode() for lo, hi in zip(start[slow].tolist(), (start[slow] + size[slow]).tolist(), strict=True)]
        lists = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        count[slow] = [len(x) for x in lists]
        begin[slow] = total + np.cumsum(count[slow]) - count[slow]
        found += [np.array(x, dtype=np.int64) for x in lists]
        return np.concatenate(found), begin, count


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin that a byte-level tokenizer handles apart.

    A space between two visible ASCII characters begins a new part: the patterns of such
    tokenizers join a space to what follows, and nothing looks across it.
    """
    visible = _VISIBLE[data]
    first = np.zeros(len(data), dtype=bool)
    first[1:-1] = (data[1:-1] == 0x20) & visible[:-2] & visible[2:]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


_tokenizers: dict[int, ByteTokenizer] = {}


def tokenizer_of(file: bytes) -> ByteTokenizer:
    """A tokenizer and its tables, made once per worker."""
    key = hash(file)
    if key not in _tokenizers:
        _tokenizers[key] = ByteTokenizer(file)
    return _tokenizers[key]


def _per_row(equal: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether all values of each range are true."""
    wrong = np.append(0, np.cumsum(~equal))
    return wrong[begins[1:]] == wrong[begins[:-1]]


def _kept(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.where(good, np.diff(first), 0)
    return ids[np.repeat(good, np.diff(first))], np.append(0, np.cumsum(count))


def align_chunk(chunk: Chunk, one: ByteTokenizer, two: Encoder) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """(ids, begin of each row) of A and B, and (tokens of each group, begin of each row) of A and B."""
    filled = np.diff(chunk.offsets) > 0
    data = np.insert(chunk.data, chunk.offsets[:-1][filled], 32)
    offsets = chunk.offsets + np.append(0, np.cumsum(filled))
    sides = [one.encode(data, offsets), two.encode(chunk)]
    raws = [(one.raw(sides[0][0]), one.size[sides[0][0]]), (two.raw(sides[1][0]), two.sizes(sides[1][0]))]
    good = filled.copy()
    for (_, first), (raw, size) in zip(sides, raws, strict=True):
        begins = np.append(0, np.cumsum(size))[first]
        same = np.diff(begins) == np.diff(offsets)
        good &= same
        shown = raw[np.repeat(same, np.diff(begins))]
        wanted = data[np.repeat(same, np.diff(offsets))]
        length = np.where(same, np.diff(offsets), 0)
        good &= _per_row(shown == wanted, np.append(0, np.cumsum(length)))
    sides = [_kept(ids, first, good) for ids, first in sides]
    ends = [np.cumsum(size[ids]) for (ids, _), size in zip(sides, (one.size, two.sizes(np.arange(two.count))), strict=True)]
    groups = []
    upto = common_ends(*ends)
    for (_, first), cut in zip(sides, upto, strict=True):
        # Texts end at common ends; empty ones have no group.
        groups.append((np.diff(cut, prepend=0), np.searchsorted(cut, first, side="right")))
    return sides, groups


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def _binary(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Bytes of each row; a chunk holds far less than 2 GB."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype("<i4")), pa.py_buffer(data)])


def _marks(first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A bit for each token of a row, set where a group ends."""
    count = np.diff(first)
    begin = np.append(0, np.cumsum(-(-count // 8)))
    ends = np.cumsum(sizes) - 1
    flags = np.zeros(8 * int(begin[-1]), dtype=np.uint8)
    flags[_ranges(8 * begin[:-1], count)[ends]] = 1
    return _binary(np.packbits(flags), begin)


def align(docs: DataFrame, byte_level: bytes, pieces: bytes, packed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, the ids ``a`` and ``b``, and how many of each are in every group: ``a_sizes``, ``b_sizes``.

    ``byte_level`` and ``pieces`` are the contents of the two vocabulary files.  The four are arrays of int.
    With ``packed`` they are binary: four bytes an id, and in place of sizes a bit for each token, set where a group ends.
    What follows takes both.
    """
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tokenizer_of(shared.value[0]), encoder_of(shared.value[1])
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK_BYTES, rows=CHUNK_ROWS):
                sides, groups = align_chunk(chunk, one, two)
                if packed:
                    ids = [_binary(x.astype("<i4"), 4 * first) for x, first in sides]
                    columns = [*ids, *(_marks(first, sizes) for (_, first), (sizes, _) in zip(sides, groups, strict=True))]
                else:
                    columns = [_lists(*x) for x in (*sides, *groups)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.rows), *columns], ["doc_id", *_LISTS])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(x, kind) for x in _LISTS)]))


def _lengths(lists: pa.Array) -> np.ndarray:
    """Numbers in each row, of arrays or packed."""
    if pa.types.is_binary(lists.type):
        return pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array column, or bytes of a binary one, and where those of each row begin."""
    if not pa.types.is_binary(lists.type):
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(_lengths(lists)))
    _, places, data = lists.buffers()
    first = np.frombuffer(places, dtype="<i4", offset=4 * lists.offset, count=len(lists) + 1).astype(np.int64)
    size = int(first[-1] - first[0])
    return np.frombuffer(data, dtype=np.uint8, offset=int(first[0]), count=size) if size else np.zeros(0, dtype=np.uint8), first - first[0]


def _side(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of one side and the first of each row, tokens of each group and the first group of each row."""
    (ids, first), (groups, group_first) = (_flat(batch.column(x)) for x in (name, f"{name}_sizes"))
    if not pa.types.is_binary(batch.column(name).type):
        return ids, first, groups, group_first
    first = first // 4
    ends = np.flatnonzero(np.unpackbits(groups)[_ranges(8 * group_first[:-1], np.diff(first))])
    return ids.view("<i4").astype(np.int64), first, np.diff(ends, prepend=-1), np.searchsorted(ends, first)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``DESCRIBE_TOKENS`` tokens at a time."""
    upto = np.append(0, np.cumsum(sum(_lengths(batch.column(x)) for x in ("a", "b"))))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + DESCRIBE_TOKENS, side="right")) - 1)
        hi = min(hi, batch.num_rows, lo + CHUNK_ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _link_names(batch: pa.RecordBatch) -> np.ndarray:
    """A id and B id of the link at the end of every group, in one number."""
    (a, _, a_sizes, _), (b, _, b_sizes, _) = (_side(batch, x) for x in "ab")
    return (a[np.cumsum(a_sizes) - 1] << 32) | b[np.cumsum(b_sizes) - 1]


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, links: how many links of the corpus are between these two ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch):
                fresh, number = np.unique(_link_names(part), return_counts=True)
                both, at = np.unique(np.concatenate([names, fresh]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, number]), minlength=len(both)).astype(np.int64)
                names = both
        for lo in range(0, len(names), 1 << 16):
            here = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array((names[here] >> 32).astype(np.int32)), pa.array((names[here] & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[here])],
                ["a", "b", "links"],
            )

    counted = aligned.drop("doc_id").mapInArrow(run, "a int, b int, links long")
    return counted.groupBy("a", "b").agg(F.sum("links").alias("links"))


@cache
def _decimals(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``count``, each with room for a separator: bytes, begin and size."""
    shown = [b"%d," % i for i in range(count)]
    size = np.array([len(x) for x in shown])
    return np.frombuffer(b"".join(shown), dtype=np.uint8), np.cumsum(size) - size, size


def _group_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Groups of every row as ``a1,a2|b1;a3|b2``: bytes with a separator behind each row, and where rows begin."""
    (a, a_first, a_sizes, _), (b, b_first, b_sizes, _) = (_side(batch, x) for x in "ab")
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    # A token stands behind all earlier ones of its side, and behind those of the other side that come first.
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[np.arange(len(a)) + np.repeat(b_end - b_sizes, a_sizes)] = a
    ids[np.arange(len(b)) + np.repeat(a_end, b_sizes)] = b
    digits, begin, size = _decimals(1 << max(16, int(ids.max(initial=0)).bit_length()))
    shown = digits[_ranges(begin[ids], size[ids])]
    upto = np.append(0, np.cumsum(size[ids]))
    shown[upto[a_end + b_end - b_sizes] - 1] = ord("|")
    shown[upto[a_end + b_end] - 1] = ord(";")
    return shown, upto[a_first + b_first]


def describe(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``counts`` are those of :func:`link_counts`, of this table or another that holds its links.
    """
    # At most as many rows as both vocabularies have bytes.
    known = counts.toPandas()
    name = (known["a"].to_numpy(dtype=np.int64) << 32) | known["b"].to_numpy(dtype=np.int64)
    order = np.argsort(name)
    links = known["links"].to_numpy(dtype=np.int64)
    best = known.groupby("b")["links"].transform("max").to_numpy(dtype=np.int64) == links
    shared = aligned.sparkSession.sparkContext.broadcast((name[order], links[order], best[order]))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, links, best = shared.value
        for batch in batches:
            for part in _slices(batch):
                at = np.searchsorted(names, _link_names(part))
                first = _side(part, "a")[3]
                groups = np.diff(first)
                sums = [np.diff(np.append(0, np.cumsum(x[at]))[first]) for x in (best.astype(np.int64), links)]
                tokens = [_lengths(part.column(x)) for x in "ab"]
                shown, begins = _group_texts(part)
                data = memoryview(np.ascontiguousarray(shown))
                digests = [
                    hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else ""
                    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
                ]
                values = [pa.array(x.astype(np.int64)) for x in (*tokens, groups, groups, *sums)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *values, pa.array(digests, pa.string())], ["doc_id", *numbers, "groups_sha256"]
                )

    schema = [aligned.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in numbers), T.StructField("groups_sha256", T.StringType())]
    return aligned.mapInArrow(run, T.StructType(schema))
