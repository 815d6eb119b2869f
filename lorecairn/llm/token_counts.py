"""Token counts: greedy longest-match word pieces by an automaton that is linear in the text.

The vocabulary is a trie of bytes.  Each trie node knows how many pieces are
popped when no child fits, and the node that stands for what is left
(its failure link), so a word is scanned once, without going back and without
building a piece.

A word is a run of non-white-space; it is matched as ``mark + word``, so that
pieces that begin with the mark only fit the start of a word.  A word that the
vocabulary can't cover counts as ``unknown`` pieces (1, as word-piece models
do).  Null and empty texts have no words and no tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words up to this many bytes are remembered, so many of them at once.
CACHED_BYTES, CACHED_WORDS = 64, 400_000
MARK = b" "


class PieceAutomaton:
    """Trie with failure links and counts of popped pieces."""

    def __init__(self, pieces: Iterable[bytes], mark: bytes = MARK, unknown: int = 1) -> None:
        self.mark, self.unknown = mark, unknown
        self.child: list[dict[int, int]] = [{}]
        terminal = {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                below = self.child[node].get(byte)
                if below is None:
                    below = self.child[node][byte] = len(self.child)
                    self.child.append({})
                node = below
            terminal[node] = node != 0
        # Nearest first: a failure link leads to a node nearer to the root.
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for byte, below in self.child[node].items():
                    deeper.append(below)
                    if terminal.get(below):
                        self.link[below], self.popped[below] = 0, 1
                        continue
                    at, count = self.link[node], self.popped[node]
                    while at >= 0 and byte not in self.child[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[below], self.popped[below] = self.child[at][byte], count
            level = deeper

    def count(self, word: bytes) -> int:
        """Number of pieces of one word."""
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for byte in self.mark + word:
            while (below := child[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return self.unknown
            node = below
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return self.unknown
        return total


class _Counts(dict):
    """Pieces of the words met so far; bounded, and emptied when full."""

    def __init__(self, automaton: PieceAutomaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = count
        return count


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level tokenizer file stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file, whose tokens write each byte as one printable character."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model.get("added_tokens", ())}
    byte = byte_of_character()
    return [bytes(byte[c] for c in token) for token in model["model"]["vocab"] if token not in special]


def token_counts(docs: DataFrame, pieces: Iterable[bytes], mark: bytes = MARK, unknown: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_tokens.  The vocabulary is broadcast; its size is that of its file."""
    shared = docs.sparkSession.sparkContext.broadcast((list(pieces), mark, unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(PieceAutomaton(*shared.value))
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            n_tokens = np.zeros(batch.num_rows, dtype=np.int64)
            for row, text in enumerate(batch.column("text")):
                if text.is_valid:
                    found = text.as_buffer().to_pybytes().split()
                    n_words[row] = len(found)
                    n_tokens[row] = sum(map(known.__getitem__, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"]
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
