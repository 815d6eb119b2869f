"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are the distinct byte 2-, 3- and 4-grams of a text, in a table of
hashed cells, and the share of word pairs that are one word twice.  Each is scaled by the log ratio of its smoothed shares in the two
classes, and a hinge-loss model is fitted to the scaled features by dual
coordinate descent.  A logistic curve, fitted to documents that the model has
not seen, turns margins into scores.

Null and empty texts have no features and get the score of a zero margin plus
the bias.  With no labelled row of one class, every score is the share of the
class there is (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .tables import labelled_sample
from .textarrays import Chunk, chunks, words

#: At most about so many labelled documents are fitted on.
FIT_DOCUMENTS = 12_000
CELLS = 1 << 16
GRAMS = (2, 3, 4)
#: Documents whose features are laid out at once.
BLOCK_BYTES = 1 << 17
THRESHOLD = 0.5
#: Shares of word pairs that repeat a word; each has a cell.
REPEATED = (0.0, 0.02, 0.1, 0.3, 0.6)
_C, _EPOCHS = 0.1, 12


def presence(chunk: Chunk) -> np.ndarray:
    """One row of ``CELLS`` flags per document."""
    flags = np.zeros((chunk.rows, CELLS), dtype=bool)
    data = chunk.data.astype(np.uint32)
    row = np.repeat(np.arange(chunk.rows, dtype=np.int64) * CELLS, np.diff(chunk.offsets))
    left = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets)) - np.arange(len(data))
    code = data.copy()
    for n in range(2, max(GRAMS) + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        code = (code[:size] << np.uint32(8)) | data[n - 1 :]
        if n in GRAMS:
            fits = left[:size] >= n
            cell = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(16)
            flags.reshape(-1)[(row[:size] + cell)[fits]] = True
    # Word pairs of one word twice fall together, whatever the word: one cell for each share that they reach.
    found = words(chunk)
    owner = found.doc()
    twice = (found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.bincount(owner[1:][twice], minlength=chunk.rows)
    share = pairs / np.maximum(np.diff(found.first), 1)
    for i, least in enumerate(REPEATED):
        flags[share > least, i] = True
    return flags


@dataclass
class Margin:
    """Weight of every cell, bias, and the logistic curve of the score."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, chunk: Chunk) -> np.ndarray:
        margin = presence(chunk).astype(np.float32) @ self.weight + self.bias
        z = np.clip(self.slope * margin.astype(np.float64) + self.shift, -40, 40)
        return 1.0 / (1.0 + np.exp(-z))


def constant(label: np.ndarray) -> Margin:
    share = float(label.mean()) if len(label) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Margin(np.zeros(CELLS, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def _descend(rows: list[np.ndarray], ratio: np.ndarray, sign: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more feature, always 1."""
    weight, bias = np.zeros(CELLS), 0.0
    alpha = np.zeros(len(rows))
    # The smaller class weighs as much as the larger.
    bound = _C * len(sign) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    norm = np.array([float(np.dot(ratio[r], ratio[r])) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(_EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)).tolist():
            values = ratio[rows[i]]
            slope = sign[i] * (float(weight[rows[i]] @ values) + bias) - 1.0
            moved = min(max(alpha[i] - slope / norm[i], 0.0), bound[i]) - alpha[i]
            if moved:
                alpha[i] += moved
                weight[rows[i]] += moved * sign[i] * values
                bias += moved * sign[i]
                largest = max(largest, abs(moved))
        if largest < 1e-6:
            break
    return weight, bias


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin by Newton steps."""
    share = 1.0 / max(1, len(label))
    slope, shift = 1.0, 0.0
    goal = np.where(label == 1, 0.99, 0.01)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
        d, h = share * (p - goal), share * p * (1 - p) + 1e-9
        a, b, c = (h * margin * margin).sum() + 1e-4, (h * margin).sum(), h.sum() + 1e-4
        g, k = (d * margin).sum() + 1e-4 * (slope - 1.0), d.sum()
        det = a * c - b * b
        step = (c * g - b * k) / det, (a * k - b * g) / det
        slope, shift = max(slope - step[0], 1e-3), shift - step[1]
        if max(map(abs, step)) < 1e-9:
            break
    return float(slope), float(shift)


def fit(texts: pa.Array, label: np.ndarray, seed: int = 5) -> Margin:
    if not (label == 1).any() or not (label == 0).any():
        return constant(label)
    rows: list[np.ndarray] = []
    for chunk in chunks(texts, BLOCK_BYTES):
        rows += [np.flatnonzero(x).astype(np.int32) for x in presence(chunk)]
    # Every fifth document of each class only serves the curve, if there are enough.
    rank = np.where(label == 1, np.cumsum(label == 1), np.cumsum(label == 0))
    tested = rank % 5 == 0
    if len(np.unique(label[tested])) < 2:
        tested = np.zeros(len(label), dtype=bool)
    used = np.flatnonzero(~tested)
    counts = np.ones((2, CELLS))
    for i in used.tolist():
        counts[int(label[i] == 1)][rows[i]] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    weight, bias = _descend([rows[i] for i in used], ratio, np.where(label[used] == 1, 1.0, -1.0), seed)
    scaled = weight * ratio
    at = np.flatnonzero(tested) if tested.any() else used
    margin = np.array([scaled[rows[i]].sum() + bias for i in at])
    return Margin(scaled.astype(np.float32), float(bias), *_curve(margin, label[at]))


def learn(docs: DataFrame, labels: DataFrame, rows: Column) -> Margin:
    """Fit on about ``FIT_DOCUMENTS`` labelled rows in one task; the driver gets one weight per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        table = table.sort_by("doc_id")
        model = fit(table.column("text"), table.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weight.tobytes()]), pa.array([[model.bias, model.slope, model.shift]])], ["weight", "rest"]
        )

    got = (
        labelled_sample(docs, labels, "quality", rows, FIT_DOCUMENTS)
        .repartition(1)
        .mapInArrow(run, "weight binary, rest array<double>")
        .collect()
    )
    if not got:
        return constant(np.zeros(0))
    return Margin(np.frombuffer(bytes(got[0]["weight"]), dtype=np.float32), *got[0]["rest"])


def score(docs: DataFrame, model: Margin, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column("text"), BLOCK_BYTES):
                out[chunk.lo : chunk.hi] = shared.value.score(chunk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, column])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())])
    return docs.select(*kept).mapInArrow(run, schema)
