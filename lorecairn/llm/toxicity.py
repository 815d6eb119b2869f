"""Toxicity by multiple-instance learning: document labels, sentence scores.

A document is a bag of sentences.  A sentence is toxic with the logistic
probability of the sum of its terms' weights, and a document with
``1 - prod(1 - p)`` over its sentences (noisy-or).  The weights are fitted to
document labels alone, and the sentence probabilities then say where the
offence stands.

Sentences end at ``. ! ?`` or a line end.  Terms are lower-case letter runs and
their openings of 4 to 7 letters, so that inflected forms share a weight; each
counts once per occurrence.  Texts without a known term, empty and null texts
get the score of an empty bag, 0.  With no labelled row of either class every
score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import labelled_sample
from .textarrays import Chunk, chunks, code_points, letter_runs, prefix_sums, range_hash

#: At most about so many labelled documents are fitted on, and so many terms get a weight.
FIT_DOCUMENTS, FIT_TERMS = 20_000, 1 << 14
#: A term needs so many documents of the sample.
MIN_DOCUMENTS = 4
#: ... and must lean to toxic ones so clearly that chance alone lets about this many terms through.
CHANCE_TERMS = 20
OPENINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
_STEPS, _RATE, _SHRINK = 150, 0.08, 2e-5
_ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


@dataclass
class Bag:
    """Terms of a chunk in text order, with the sentence of each and the first sentence of each document."""

    term: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bag(chunk: Chunk) -> Bag:
    points, offsets = code_points(chunk)
    start, end = letter_runs(points, offsets)
    sums = prefix_sums(points)
    stop = np.isin(points, _ENDS)
    # A sentence begins at each document and behind each mark.
    begins = np.union1d(offsets[:-1], np.flatnonzero(stop) + 1)
    begins = begins[begins < len(points)] if len(points) else begins[:0]
    ends = np.append(begins[1:], len(points)) if len(begins) else begins
    sentence = np.searchsorted(begins, start, side="right") - 1
    term, where = [range_hash(sums, start, end)], [sentence]
    for length in OPENINGS:
        long = np.flatnonzero(end - start > length)
        term.append(range_hash(sums, start[long], start[long] + length) ^ np.uint64(length))
        where.append(sentence[long])
    return Bag(np.concatenate(term), np.concatenate(where), np.searchsorted(begins, offsets), begins, ends)


@dataclass
class Weights:
    """Sorted term hashes with their weights, and the bias of a sentence with a known term."""

    term: np.ndarray
    weight: np.ndarray
    bias: float

    def logits(self, found: Bag) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights per sentence, and whether the sentence has a known term."""
        n = len(found.start)
        if not len(self.term) or not len(found.term):
            return np.full(n, -np.inf), np.zeros(n, dtype=bool)
        at = np.minimum(np.searchsorted(self.term, found.term), len(self.term) - 1)
        known = self.term[at] == found.term
        total = np.bincount(found.sentence[known], self.weight[at[known]], minlength=n)
        some = np.bincount(found.sentence[known], minlength=n) > 0
        return np.where(some, total + self.bias, -np.inf), some


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability per document that one of its sentences is toxic."""
    safe = np.concatenate([[0.0], np.cumsum(_softplus(logits))])
    return -np.expm1(-(safe[first[1:]] - safe[first[:-1]]))


def fit(texts: pa.Array, label: np.ndarray) -> Weights:
    """Fit the weights to one sample of whole documents, by full-batch Adam on the noisy-or likelihood."""
    empty = Weights(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)
    if not (label == 1).any() or not (label == 0).any():
        return empty
    docs = len(label)

    def pairs() -> Iterator[tuple[Chunk, Bag, np.ndarray]]:
        for chunk in chunks(texts, lower=True):
            found = bag(chunk)
            owner = np.repeat(np.arange(chunk.rows), np.diff(found.first))
            yield chunk, found, owner[found.sentence] if len(found.sentence) else found.sentence

    # Document counts of terms by class; terms are told apart by their hash.
    counted = []
    for chunk, found, doc in pairs():
        seen = pd.DataFrame({"term": found.term, "doc": doc}).drop_duplicates()
        seen["one"] = label[chunk.lo + seen["doc"].to_numpy()]
        counted.append(seen.groupby("term")["one"].agg(["sum", "count"]))
        if len(counted) == 16:
            counted = [pd.concat(counted).groupby(level=0).sum()]
    count = pd.concat(counted).groupby(level=0).sum()
    count = count[count["count"] >= MIN_DOCUMENTS]
    # Keep what leans most to class 1: the excess over what the share of class 1 lets expect.
    clear = NormalDist().inv_cdf(1 - min(0.5, CHANCE_TERMS / max(1, len(count))))
    share = label.mean()
    excess = (count["sum"] - count["count"] * share) / np.sqrt(count["count"] * share * (1 - share))
    excess = excess[excess > clear].sort_values(ascending=False).head(FIT_TERMS)
    if excess.empty:
        return empty
    term = np.sort(excess.index.to_numpy().astype(np.uint64))
    place, where, owners, base = [], [], [], 0
    for chunk, found, doc in pairs():
        at = np.minimum(np.searchsorted(term, found.term), len(term) - 1)
        known = term[at] == found.term
        sentence, inverse = np.unique(found.sentence[known], return_inverse=True)
        place.append(at[known])
        where.append(inverse + base)
        owner = np.repeat(np.arange(chunk.rows), np.diff(found.first))
        owners.append(owner[sentence] + chunk.lo)
        base += len(sentence)
    place, where, owners = map(np.concatenate, (place, where, owners))
    weight, bias = np.full(len(term), 0.5), -4.0
    m, v = np.zeros(len(term) + 1), np.zeros(len(term) + 1)
    toxic = label == 1
    for step in range(1, _STEPS + 1):
        z = np.bincount(where, weight[place], minlength=base) + bias
        p = np.exp(-_softplus(-z))
        safe = np.bincount(owners, _softplus(z), minlength=docs)
        some = np.maximum(-np.expm1(-safe), 1e-9)
        slope = np.where(toxic[owners], -p * (np.exp(-safe) / some)[owners], p)
        gradient = np.append(np.bincount(place, slope[where], minlength=len(term)), slope.sum()) / docs
        gradient[:-1] += _SHRINK * weight
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Weights(term, weight, float(bias))


def learn(docs: DataFrame, labels: DataFrame, rows: Column) -> Weights:
    """Fit on about ``FIT_DOCUMENTS`` labelled rows; one task holds that bounded sample, the driver only weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        table = table.sort_by("doc_id")
        model = fit(table.column("text"), table.column("label").to_numpy())
        term = np.append(model.term, np.uint64(0)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term), pa.array(np.append(model.weight, model.bias)), pa.array(np.arange(len(term)) == len(model.term))],
            ["term", "weight", "is_bias"],
        )

    sample = labelled_sample(docs, labels, "toxic", rows, FIT_DOCUMENTS)
    got = sample.repartition(1).mapInArrow(run, "term long, weight double, is_bias boolean").toPandas()
    bias = got["is_bias"].to_numpy(dtype=bool)
    terms = got["term"].to_numpy(dtype=np.int64)[~bias].astype(np.uint64)
    order = np.argsort(terms)
    return Weights(terms[order], got["weight"].to_numpy()[~bias][order], float(got["weight"][bias].sum()))


def score(docs: DataFrame, weights: Weights, column: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c.lower() != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column("text"), lower=True):
                found = bag(chunk)
                out[chunk.lo : chunk.hi] = noisy_or(shared.value.logits(found)[0], found.first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, column])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.DoubleType())])
    return docs.select(*kept).mapInArrow(run, schema)


def offending_sentences(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence (from 0), text and probability of every sentence at or above ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, plain = batch.column("doc_id"), batch.column("text")
            rows, number, texts, values = [], [], [], []
            for chunk in chunks(plain, lower=True):
                found = bag(chunk)
                points, offsets = code_points(chunk)
                p = np.exp(-_softplus(-shared.value.logits(found)[0]))
                owner = np.repeat(np.arange(chunk.rows), np.diff(found.first))
                for at in np.flatnonzero(p >= threshold).tolist():
                    rows.append(chunk.lo + int(owner[at]))
                    number.append(at - int(found.first[owner[at]]))
                    end = min(int(found.end[at]), int(offsets[owner[at] + 1]))
                    texts.append(points[found.start[at] : end].tobytes().decode("utf-32-le").strip())
                    values.append(float(p[at]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, type=pa.int64())), pa.array(number, type=pa.int64()), pa.array(texts, type=pa.string()), pa.array(values, type=pa.float64())],
                ["doc_id", "sentence", "sentence_text", "probability"],
            )

    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("sentence", T.LongType()), T.StructField("sentence_text", T.StringType()), T.StructField("probability", T.DoubleType())]
    )
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
