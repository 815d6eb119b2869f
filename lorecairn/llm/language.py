"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
trigram is the product of its letters' vectors, rotated by their places; a
document is the sum of its trigrams' vectors and a language the sum of its
documents'.  The language whose prototype has the largest cosine with the
document wins.

Letters are compared in lower case; all else separates words.  Null texts and
texts without a letter are ``und`` with score 0.  Ties go to the smaller name.
Rows without a language or an id teach nothing; with no language to learn,
every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import Chunk, chunks, code_points, letters

DIMENSION = 1024
UNKNOWN = "und"
#: Documents of about so many bytes are multiplied at once.
BLOCK_BYTES = 1 << 19
_BITS = 21
#: Trigram vectors that a task remembers.
_KEPT = 60_000


def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of a chunk and the row of each; words are padded by one space."""
    points, offsets = code_points(chunk)
    # A separator at each end of a document keeps trigrams within it.
    symbol = np.zeros(len(points) + chunk.rows + 1, dtype=np.int64)
    row = np.repeat(np.arange(chunk.rows, dtype=np.int64), np.diff(offsets))
    at = np.arange(len(points)) + row + 1
    symbol[at] = np.where(letters()[points], points, 0)
    # The middle of a trigram is a letter; what is no letter stands for a space.
    middle = at[symbol[at] != 0]
    codes = (symbol[middle - 1] << (2 * _BITS)) | (symbol[middle] << _BITS) | symbol[middle + 1]
    return codes, row[symbol[at] != 0]


class TrigramVectors:
    """Vectors of trigrams, made from letter vectors when they are first met."""

    def __init__(self, dimension: int, seed: int) -> None:
        self.dimension, self.seed = dimension, seed
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.zeros((1024, dimension), dtype=np.float32)

    def of_letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            draw = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimension, dtype=np.int8)
            self.letter[point] = (2 * draw - 1).astype(np.float32)
        return self.letter[point]

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Row in ``table`` of each distinct code; the table holds as many as are asked for at once."""
        if len(self.place) > _KEPT:
            self.place.clear()
        for code in codes.tolist():
            if code not in self.place:
                at = self.place[code] = len(self.place)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = (self.of_letter((code >> shift) & ((1 << _BITS) - 1)) for shift in (2 * _BITS, _BITS, 0))
                self.table[at] = np.roll(a, 2) * np.roll(b, 1) * c
        return np.fromiter((self.place[code] for code in codes.tolist()), dtype=np.int64, count=len(codes))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the place of each code among them."""
    place, values = pd.factorize(codes)
    return values, place


@dataclass
class Profiles:
    """Unit prototypes, one row per language in the order of ``names``."""

    names: list[str]
    vectors: np.ndarray
    seed: int


def learn(docs: DataFrame, rows: Column, dimension: int = DIMENSION, seed: int = 11) -> Profiles:
    """Bundle the trigram vectors of all documents of each language.

    ``docs`` has text and lang; ``rows`` says which rows to learn from.  A task
    adds up one vector per language and Spark sums them by language and
    component; what reaches the driver is languages x dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = TrigramVectors(dimension, seed)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for chunk in chunks(batch.column("text"), BLOCK_BYTES, lower=True):
                codes, row = trigrams(chunk)
                if not len(codes):
                    continue
                values, place = _distinct(codes)
                found, group = np.unique(names[chunk.lo : chunk.hi].astype(str), return_inverse=True)
                counts = np.bincount(group[row] * len(values) + place, minlength=len(found) * len(values))
                places = vectors.places(values)
                sums = counts.reshape(len(found), len(values)).astype(np.float32) @ vectors.table[places]
                for name, vector in zip(found.tolist(), sums, strict=True):
                    total[name] = total.get(name, 0) + vector.astype(np.float64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))],
                ["lang", "component", "value"],
            )

    sums = (
        docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(run, "lang string, component int, value long")
        .groupBy("lang", "component")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    names = sorted(sums["lang"].unique().tolist())
    vectors = np.zeros((len(names), dimension), dtype=np.float32)
    if names:
        place = {name: i for i, name in enumerate(names)}
        vectors[sums["lang"].map(place).to_numpy(), sums["component"].to_numpy()] = sums["value"].to_numpy()
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Profiles(names, vectors, seed)


def identify(docs: DataFrame, profiles: Profiles, predicted: str = "lang_pred", cosine: str = "score") -> DataFrame:
    """``docs`` with the language and its cosine, in place of columns of the names given for them."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c.lower() not in (predicted, cosine)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vectors = TrigramVectors(known.vectors.shape[1], known.seed)
        names = np.asarray([*known.names, UNKNOWN], dtype=object)
        for batch in batches:
            best = np.full(batch.num_rows, len(known.names), dtype=np.int64)
            score = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column("text"), BLOCK_BYTES, lower=True):
                codes, row = trigrams(chunk)
                if not len(codes) or not known.names:
                    continue
                values, place = _distinct(codes)
                counts = np.bincount(row * len(values) + place, minlength=chunk.rows * len(values))
                counts = counts.reshape(chunk.rows, len(values)).astype(np.float32)
                places = vectors.places(values)
                table = vectors.table[places]
                bundle = counts @ table
                norm = np.linalg.norm(bundle, axis=1)
                alike = (bundle @ known.vectors.T) / np.maximum(norm, 1e-9)[:, None]
                some = counts.any(axis=1)
                at = np.flatnonzero(some) + chunk.lo
                best[at] = alike.argmax(axis=1)[some]
                score[at] = np.clip(alike.max(axis=1)[some], 0.0, 1.0)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[best].tolist(), type=pa.string()), pa.array(score)], [*kept, predicted, cosine]
            )

    schema = T.StructType(
        [*(docs.schema[c] for c in kept), T.StructField(predicted, T.StringType()), T.StructField(cosine, T.DoubleType())]
    )
    return docs.select(*kept).mapInArrow(run, schema)
