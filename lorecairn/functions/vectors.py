"""Embedding UDFs and vector expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------
DIMENSION = 384
MODEL_NAME = "all-MiniLM-L6-v2"
# ---------------------------------------------------------------------------

#: Characters and texts counted at a time, which bounds the memory of a batch.
CHARS, TEXTS = 1 << 18, 512

#: Turns a list of texts into one unit-length vector per text.
Encoder = Callable[[list[str]], np.ndarray]


def character_vector(text: str | None, dimension: int = DIMENSION) -> np.ndarray:
    """Unit vector of position-weighted character codes; zeros for an empty text.

    The character at 0-based position i adds 1/(i+1) to the cell of its code
    point modulo the dimension.
    """
    if not text:
        return np.zeros(dimension, dtype=np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    weights = 1.0 / np.arange(1, len(codes) + 1)
    cells = np.bincount(codes % dimension, weights=weights, minlength=dimension)
    return (cells / np.linalg.norm(cells)).astype(np.float32)


def _runs(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``CHARS`` characters and ``TEXTS`` rows together; a longer text is a run of its own."""
    ends = np.cumsum(length)
    start = 0
    while start < len(length):
        within = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS, side="right"))
        stop = min(max(within, start + 1), start + TEXTS)
        yield start, stop
        start = stop


def _count_cells(texts: list[str], dimension: int) -> np.ndarray:
    """Weighted counts per text, added up in the order of the characters, however long the texts are."""
    ends = np.cumsum([len(t) for t in texts])
    joined = "".join(texts)
    carried = np.zeros(len(texts) * dimension)
    for at in range(0, len(joined), CHARS):
        codes = np.frombuffer(joined[at : at + CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        place = np.arange(at, at + len(codes))
        row = np.searchsorted(ends, place, side="right")
        place -= np.where(row > 0, ends[row - 1], 0)
        cells, weights = row * dimension + codes % dimension, 1.0 / (place + 1)
        if at:
            # What is counted so far comes first, so that the sums are those of one pass.
            cells, weights = np.concatenate([np.arange(len(carried)), cells]), np.concatenate([carried, weights])
        carried = np.bincount(cells, weights=weights, minlength=len(carried))
    return carried.reshape(len(texts), dimension)


def character_vectors(texts: pd.Series, dimension: int = DIMENSION) -> list[np.ndarray]:
    """:func:`character_vector` of a batch of texts; the arrays beside the texts have a fixed size."""
    plain = texts.fillna("").tolist()
    vectors: list[np.ndarray] = []
    for start, stop in _runs(np.array([len(t) for t in plain], dtype=np.int64)):
        cells = _count_cells(plain[start:stop], dimension)
        size = np.sqrt((cells**2).sum(axis=1, keepdims=True))
        vectors.extend(np.divide(cells, size, out=np.zeros_like(cells), where=size > 0).astype(np.float32))
    return vectors


def hash_embedding(text: Column | str, dimension: int = DIMENSION) -> Column:
    """Deterministic embedding of a text column, one Arrow pass and no shuffle.

    The function is declared nondeterministic only to keep filters on its
    result from running it a second time; filter rows before embedding them.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(character_vectors(texts, dimension), index=texts.index, dtype=object)

    return embed.asNondeterministic()(text)


def sentence_encoder(name: str = MODEL_NAME) -> Encoder | None:
    """The sentence model when its library and weights are installed, otherwise ``None``."""
    try:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
    except Exception:
        return None
    return lambda texts: model.encode(texts, normalize_embeddings=True)


def model_embedding(
    text: Column | str,
    load: Callable[[], Encoder | None] = sentence_encoder,
    dimension: int = DIMENSION,
) -> Column:
    """Embedding by a model that is loaded once per task, batch by batch.

    Without a model, or when it fails on a batch, the deterministic embedding
    is used.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            vectors = None
            if encoder is not None:
                try:
                    vectors = list(np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32))
                except Exception:
                    vectors = None
            if vectors is None:
                vectors = [character_vector(t, dimension) for t in texts]
            yield pd.Series(vectors, index=texts.index)

    return embed.asNondeterministic()(text)


def _doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 when a vector has no length, null when dimensions differ."""
    lengths = norm(a) * norm(b)
    cosine = F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)
    return F.when(F.size(a) == F.size(b), cosine)


def euclidean_distance(a: Column, b: Column) -> Column:
    """L2 distance; null when dimensions differ."""
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))
