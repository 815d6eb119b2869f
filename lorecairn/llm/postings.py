"""Postings packed for a shuffle: many (key, document) entries in one row.

A task collects entries, sorts them by bucket and sends one row of byte arrays per
bucket.  The shuffle then moves few rows of plain numbers, and the
receiving task compares keys with NumPy.  A bucket holds its share of all entries:
callers first thin out keys that a block of documents repeats, so a hot key
sends a few entries per block, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries are sent on when so many have gathered.
BLOCK_ENTRIES = 1 << 20
BUCKETS = 1024


def packed_schema(fields: dict[str, np.dtype]) -> str:
    return ", ".join(["bucket int", *(f"{name} binary" for name in fields)])


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per bucket; ``columns`` are arrays of one length."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    heads = np.concatenate([[0], cuts])
    ends = np.append(cuts, len(bucket))
    arrays = [pa.array(bucket[heads].astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = np.append(heads, ends[-1]).astype(np.int64) * values.itemsize
        large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
        arrays.append(large.cast(pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def unpack(batches: Iterator[pa.RecordBatch], fields: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    """All entries of a task, column by column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in fields}
    for batch in batches:
        for name, kind in fields.items():
            column = batch.column(name)
            parts[name] += [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, dtype=kind) for name, kind in fields.items()}


def spread(packed: DataFrame) -> DataFrame:
    """Rows of one bucket in one task."""
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(tasks, "bucket")


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) % BUCKETS


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry of each run of equal keys, and the run of each entry."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
