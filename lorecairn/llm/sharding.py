"""Uniform shuffle into shards of exact sizes by a communication matrix.

How many rows each input partition sends to each cell of the output is drawn
first, from the multivariate hypergeometric law, so that every cell gets exactly
its size.  Then each partition deals its rows in a random order by its row of
the matrix, the rows are exchanged, and each cell puts what it got in a random
order.  Every order of all rows is equally likely, without a global sort.

The matrix is never built: a partition finds its row by walking down a binary
tree over the partitions, splitting the counts at each node with a generator
seeded by the node.  A shard is cut into cells of bounded size, so no task holds a
shard.

Rows are dealt by place, not by content: null ids, equal texts and repeated rows
are rows like any other and cannot make a partition larger.  Null texts are empty.
An empty table gives no rows.  ``docs`` must be read twice with the same
partitions (a stored table or a checkpoint); the second pass checks this and
fails otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_ROWS = 4_096
#: A cell grows beyond that instead of there being more cells than this.
MOST_CELLS = 1 << 15
#: Above so many rows the generator's exact draw ends; sizes stay exact, counts come from the normal limit.
_EXACT = 900_000_000


def _split(rng: np.random.Generator, cells: np.ndarray, taken: int) -> np.ndarray:
    """How many of ``taken`` rows come from each cell, drawn without replacement."""
    if not taken:
        return np.zeros_like(cells)
    if int(cells.sum()) < _EXACT:
        return rng.multivariate_hypergeometric(cells, taken, method="marginals")
    out, left = np.zeros_like(cells), int(cells.sum())
    for i, cell in enumerate(cells.tolist()):
        share = cell / left
        width = np.sqrt(max(0.0, taken * share * (1 - share) * (left - taken) / max(1, left - 1)))
        draw = round(rng.normal(taken * share, width))
        out[i] = min(max(draw, taken - (left - cell), 0), cell, taken)
        taken, left = taken - int(out[i]), left - cell
    return out


def matrix_row(partition: int, before: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row ``partition`` of the matrix; ``before[p]`` is the number of rows in partitions below p."""
    lo, hi, counts = 0, len(before) - 1, cells
    while hi - lo > 1:
        middle = (lo + hi) // 2
        left = _split(np.random.default_rng((seed, lo, hi)), counts, int(before[middle] - before[lo]))
        if partition < middle:
            hi, counts = middle, left
        else:
            lo, counts = middle, counts - left
    return counts


def cell_sizes(rows: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, shard and first slot of every cell; shard sizes differ by one at most."""
    sizes, owner, first = [], [], []
    cell_rows = max(cell_rows, -(-rows // MOST_CELLS))
    for shard in range(shards):
        n = rows // shards + (shard < rows % shards)
        parts = max(1, -(-n // cell_rows))
        own = np.full(parts, n // parts, dtype=np.int64)
        own[: n % parts] += 1
        sizes.append(own)
        owner.append(np.full(parts, shard, dtype=np.int64))
        first.append(np.cumsum(own) - own)
    return np.concatenate(sizes), np.concatenate(owner), np.concatenate(first)


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with shard (int) and slot (long, gapless from 0 in each shard), in place of columns of those names."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = docs.select(*kept)
    # One row per partition reaches the driver.
    found = dict(docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    partitions = max(found, default=-1) + 1
    before = np.zeros(partitions + 1, dtype=np.int64)
    np.cumsum([found.get(p, 0) for p in range(partitions)], out=before[1:])
    shared = spark.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        sizes, owner, first = cell_sizes(int(before[-1]), shards, cell_rows)
        p = TaskContext.get().partitionId()
        rows = int(before[p + 1] - before[p]) if p < len(before) - 1 else 0
        rng = np.random.default_rng((seed, 1, p))
        order = rng.permutation(np.repeat(np.arange(len(sizes)), matrix_row(p, before, sizes, seed))) if rows else np.zeros(0, dtype=np.int64)
        done = 0
        for batch in batches:
            cells = order[done : done + batch.num_rows]
            done += batch.num_rows
            if done > rows:
                break
            lot = pa.array(rng.integers(-(1 << 63), (1 << 63) - 1, batch.num_rows, dtype=np.int64))
            place = [pa.array(x[cells]) for x in (owner.astype(np.int32), first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *place, pa.array(cells), lot], [*kept, "shard", "slot", "__cell", "__lot"])
        if done != rows:
            raise RuntimeError(f"partition {p} had {rows} rows when counted and others now; store the table first")

    schema = docs.schema
    for name, kind in (("shard", T.IntegerType()), ("slot", T.LongType()), ("__cell", T.LongType()), ("__lot", T.LongType())):
        schema = T.StructType([*schema, T.StructField(name, kind)])
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__lot")) - 1
    dealt = docs.mapInArrow(deal, schema).withColumn("slot", F.col("slot") + place)
    return dealt.drop("__cell", "__lot")
