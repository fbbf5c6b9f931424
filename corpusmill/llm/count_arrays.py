"""Counts by slot of a hashed table, summed over all tasks.

Tasks add to arrays of fixed size and hand them over in compressed chunks; chunks are summed in two steps, so that no task reads a
chunk from every other one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, SALTS = 1 << 15, 32
SCHEMA = "part int, chunk int, task int, counts binary"


def _row(part: int, chunk: int, task: int, counts: np.ndarray) -> pa.RecordBatch:
    import zstandard

    data = zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([data], pa.binary())], ["part", "chunk", "task", "counts"])


def chunks(part: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a task's array; its length is a multiple of CHUNK."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() % SALTS
    for chunk in range(len(total) // CHUNK):
        piece = total[chunk * CHUNK : (chunk + 1) * CHUNK]
        if piece.any():
            yield _row(part, chunk, task, piece)


def summed(found: DataFrame) -> DataFrame:
    """(part, chunk, counts): one row for each chunk of each part, from rows of SCHEMA."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, held, key = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            for row in batch.to_pylist():
                k = (row["part"], row["chunk"], row["task"])
                if k != key:
                    if held is not None:
                        yield _row(*key, held)
                    key, held = k, np.zeros(CHUNK, "<u8")
                held = held + np.frombuffer(expand(row["counts"]), "<u8")
        if held is not None:
            yield _row(*key, held)

    n = common.parallelism(found.sparkSession)
    for salt in (F.col("task"), F.lit(0)):
        keyed = found.withColumn("task", salt).repartition(n, "part", "chunk", "task").sortWithinPartitions("part", "chunk", "task")
        found = keyed.mapInArrow(add, SCHEMA)
    return found.select("part", "chunk", "counts")


def filled(rows: list, size: int) -> np.ndarray:
    """The array of `size` counts from chunk rows, added up over parts."""
    import zstandard

    total = np.zeros(size, np.uint64)
    for r in rows:
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), "<u8")
    return total
