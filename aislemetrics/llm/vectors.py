"""Vectors in Arrow columns as whole numbers in numpy, and summaries of tasks merged along a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import bounded_batches
from aislemetrics.session import materialise

# Summaries that one task of a merge, or the driver at its end, takes at once.
FAN = 32
# Scaled entries reach at most this size, so that sums of a batch of them stay exact.
LARGEST = 2**40


def finite_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places in ``column`` (lists of numbers) of the vectors without null or non-finite entries, and
    these vectors as rows of doubles.  Null and empty lists are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = column.offsets.to_numpy(zero_copy_only=False)[:-1]
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False)), 0)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    faults = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = (sizes > 0) & (faults[starts + sizes] == faults[starts])
    return {
        int(size): (rows := np.flatnonzero(fine & (sizes == size)), flat[starts[rows, None] + np.arange(size)])
        for size in np.unique(sizes[fine])
    }


def scaled_floor(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * entry) of every entry as whole numbers."""
    floors = np.floor(scale * vectors)
    if floors.size and np.abs(floors).max() > LARGEST:
        raise OverflowError(f"an entry times {scale} is beyond {LARGEST}")
    return floors.astype(np.int64)


def summaries(rows: DataFrame, columns: list[str], start: Callable) -> DataFrame:
    """(part, summary) of every task over ``columns``.

    ``start()`` gives two functions: one takes a record batch, the other returns the task's summary in bytes, or None.
    """
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, result = start()
        for batch in batches:
            if batch.num_rows:
                add(batch)
        made = result()
        if made is not None:
            part = [TaskContext.get().partitionId()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([made], pa.binary())], names=["part", "summary"])

    return rows.select(*columns).mapInArrow(run, "part long, summary binary")


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], label: str) -> bytes | None:
    """One summary of all: ``FAN`` at a time along a tree of tasks, the last ``FAN`` or fewer on the driver.

    Each level is written to the shared folder, so a lost executor costs one level at most.
    """
    parts = materialise(parts, label)

    def join(frame):
        import pandas as pd

        frame = frame.sort_values("part")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "summary": [merge(list(frame["summary"]))]})

    while parts.count() > FAN:
        groups = parts.groupBy(F.floor(F.col("part") / FAN).alias("group"))
        parts = materialise(groups.applyInPandas(join, "part long, summary binary"), label)
    rows = sorted(parts.collect(), key=lambda row: row.part)
    return merge([bytes(row.summary) for row in rows]) if rows else None


def common_length(rows: DataFrame, column: str) -> int:
    """The length that most finite vectors of ``column`` have, the greater one on a tie; 0 without any."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        count: dict[int, int] = {}
        for batch in batches:
            for size, (places, _) in finite_vectors(batch.column(0)).items():
                count[size] = count.get(size, 0) + len(places)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["size", "n"]
        )

    sizes = rows.select(column).mapInArrow(run, "size int, n long").groupBy("size").agg(F.sum("n").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return top[0].size if top else 0
