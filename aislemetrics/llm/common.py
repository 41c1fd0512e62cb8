"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from aislemetrics.session import materialise

# Documents handled together inside a task; bounds the Python objects alive at once.
SLICE = 256
# Narrow rows (a few numbers) in one file of an intermediate table; a few megabytes.
ROWS_PER_FILE = 250_000
# Rows and bytes in one batch that goes to Python, so that wide rows of long texts take little memory beside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str, rows: int) -> DataFrame:
    """``materialise`` for a frame of narrow rows, at most ``rows`` of them: as many files as these fill."""
    return materialise(frame.coalesce(-(-max(rows, 1) // ROWS_PER_FILE)), label)


def bounded_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def least_hashed(frame: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of ``frame`` whose ``key`` has the least hash; a sample that depends on the keys alone.

    Rows are counted first, and only those below a bound that about twice ``limit`` keys reach are put in order, so that
    what tasks hand on does not grow with their number.  Where keys repeat so that too few are below it, all are.
    """
    order = F.xxhash64(key)
    rows = frame.count()
    if rows > 4 * limit:
        below = frame.where(order <= F.lit(int(2**64 * (2 * limit / rows)) - 2**63))
        if below.select(key).count() >= limit:
            frame = below
    return frame.orderBy(order, *frame.columns).limit(limit)


class Memo(dict):
    """A table of ``function(key)`` for the distinct keys a task has met.

    Forgetting the table changes only speed, so it is emptied beyond ``limit`` keys, and keys longer
    than ``longest`` are not kept at all.
    """

    def __init__(self, function: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def map_rows(
    frame: DataFrame,
    schema: str,
    columns: list[str],
    start: Callable[[], Callable[..., list]],
    carry: tuple[str, ...] = ("doc_id",),
    rows: int = SLICE,
) -> DataFrame:
    """The columns ``carry`` as they are, and those of ``schema`` computed from ``columns``, ``rows`` rows at a time.

    ``start()`` runs once a task and returns a function from the lists of ``columns`` to the lists (or Arrow arrays) of the
    new columns.  Nothing but ``carry`` and ``columns`` is read, so further columns, whatever their names, do no harm.
    """
    bounded_batches(frame.sparkSession)
    new = frame.sparkSession.createDataFrame([], schema).schema
    result = StructType([frame.schema[name] for name in carry] + list(new))
    frame = frame.select(*carry, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(result)
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(*(column.to_pylist() for column in part.columns[len(carry) :]))
                arrays = [*part.columns[: len(carry)], *made]
                yield pa.RecordBatch.from_arrays(
                    [
                        value if isinstance(value, pa.Array) else pa.array(value, field.type)
                        for value, field in zip(arrays, target, strict=True)
                    ],
                    schema=target,
                )

    return frame.mapInArrow(run, result)
