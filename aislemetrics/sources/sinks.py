"""Writers for results.  A path that is being read is never overwritten."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, name: str, files: int | None = None) -> None:
    """Overwrite a managed table.

    ``files`` is for results of known size; without it AQE sizes the files.
    """
    (df.coalesce(files) if files else df).write.mode("overwrite").saveAsTable(name)


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    _check_target(df, path)
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header, the whole report at once; also stands in for spreadsheet output."""
    _check_target(df, path)
    (df.coalesce(files) if files else df).write.mode("overwrite").csv(path, header=True)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Add a run's rows to a growing report, under the column ``run``.

    Only the run's own partition is replaced, so a run that is repeated, or that failed half-way, leaves
    its rows once and those of other runs as they are.
    """
    _check_target(df, path)
    named = df.withColumn("run", F.lit(run))
    named.write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_by_week(items: DataFrame, path: str, tasks_per_week: int = 8) -> None:
    """The fact in one folder a week: week ranges prune folders when planning, joins with a week table at run time.

    A week's rows are spread over ``tasks_per_week`` tasks by basket.
    """
    _check_target(items, path)
    spread = F.pmod(F.xxhash64("transaction_fid"), F.lit(tasks_per_week))
    items.repartition("fis_week_id", spread).write.partitionBy("fis_week_id").mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Overwrite a managed table of ``buckets`` files, dealt and sorted by ``keys``.

    What groups or joins by the keys then reads it without a shuffle.  Rows without a first key are left
    to plain tables: they would all meet in one bucket.
    """
    kept = df.filter(F.col(keys[0]).isNotNull()).repartition(buckets, *keys)
    kept.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)


def _check_target(df: DataFrame, path: str) -> None:
    target = path.rstrip("/")
    for source in df.inputFiles():
        name = source.removeprefix("file:").replace("///", "/")
        if name == target or name.startswith(target + "/"):
            raise ValueError(f"{path} is an input of the frame to be written")


def save_pca_model(model: PCAModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pca_model(path: str) -> PCAModel:
    return PCAModel.load(path)


def result_frame(df: DataFrame, max_rows: int = 1_000_000) -> pd.DataFrame:
    """Result-size data as pandas; counts first, and refuses to collect more than ``max_rows``."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows, more than {max_rows}: write the frame instead of collecting it")
    return df.toPandas()
