"""Session options the plans count on, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL options.  Joins carry no broadcast hints: Spark broadcasts a side only when its
# size is below spark.sql.autoBroadcastJoinThreshold (file statistics first, measured shuffle
# sizes under AQE) and sort-merge joins otherwise.  A hot join key is split by the AQE skew
# join, also where that costs one more exchange.  Where every measured partition of a side is
# small, AQE hashes it instead of sorting both sides.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options on an existing session."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "aislemetrics", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    # Recording a call site for every column costs more than planning does.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the one named in ``spark.checkpoint.dir``.

    Only a single local process without the setting, as in a test, gets a private temporary folder;
    a cluster without it is refused, since a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="aislemetrics-"))
    return spark.sparkContext.getCheckpointDir()


# What this process has written to the shared folder, and the thread that did.
_written: dict[str, int] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``release`` deletes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written[path] = threading.get_ident()
    return path


def written() -> list[str]:
    """Paths of this thread that are not deleted yet, the latest last."""
    return [path for path, owner in list(_written.items()) if owner == threading.get_ident()]


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete ``paths``, or all intermediates of this process; frames that read them must be done with."""
    for name in list(_written) if paths is None else list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.pop(name, None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins real file sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
