"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Spark gives to a Python worker at a time. Its buffers, several times that in each task, stay with the executor.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset on a local master, a temporary folder becomes the checkpoint folder.

    On a cluster without the setting this raises, as a machine-local folder
    would not be seen by others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="kilnflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run inside give Python workers BATCH_BYTES at a time, or what the session has set."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that lost executors cost no recomputation before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there is deleted at the end of the program, or by release()."""
    path = f"{shared_dir(spark)}/kilnflow-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def mark() -> int:
    """How many paths have been given out; for release()."""
    return len(_written)


def release(since: int = 0, newest: int = 0) -> None:
    """Delete what was written since a mark(), but for the ``newest`` paths. Results that still read the rest can't be computed afterwards."""
    gone = _written[since : len(_written) - newest]
    del _written[since : len(_written) - newest]
    for spark, path in gone:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder's owner clears it
            continue


atexit.register(release)  # results are lazy until the end of the program
