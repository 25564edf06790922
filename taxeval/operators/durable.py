"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this driver has written.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master (tests) gets a folder of
    its own; on a cluster that is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small(df: DataFrame, most: int, what: str) -> DataFrame:
    """df for a broadcast, if it has at most so many rows; more are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many tables this driver has written and not removed."""
    return len(_WRITTEN)


def remove_written(spark: SparkSession, after: int = 0, keep: int = 0) -> int:
    """Deletes the tables that this driver has written, but for the first `after` and the last `keep`, once nothing that
    reads them is needed any more; their number."""
    gone = _WRITTEN[after : len(_WRITTEN) - keep]
    del _WRITTEN[after : len(_WRITTEN) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
