"""The shared folder for checkpoints and intermediate tables.

On a cluster it must be reachable from every executor, so it is read from ``spark.checkpoint.dir``.
Only a ``local`` master, where driver and executors share a disk, falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where the session has none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="riskgrid-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, spread: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with a single computation of the table; a lost executor costs a re-read, and
    the planner knows the size of what it joins next. With ``spread`` the rows are first distributed
    evenly by these columns, for tables that are read many times.
    """
    path = shared_path(df.sparkSession, name)
    (df.repartition(*spread) if spread else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
