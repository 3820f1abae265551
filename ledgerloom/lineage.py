"""Cutting lineage through storage that survives the loss of an executor.

The folder comes from ``spark.checkpoint.dir`` (shared by all executors on a
cluster).  Only a local session that names none, as in tests, gets a temporary
folder, which goes with the process; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets one only where none is configured and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder; later plans read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
