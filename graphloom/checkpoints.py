"""Cutting lineage with files that all machines see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables: the session's ``spark.checkpoint.dir``.

    Where none is set, a local master gets a folder of its own; a cluster, whose machines would not see it, an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, so that a lost executor costs no earlier work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
