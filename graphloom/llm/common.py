"""What the operators of this subpackage share: shared scratch space, partition counts, small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import checkpoint, shared_dir

__all__ = ["checkpoint", "drop_scratch", "in_arrow", "partitions", "shared_dir", "table", "written"]

#: Bytes of a batch that goes to a Python worker.  Rows of whole texts are wide: by the session's default of 10,000 rows a
#: batch, long texts would fill the memory of JVM and worker several times over.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most about BATCH_BYTES (a session setting, read when the plan runs)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; for wide rows.

    The table stays as long as the session, since what is returned reads it; ``drop_scratch`` removes it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``written`` left in this process.
_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> None:
    """Removes the tables written so far.  Only for when all results that read them are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many groups to deal keys into: the session's shuffle partitions, which its owner sizes to the data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
