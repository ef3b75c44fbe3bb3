"""Entities and relationships as files bucketed by key: a batch rewrites the buckets that it hits, and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from .upsert import EDGE, ROWS, upserted

_ROW = "label string, key string, props map<string, string>, seq long"


@dataclass(frozen=True)
class Written:
    """What a batch did: its rows, the entities among them, and the buckets that were rewritten."""

    rows: int
    entities: int
    buckets: tuple[int, ...]


@dataclass(frozen=True)
class Store:
    """A table of (label, key, props, seq) under ``path``.  The number of buckets is part of the table: keep it."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("label", "key"), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All entities; none before the first batch."""
        return self._read().drop("bucket")

    def _read(self) -> DataFrame:
        # Without a schema given, a table of no file could not be read.
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        schema = f"{_ROW}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def merged(self, incoming: DataFrame) -> Written:
        """Writes a batch (label, key, props, seq): of each property the last value that is not null, rows of the batch in
        the order of seq and after what is known.

        Only files of the hit buckets are read and replaced (a dynamic partition overwrite).  The same batch again gives
        the same table, so a batch that broke off is repeated as a whole.
        """
        batch = checkpoint(incoming.select("label", "key", "props", "seq").withColumn("bucket", self._bucket()))
        sums = batch.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("label", "key").alias("entities")).collect()  # numbers of buckets
        hit, n = sorted(r.bucket for r in sums), sum(r.n for r in sums)
        if hit:
            known = self._read().where(F.col("bucket").isin(hit))
            rows = n + known.count()
            # What is overwritten is read first: the merged rows go to the checkpoint folder.
            after = checkpoint(upserted(known, batch, rows).withColumn("bucket", self._bucket()))
            files = -(-rows // (ROWS * len(hit)))  # of a bucket
            out = after.repartition(files * len(hit), "bucket", F.pmod(F.xxhash64("key"), F.lit(files)))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return Written(n, sum(r.entities for r in sums), tuple(hit))

    def merged_edges(self, incoming: DataFrame, entities: DataFrame) -> Written:
        """Writes relationships (type, src_label, src, dst_label, dst, props, seq); those whose ends are no entity vanish."""
        ends = entities.select("label", "key").distinct()
        rows = incoming
        for end in ("src", "dst"):
            rows = rows.join(ends.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(end)), [f"{end}_label", end], "left_semi")
        name = F.to_json(F.struct(*EDGE))
        return self.merged(rows.select(F.col("type").alias("label"), name.alias("key"), "props", "seq"))

    def edges(self) -> DataFrame:
        """The relationships of a store that ``merged_edges`` wrote."""
        ends = F.from_json("key", ", ".join(f"{c} string" for c in EDGE))
        return self.rows().select(ends.alias("e"), "props", "seq").select("e.*", "props", "seq")
