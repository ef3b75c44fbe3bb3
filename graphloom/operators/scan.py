"""Numbers and neighbours within groups of any size, without a task that holds a group.

Rows are dealt to ranges of (group, order), so a large group is spread over neighbouring ranges.  Each range numbers its own
part of a group; counts of the parts, summed over the ranges before, give what a part starts from, and the first row of the
next range is the follower of a range's last row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint


def scanned(rows: DataFrame, keys: list[str], order: list[str], follower: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``number`` (from 1, within the group), ``last`` (no row of the group comes after) and, if a column is named,
    ``next``: its value in the row after.  Groups are of equal keys, nulls together; ``order`` ascends, and rows that tie
    in it are numbered in any order.

    Rows are shuffled twice, so they should be narrow.  Ranges are drawn once: their numbers are checkpointed.
    """
    n = partitions or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    value = F.struct((F.col(follower) if follower else F.lit(None).cast("int")).alias("v"))
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    local = ranged.withColumns({"_n": F.row_number().over(own), "_next": F.lead(value).over(own)})
    parts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_size"), F.min_by(value, F.struct(*order)).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_part")
    before = F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"_before": before, "_after": F.lead("_first").over(along)})
    # A range shares its first and its last group with others at most: two rows for each range are left.
    parts = parts.where("_before IS NOT NULL OR _after IS NOT NULL").select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_before", "_after")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(parts), same, "left").withColumn("_next", F.coalesce("_next", "_after"))
    out = out.withColumns({"number": F.col("_n") + F.coalesce("_before", F.lit(0)), "last": F.col("_next").isNull()})
    if follower:
        out = out.withColumn("next", F.col("_next.v"))
    return out.select(*rows.columns, "number", "last", *(["next"] if follower else []))
