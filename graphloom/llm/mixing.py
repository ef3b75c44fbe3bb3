"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is its share of the target size over its rows.  Each document takes the number of copies at which the
Poisson distribution with that mean exceeds a uniform number drawn from a hash of its id; copies are exploded and all
rows are shuffled by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: A mean over this is the sum of several Poisson draws, so that exp(-mean) stays a normal number.
MOST_MEAN = 500.0
#: A source table of up to this many rows is broadcast; beyond it, documents and sources are salted and shuffled.
SOURCES_BROADCAST, SALTS = 20_000, 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the seed and the parts."""
    spell = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(spell.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: DataFrame | None = None, size: Column | None = None, source_col: str = "source") -> DataFrame:
    """(source, rate): mean copies of a document of each source.

    ``weights``: (source, weight), relative; sources without one get none, and without ``weights`` all are weighted alike.
    ``size``: an aggregate over (n), the rows of each source, that gives the target number of rows; by default as many as there are.  A null source is
    a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(w, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").na.fill(0.0, ["weight"])
    total = weighed.agg(F.sum("weight").alias("_weights"), (F.sum("n") if size is None else size).cast("double").alias("_size"))
    return weighed.join(F.broadcast(total)).select("source", F.expr("CASE WHEN _weights > 0 THEN weight / _weights * _size / n ELSE 0D END").alias("rate"))


def mixed(docs: DataFrame, rate: DataFrame | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents, each as often as drawn, in random order, with copy_number (from 1), n_copies and mix_key added.

    ``rate``: (source, rate) as rates() gives it.  The draw depends on the seed and the id alone, so repeated rows take
    equal counts and a lost task draws the same again; null ids draw as an empty one.  Rows are dealt to partitions and
    sorted there by mix_key.  Columns of the added names are replaced.  An empty table gives no rows.
    """
    rate = rates(docs, source_col=source_col) if rate is None else rate
    n = rate.count()
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    table = rate.select(F.col("source").alias("_source"), "rate", pieces.alias("_pieces"), (F.col("rate") / pieces).alias("_mean"))
    reach = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 20).cast("int")
    table = table.withColumn("_cdf", F.aggregate(
        F.sequence(F.lit(1), reach), F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("_mean") / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("_mean") / k)).alias("c")), lambda a: a["c"],
    ))

    rows = docs.drop("copy_number", "n_copies", "mix_key")
    if n <= SOURCES_BROADCAST:
        met = rows.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col("_source")))
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        salted = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(salted, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_s"))).drop("_salt", "_s")
    below = lambda u: F.size(F.filter("_cdf", lambda c: c <= u))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda a, k: a + below(uniform(seed, F.col(id_col), k)))
    met = met.withColumn("n_copies", drawn.cast("int")).drop("_source", "rate", "_pieces", "_mean", "_cdf")
    met = met.where("n_copies > 0").withColumn("copy_number", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    spell = F.concat_ws("|", F.lit(f"{seed}/order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy_number").cast("string"))
    met = met.withColumn("mix_key", F.md5(spell.cast("binary")))
    return met.repartition(partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
