"""Questions of several hops over entities and their mentions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents_by_entity(provenance: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label, n_entities, n_documents): entities through chunks to documents."""
    rows = provenance.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    return rows.groupBy("label").agg(F.countDistinct("key").alias("n_entities"), F.countDistinct("document_id").alias("n_documents"))


def reach(first: DataFrame, second: DataFrame) -> DataFrame:
    """A -> B -> C: (a, n_c): how many distinct C each A reaches.  Pairs are made distinct before they are counted."""
    hop = first.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    pairs = hop.join(second.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").select("a", "c").distinct()
    return pairs.groupBy("a").agg(F.count("*").alias("n_c"))


#: Edges that a task reads, and pairs that it counts, about.
ROWS, PAIRS = 500_000, 2_000_000


def shared_pairs(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, n): the k pairs of sources with the most targets in common; ties by name.

    A target's sources travel as one list to each of them; a source's pairs are counted where its lists meet.  There are
    as many tasks as the number of pairs asks for.
    """
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    e = e.repartition(max(least, -(-e.count() // ROWS)), "dst").distinct()
    many = e.groupBy("dst").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    tasks = max(least, math.ceil(many / PAIRS))
    near = e.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("near"))
    later = F.slice("near", F.array_position("near", F.col("src")).cast("int") + 1, F.size("near"))
    lists = e.join(near.hint("shuffle_hash"), "dst").select(F.col("src").alias("a"), later.alias("b")).where(F.size("b") > 0)
    pairs = lists.repartition(tasks, "a").select("a", F.explode("b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)
