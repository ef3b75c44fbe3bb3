"""Idempotent writes: entities, relationships and their provenance, and updates by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a task of an upsert sorts, about.
ROWS = 500_000


def upserted(known: DataFrame, incoming: DataFrame, rows: int | None = None) -> DataFrame:
    """Entities (label, key, props, seq) after a write: of each property the last value that is not null; known rows
    come before incoming ones.

    ``rows``: how many there are together, if that is known; then they are dealt once, to as many tasks as that needs.
    """
    every = known.select("label", "key", "props", F.lit(0).alias("_new"), "seq")
    every = every.unionByName(incoming.select("label", "key", "props", F.lit(1).alias("_new"), "seq"))
    if rows is not None:
        least = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = every.repartition(max(least, -(-rows // ROWS)), "label", "key")
    order = F.struct("_new", "seq")
    names = every.groupBy("label", "key").agg(F.max(order).alias("o"))
    values = every.select("label", "key", "_new", "seq", F.explode("props").alias("name", "value")).where("value is not null")
    values = values.groupBy("label", "key", "name").agg(F.max_by("value", order).alias("value"))
    props = values.groupBy("label", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("props"))
    empty = F.create_map().cast("map<string, string>")
    return names.join(props, ["label", "key"], "left").select("label", "key", F.coalesce("props", empty).alias("props"), F.col("o.seq").alias("seq"))


#: What names a relationship; as JSON it is the key of an upsert.
EDGE = ("type", "src_label", "src", "dst_label", "dst")


def upserted_edges(known: DataFrame, incoming: DataFrame, entities: DataFrame, rows: int | None = None) -> DataFrame:
    """Relationships (type, src_label, src, dst_label, dst, props, seq) after a write: rows whose ends are no entity vanish,
    one row for each (type, ends), later properties win.  ``rows``: as for ``upserted``."""
    ends = entities.select("label", "key")
    found = incoming
    for end in ("src", "dst"):
        found = found.join(ends.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(end)), [f"{end}_label", end], "left_semi")
    both = known.select(*EDGE, "props", "seq", F.lit(0).alias("_new")).unionByName(found.select(*EDGE, "props", "seq", F.lit(1).alias("_new")))
    as_entities = both.select(F.lit("edge").alias("label"), F.to_json(F.struct(*EDGE)).alias("key"), "props", (F.col("_new") * F.lit(1 << 40) + F.col("seq")).alias("seq"))
    after = upserted(as_entities.limit(0), as_entities, rows)
    return after.select(F.from_json("key", ", ".join(f"{c} string" for c in EDGE)).alias("e"), "props").select("e.*", "props")


def provenance(rows: DataFrame) -> DataFrame:
    """EXTRACTED_FROM (label, key, chunk_id, model, pass_number, pass_type, extracted_at): one row for each entity and chunk,
    the latest run's."""
    run = F.struct("extracted_at", "model", "pass_number", "pass_type")
    best = rows.groupBy("label", "key", "chunk_id").agg(F.max(run).alias("r"))
    return best.select("label", "key", "chunk_id", "r.*")


def written_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows written and distinct things among them."""
    a = entities.agg(F.count("*").alias("rows"), F.countDistinct("label", "key").alias("distinct")).select(F.lit("entities").alias("kind"), "rows", "distinct")
    b = edges.agg(F.count("*").alias("rows"), F.countDistinct("type", "src", "dst").alias("distinct")).select(F.lit("relationships").alias("kind"), "rows", "distinct")
    return a.unionByName(b)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets columns from ``changes`` where they have the key and a value."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))
