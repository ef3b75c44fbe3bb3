"""Document and chunk-set versions: numbering, activation, cascading deletion, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scanned

#: Tables that go with a document, in the order in which they are reported.
PARTS = ("chunk", "section", "element", "image", "table", "page", "document")


def versioned(rows: DataFrame, source: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """Adds source_id, version, id and active.  Versions of a source go on from its greatest known one; the last is active.

    A source with very many versions is numbered by several tasks (see ``scan``)."""
    rows = scanned(rows, [source], [order]).withColumnsRenamed({"number": "version", "last": "active"})
    if known is not None:
        last = known.groupBy(F.col("source_id").alias(source)).agg(F.max("version").alias("_last"))
        rows = rows.join(last, source, "left").withColumn("version", F.col("version") + F.coalesce("_last", F.lit(0))).drop("_last")
    rows = rows.withColumns({"source_id": F.col(source), "version": F.col("version").cast("int")})
    return rows.withColumn("id", F.concat("source_id", F.lit("_v"), F.col("version").cast("string")))


def activated(documents: DataFrame, document_id: str) -> DataFrame:
    """Makes one version of its source the only active one; other sources stay as they are."""
    source = documents.where(F.col("id") == document_id).select(F.col("source_id").alias("_s")).limit(1)
    out = documents.join(F.broadcast(source), F.col("source_id") == F.col("_s"), "left")
    return out.withColumn("active", F.when(F.col("_s").isNotNull(), F.col("id") == document_id).otherwise(F.col("active"))).drop("_s")


def activated_chunks(chunks: DataFrame, document_id: str, chunk_set: int) -> DataFrame:
    mine = F.col("document_id") == document_id
    return chunks.withColumn("active", F.when(mine, F.col("chunk_set_version") == chunk_set).otherwise(F.col("active")))


def deactivated(rows: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with those of ``which`` inactive, and how many of these had been active."""
    active = F.coalesce("active", F.lit(True))
    return rows.withColumn("active", active & ~which), rows.where(which & active).agg(F.count("*").alias("deactivated"))


def next_chunk_set(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).agg((F.coalesce(F.max("chunk_set_version"), F.lit(0)) + 1).alias("chunk_set_version"))


def effective_active(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that are active and belong to an active document."""
    live = documents.where(F.coalesce("active", F.lit(True))).select(F.col("id").alias("document_id"))
    return chunks.where(F.coalesce("active", F.lit(True))).join(live, "document_id", "left_semi")


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes documents (``gone``: id) with all their parts: what is left, and (label, n) of what went.

    Parts carry document_id, so ids that share a prefix are not confused.
    """
    left, counts = {}, []
    for name, table in tables.items():
        key = "id" if name == "document" else "document_id"
        ids = gone.select(F.col("id").alias(key))
        left[name] = table.join(ids, key, "left_anti")
        counts.append(table.join(ids, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n"))
    return left, reduce(DataFrame.unionByName, counts)


def inactive(documents: DataFrame, source_id: str | None = None, document_id: str | None = None) -> DataFrame:
    """Ids of inactive documents: of one document, else of one source, else all."""
    rows = documents.where(~F.coalesce("active", F.lit(True)))
    if document_id is not None:
        rows = rows.where(F.col("id") == document_id)
    elif source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    return rows.select("id")


def cleaned(tables: dict[str, DataFrame], source_id: str | None = None, document_id: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    return deleted(tables, inactive(tables["document"], source_id, document_id))


def without_chunks(chunks: DataFrame, edges: DataFrame, only_inactive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks and edges after deleting (inactive) chunks; no edge is left dangling."""
    gone = chunks.where(~F.coalesce("active", F.lit(True))) if only_inactive else chunks
    ids = gone.select("id")
    cut = edges
    for end in ("src", "dst"):
        cut = cut.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return chunks.join(ids, "id", "left_anti"), cut
