"""Checks and reconstructions of a document graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk import ordered_text
from .graph import counted, linked


def chunk_statistics(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each document: chunks, tokens in all, mean, least, most, and chunks by kind where there is a kind."""
    kinds = [F.sum(F.when(F.col("type") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("text", "table", "image")] if "type" in chunks.columns else []
    t = "token_count"
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum(t).alias("tokens"), F.avg(t).alias("mean_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), *kinds)


def chain_gaps(chunks: DataFrame, edges: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each document, how many breaks its NEXT chain has: chunks without a next one, but for the last."""
    tails = linked(chunks, edges, "id", negate=True).groupBy(key).agg(F.count("*").alias("tails"))
    return tails.select(key, F.greatest(F.col("tails") - 1, F.lit(0)).alias("gaps"))


def orphans(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Elements with a text that no chunk refers to."""
    used = chunks.select(F.explode("element_ids").alias("id")).distinct()
    return elements.where(F.trim("text") != "").join(used, "id", "left_anti")


def listed(documents: DataFrame, **children: DataFrame) -> DataFrame:
    """Sources with their versions in order: (source_id, n_versions, versions array<struct>)."""
    rows = counted(documents, "document_id", **{f"n_{k}": v for k, v in children.items()})
    fields = ["version", "document_id", "active", *(f"n_{k}" for k in children)]
    return rows.groupBy("source_id").agg(F.count("*").alias("n_versions"), F.array_sort(F.collect_list(F.struct(*fields))).alias("versions"))


def totals(documents: DataFrame, **children: DataFrame) -> DataFrame:
    """(source_id, n_versions, latest, n_... of each child): summed before the shuffle, so a source of many versions is
    no single row or task."""
    rows = counted(documents, "document_id", **{f"n_{k}": v for k, v in children.items()})
    return rows.groupBy("source_id").agg(F.count("*").alias("n_versions"), F.max("version").alias("latest"), *(F.sum(f"n_{k}").alias(f"n_{k}") for k in children))


def markdown(elements: DataFrame) -> DataFrame:
    """(document_id, text): elements in order, headings marked by their level, tables as they are, images as a mark."""
    mark = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), "text")
    piece = F.when(F.col("type") == "heading", mark).when(F.col("type") == "image", F.concat(F.lit("[IMAGE: "), F.col("id").cast("string"), F.lit("]"))).when(F.col("type") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return ordered_text(elements.withColumn("_p", piece).where("_p <> ''"), ["document_id"], "seq", "_p").select("document_id", "text")


def rejoined(chunks: DataFrame) -> DataFrame:
    """(document_id, text): chunks in order under a line that says what they are."""
    line = F.concat(F.lit("--- chunk "), F.col("idx").cast("string"), F.lit(" ("), F.col("token_count").cast("string"), F.lit(" tokens) ---\n"), "text")
    return ordered_text(chunks.withColumn("_p", line), ["document_id"], "idx", "_p").select("document_id", "text")
