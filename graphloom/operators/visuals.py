"""Descriptions of images, tables and pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_describe(*sources: DataFrame, again: bool = False) -> DataFrame:
    """Visual nodes (id, kind, image, text) of several tables that have an image and, unless ``again``, no description;
    of the same id the one from the earlier table."""
    parts = [s.select("id", "kind", "image", "text", "text_description", F.lit(k).alias("_k")) for k, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts)
    first = F.row_number().over(Window.partitionBy("id").orderBy("_k")) == 1
    rows = rows.withColumn("_first", first).where("_first and image is not null")
    return (rows if again else rows.where("text_description is null")).drop("_first", "_k")


def described(rows: DataFrame, describe: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """(id, text_description); ``describe`` is a vision model's stand-in, and nulls are left out."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"].tolist(), "text_description": list(describe(frame))}).dropna()

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, text_description string")


def written_back(nodes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Nodes with their descriptions; those described become chunks too (a second label)."""
    out = nodes.join(descriptions.withColumnRenamed("text_description", "_d"), "id", "left")
    chunk = F.when(F.col("_d").isNotNull(), F.array_union("labels", F.array(F.lit("Chunk")))).otherwise(F.col("labels"))
    return out.withColumns({"labels": chunk, "text_description": F.coalesce("_d", "text_description")}).drop("_d")


def report(descriptions: DataFrame) -> DataFrame:
    return descriptions.agg(F.count("*").alias("n"), F.bround(F.avg(F.length("text_description")), 1).alias("mean_length"))
