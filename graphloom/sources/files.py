"""Reading files and writing graphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are inferred unless given; empty fields and NaN are null."""
    if not path:
        raise ValueError("a path is needed")
    reader = spark.read.option("header", True).option("nanValue", "\0")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    floats = [c for c, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats}) if floats else df


def nodes_from(rows: DataFrame, label: str, key: str, seq: str | None = None) -> DataFrame:
    """Entities (label, key, props, seq) from table rows; null values are no properties."""
    values = [x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))]
    props = F.map_filter(F.create_map(*values), lambda k, v: v.isNotNull())
    return rows.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), props.alias("props"), (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias("seq"))


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the PDF files of a folder (any case of the suffix); raises if there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    found = found.select("path", "length", "content").orderBy("path")
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no PDF under {path}")
    return found


def page_counts(files: DataFrame, count: Callable[[bytes], int] | None = None) -> DataFrame:
    """(path, n_pages); a file that cannot be read counts as 0.  The default counts page objects in the raw bytes, a
    stand-in for a PDF library."""
    import re

    count = count or (lambda data: len(re.findall(rb"/Type\s*/Page(?![s\w])", data)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = []
            for data in frame["content"]:
                try:
                    n.append(count(data))
                except (ValueError, OSError):
                    n.append(0)
            yield pd.DataFrame({"path": frame["path"], "n_pages": n})

    return files.select("path", "content").mapInPandas(run, "path string, n_pages long")


def hierarchy(df: DataFrame, column: str) -> DataFrame:
    """(id, level) of a JSON list of sections."""
    items = F.from_json(column, "array<struct<id: string, level: int>>")
    return df.select(F.explode(items).alias("x")).select("x.id", "x.level")


def model_tables(text: str, name: str) -> dict[str, list]:
    """Rows of the ontology tables from a data model in JSON: nodes with key_property and properties, and relationships
    with start_node_label and end_node_label."""
    model = json.loads(text)

    def prop(owner: str, p: dict, key: bool) -> tuple:
        kind = {"STRING": "STRING", "INTEGER": "INTEGER", "FLOAT": "FLOAT", "BOOLEAN": "BOOLEAN"}.get(str(p.get("type", "STRING")).upper(), "STRING")
        return (name, owner, p["name"], kind, key, key, None, None, None, None, None, None, None, None)

    nodes, relations = model.get("nodes", []), model.get("relationships", [])
    props = [prop(n["label"], n["key_property"], True) for n in nodes]
    props += [prop(n["label"], p, False) for n in nodes for p in n.get("properties", []) if p["name"] != n["key_property"]["name"]]
    props += [prop(r["type"], p, False) for r in relations for p in r.get("properties", [])]
    return {
        "ontology": [(name, "1")],
        "node_type": [(name, n["label"], n.get("description")) for n in nodes],
        "relationship_type": [(name, r["type"]) for r in relations],
        "endpoint": [(name, r["type"], e, r[f"{s}_node_label"]) for r in relations for e, s in (("from", "start"), ("to", "end"))],
        "property": props,
    }


def saved(graph: Graph, path: str, partition_by: str | None = None) -> None:
    """Appends each table to Parquet under node/<label> and edge/<type>."""
    for kind, tables in (("node", graph.nodes), ("edge", graph.edges)):
        for name, table in tables.items():
            writer = table.write.mode("append")
            if partition_by in table.columns:
                writer = writer.partitionBy(partition_by)
            writer.parquet(f"{path}/{kind}/{name}")


def opened(spark: SparkSession, path: str, nodes: list[str], edges: list[str]) -> Graph:
    read = lambda kind, names: {n: spark.read.parquet(f"{path}/{kind}/{n}") for n in names}
    return Graph(read("node", nodes), read("edge", edges))


def reports(texts: DataFrame, path: str) -> None:
    """One Markdown part file for each document: (document_id, text)."""
    texts.write.mode("overwrite").partitionBy("document_id").option("lineSep", "\n").text(path)


def manifest(rows: DataFrame, path: str) -> None:
    """Reports and manifests as JSON lines, one object for each row."""
    rows.write.mode("overwrite").json(path)
