"""Extraction of entities and relationships from chunks by an ontology."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..schemas import EXTRACTION
from .ontology import Schema, normalized
from .upsert import provenance, upserted, upserted_edges


def classified(chunks: DataFrame) -> DataFrame:
    """Adds chunk_class (PAGE, IMAGE, TABLE or TEXT; the first that fits) and needs_vision."""
    label = lambda x: F.array_contains("labels", x)
    kind = F.when(label("Page"), "PAGE").when((F.col("type") == "image") | label("Image"), "IMAGE").when((F.col("type") == "table") | label("Table"), "TABLE").otherwise("TEXT")
    out = chunks.withColumn("chunk_class", F.coalesce(kind, F.lit("TEXT")))
    return out.withColumn("needs_vision", (F.col("chunk_class") != "TEXT") & F.col("image").isNotNull())


def pending(chunks: DataFrame, extracted_from: DataFrame, force: bool = False) -> DataFrame:
    """Chunks that nothing was extracted from yet."""
    done = extracted_from.select(F.col("chunk_id").alias("id"))
    return chunks if force else chunks.join(done, "id", "left_anti")


def parsed(responses: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Responses (chunk_id, idx, response JSON) -> entities (label, key, props, seq, chunk_id) and relationships (type,
    src_label, src, dst_label, dst, props, seq, chunk_id).

    Values run through their normalizers; a skipped value or a missing key drops its item and nothing else.
    Relationship ends run through the normalizers of the key they name.
    """
    rows = responses.select("chunk_id", "idx", F.from_json("response", EXTRACTION).alias("r"))
    seq = F.col("idx").cast("long") * 100_000 + F.col("pos")
    items = rows.select("chunk_id", "idx", F.posexplode("r.entities").alias("pos", "e"))
    found = []
    for label, fields in schema.nodes.items():
        columns, skip = normalized(F.col("e.properties"), fields)
        # In two steps, so that a value is worked out once however often it is used.
        part = items.where(F.col("e.label") == label).select(seq.alias("seq"), "chunk_id", skip.alias("_skip"), *(c.alias(f"_p_{n}") for n, c in columns.items()))
        key = F.col(f"_p_{schema.key(label).name}").cast("string")
        part = part.where(F.expr("NOT _skip") & key.isNotNull() & (key != ""))
        props = F.map_filter(F.create_map(*(x for n in columns for x in (F.lit(n), F.col(f"_p_{n}").cast("string")))), lambda k, v: v.isNotNull())
        found.append(part.select(F.lit(label).alias("label"), key.alias("key"), props.alias("props"), "seq", "chunk_id"))
    entities = reduce(DataFrame.unionByName, found)
    items = rows.select("chunk_id", "idx", F.posexplode("r.relationships").alias("pos", "e"))
    links = []
    for name, (source, target) in schema.relationships.items():
        src, skip_src = _end(schema, source, F.col("e.source_key"))
        dst, skip_dst = _end(schema, target, F.col("e.target_key"))
        columns, _ = normalized(F.col("e.properties"), schema.edge_fields[name])
        pairs = [x for n, c in columns.items() for x in (F.lit(n), c.cast("string"))]
        props = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string, string>")
        part = items.where(F.col("e.type") == name).select(F.lit(name).alias("type"), F.lit(source).alias("src_label"), src.alias("src"), F.lit(target).alias("dst_label"), dst.alias("dst"), props.alias("props"), seq.alias("seq"), "chunk_id", (skip_src | skip_dst).alias("_skip"))
        links.append(part.where("NOT _skip AND src IS NOT NULL AND dst IS NOT NULL").drop("_skip"))
    none = rows.limit(0).select(*(F.lit("").alias(c) for c in ("type", "src_label", "src", "dst_label", "dst")), F.create_map().cast("map<string, string>").alias("props"), F.lit(0).cast("long").alias("seq"), "chunk_id")
    return entities, reduce(DataFrame.unionByName, links) if links else none


def _end(schema: Schema, label: str, value: Column) -> tuple[Column, Column]:
    key = schema.key(label)
    columns, skip = normalized(F.create_map(F.lit(key.name), value), [key])
    return columns[key.name].cast("string"), skip


def _kept(rows: DataFrame) -> DataFrame:
    path = f"{shared_dir(rows.sparkSession)}/extracted-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def extracted(responses: DataFrame, schema: Schema, known: DataFrame, known_edges: DataFrame, model: str, extracted_at: float = 0.0):
    """Writes a batch of responses: (entities, relationships, provenance) after it.

    Responses and what was parsed are kept as tables in the shared folder: each label reads the ones, all three results
    the other.
    """
    entities, edges = parsed(_kept(responses), schema)
    entities = _kept(entities)
    after = upserted(known, entities)
    source = entities.select("label", "key", "chunk_id", F.lit(model).alias("model"), F.lit(extracted_at).alias("extracted_at"), F.lit(1).alias("pass_number"), F.lit("full").alias("pass_type"))
    return after, upserted_edges(known_edges, edges, after), provenance(source)


def by_dictionary(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """A stand-in for a language model: responses that name the dictionary words (label, key_name, term) a chunk has."""
    words = chunks.select(F.col("id").alias("chunk_id"), "idx", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\d]+)"), 1))).alias("term"))
    hit = words.join(terms, "term")
    found = F.array_sort(F.collect_list(F.struct("term", "label", "key_name")))
    entities = F.transform(found, lambda x: F.struct(x["label"].alias("label"), F.create_map(x["key_name"], x["term"]).alias("properties")))
    return hit.groupBy("chunk_id", "idx").agg(F.to_json(F.struct(entities.alias("entities"))).alias("response"))
