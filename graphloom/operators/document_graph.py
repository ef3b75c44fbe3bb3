"""Whole document graphs: building from parsed tables, chunking into, hierarchy, guarded reads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp_level, is_read_only, strip
from . import layout
from .chunk import chunked
from .graph import Graph, chain

# Labels of a layout model, and the element types they stand for.
ELEMENT_TYPES = {
    "title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "table": "table",
    "picture": "image", "figure": "image", "caption": "caption", "footnote": "footnote", "formula": "formula", "code": "code", "document_index": "table_of_contents",
}
FURNITURE = ("page_header", "page_footer")
# Parse modes whose parser brings its own chunks or pages.
CHUNKED_MODES = ("pymupdf", "text_only", "page_image")


def relabelled(items: DataFrame, skip_furniture: bool = True) -> DataFrame:
    """Adds type from a layout label (unknown ones are paragraphs); drops running heads and feet."""
    rows = items.where(~F.coalesce("label", F.lit("")).isin(*FURNITURE)) if skip_furniture else items
    known = F.create_map(*(F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair))
    return rows.withColumn("type", F.coalesce(F.try_element_at(known, F.lower("label")), F.lit("paragraph")))


def interleaved(blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """(document_id, page_number, text): text blocks from top to bottom, with a mark where an image or table stands.

    ``blocks``: document_id, page_number, box, text; ``visuals``: document_id, page_number, box, id, kind.
    """
    mark = F.concat(F.lit("["), F.upper("kind"), F.lit(": "), "id", F.lit("]"))
    text = blocks.select("document_id", "page_number", F.col("box.y0").alias("y"), F.lit(0).alias("k"), F.col("box.x0").alias("x"), "text")
    both = text.unionByName(visuals.select("document_id", "page_number", F.col("box.y0").alias("y"), F.lit(1).alias("k"), F.col("box.x0").alias("x"), mark.alias("text")))
    rows = both.where(strip(F.col("text")) != "")
    items = F.array_sort(F.collect_list(F.struct("y", "k", "x", "text")))
    return rows.groupBy("document_id", "page_number").agg(F.array_join(F.transform(items, lambda i: i["text"]), "\n\n").alias("text"))


#: Elements that a task of ``built`` sorts, about.
ROWS = 200_000


def built(document: DataFrame, page: DataFrame, element: DataFrame) -> Graph:
    """The graph of parsed documents: pages and elements with their chains, captions, and sections from headings.

    ``page``: id, document_id, page_number; ``element``: id, document_id, page_number, seq, type, text, level.
    """
    least = int(element.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-element.count() // ROWS))
    edge = lambda rows, a, b: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), "document_id")
    head = element.where("type = 'heading'")
    section = head.select(F.concat_ws("_sec_", "document_id", "seq").alias("id"), "document_id", F.col("seq").alias("ordinal"), F.col("text").alias("title"), clamp_level(F.coalesce("level", F.lit(1))).alias("level"))
    # Titles are whole lines, and edges have no use for them.
    tree = layout.section_parents(section.drop("title"), tasks=tasks)
    section = layout.section_parents(section, tasks=tasks)
    parent = F.concat_ws("_sec_", "document_id", "parent_ordinal")
    below = tree.where("parent_ordinal is not null").withColumn("parent", parent)
    under = layout.current_section(element.select("document_id", "seq", "id", "type").repartition(tasks, "document_id")).where("section_seq is not null").withColumn("section", F.concat_ws("_sec_", "document_id", "section_seq"))
    at = element.where("type = 'caption'").select("document_id", F.col("seq").alias("caption_seq"), F.col("id").alias("caption"))
    to = element.where("type in ('image', 'table')").select("document_id", F.col("seq").alias("target_seq"), F.col("id").alias("target"))
    captions = layout.captions(element).join(at, ["document_id", "caption_seq"]).join(to, ["document_id", "target_seq"])
    named = lambda seq: F.concat_ws("_sec_", "document_id", seq)
    siblings = layout.next_sections(tree).select(named("src").alias("src"), named("dst").alias("dst"), "document_id")
    doc = lambda rows: rows.withColumn("_d", F.col("document_id"))
    on = ["document_id", "page_number"]
    by_page = element.select(*on, "seq", "id").repartition(tasks, *on)
    pages = page.select(*on, F.col("id").alias("page")).repartition(tasks, *on)
    return Graph(
        {"document": document, "page": page, "element": element, "section": section},
        {
            "HAS_PAGE": edge(doc(page), "_d", "id"),
            "NEXT_PAGE": chain(page.select(*on, "id").repartition(tasks, "document_id"), ["document_id"], ["page_number"]).select("src", "dst", "document_id"),
            "HAS_ELEMENT": edge(by_page.join(pages, on), "page", "id").unionByName(edge(under, "section", "id")),
            "NEXT_ELEMENT": chain(by_page, on, ["seq"]).select("src", "dst", "document_id"),
            "CAPTION_OF": edge(captions, "caption", "target"),
            "HAS_SECTION": edge(doc(tree.where("parent_ordinal is null")), "_d", "id"),
            "HAS_SUBSECTION": edge(below, "parent", "id"),
            "NEXT_SECTION": siblings,
        },
    )


def summary(graph: Graph) -> dict[str, int]:
    """Rows of each table."""
    return {n: t.count() for tables in (graph.nodes, graph.edges) for n, t in tables.items()}


def merged(graph: Graph, more: Graph) -> Graph:
    """Appends another graph's tables."""
    join = lambda a, b: {n: a[n].unionByName(b[n], allowMissingColumns=True) if n in a and n in b else a.get(n, b.get(n)) for n in {**a, **b}}
    return Graph(join(graph.nodes, more.nodes), join(graph.edges, more.edges))


def with_chunks(graph: Graph, strategy: str, clear: bool = False, size: int = 500, overlap: int = 50) -> Graph:
    """Chunks every document; an earlier set stays as an inactive version, or goes if ``clear``.

    Adds PART_OF and NEXT_CHUNK, and CHUNK_ELEMENT from chunks to elements for strategies that know them.
    """
    g, e = graph.nodes, graph.nodes["element"]
    member = layout.current_section(e).where("section_seq is not null").select(F.col("id").alias("element_id"), F.concat_ws("_sec_", "document_id", "section_seq").alias("section_id"), F.col("seq").alias("pos"))
    new = chunked(strategy, e, g.get("section"), member, size=size, overlap=overlap)
    if "idx" not in new.columns:
        new = new.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")) - 1)
    old = None if clear else g.get("chunk")
    last = old.groupBy("document_id").agg(F.max("chunk_set_version").alias("_v")) if old is not None else None
    new = new.join(last, "document_id", "left") if last is not None else new.withColumn("_v", F.lit(None).cast("int"))
    new = new.withColumn("chunk_set_version", F.coalesce("_v", F.lit(0)) + 1)
    number = F.format_string("_cs%d_chunk_%04d", "chunk_set_version", "idx")
    ids = new.columns
    elements = F.col("element_ids") if "element_ids" in ids else F.array().cast("array<string>")
    new = new.select(F.concat(F.col("document_id").cast("string"), number).alias("id"), "document_id", "idx", "text", "token_count", "chunk_set_version", F.lit(True).alias("active"), F.lit(strategy).alias("strategy"), elements.alias("element_ids"))
    names = g["document"].select(F.col("id").alias("document_id"), F.col("name").alias("document_name"))
    new = new.join(names, "document_id", "left")
    every = new if old is None else old.withColumn("active", F.lit(False)).unionByName(new)
    used = new.select(F.col("id").alias("src"), F.explode("element_ids").alias("dst"), "document_id")
    return graph.with_nodes(chunk=every).with_edges(
        PART_OF=every.select(F.col("id").alias("src"), F.col("document_id").alias("dst"), "document_id"),
        NEXT_CHUNK=chain(every, ["document_id", "chunk_set_version"], ["idx"]).select("src", "dst", "document_id"),
        CHUNK_ELEMENT=used,
    )


def with_hierarchy(graph: Graph, levels: DataFrame) -> Graph:
    """Sets section levels (id, level), rebuilds the section tree and gives chunks their section's path as context."""
    section = graph.nodes["section"].drop("parent_ordinal").join(levels.select("id", clamp_level(F.col("level")).alias("_l")), "id", "left")
    section = section.withColumn("level", F.coalesce("_l", "level")).drop("_l")
    paths = layout.heading_paths(section)
    section = paths.drop("path")
    below = section.where("parent_ordinal is not null")
    edges = {
        "HAS_SUBSECTION": below.select(F.concat_ws("_sec_", "document_id", "parent_ordinal").alias("src"), F.col("id").alias("dst"), "document_id"),
        "HAS_SECTION": section.where("parent_ordinal is null").select(F.col("document_id").alias("src"), F.col("id").alias("dst"), "document_id"),
    }
    out = graph.with_nodes(section=section).with_edges(**edges)
    if "chunk" not in graph.nodes:
        return out
    member = layout.current_section(graph.nodes["element"]).where("section_seq is not null").select(F.col("id").alias("element_id"), F.concat_ws("_sec_", "document_id", "section_seq").alias("section_id"))
    chunks = graph.nodes["chunk"].drop("section_context")
    if "section_heading" not in chunks.columns:
        chunks = chunks.withColumn("section_heading", F.lit(""))
    known = layout.chunk_sections(chunks, member, paths.select("document_id", F.col("id").alias("section_id"), "ordinal", "path"))
    return out.with_nodes(chunk=known.withColumnRenamed("section_path", "section_context"))


def read(graph: Graph, sql: str) -> DataFrame:
    """SQL over the graph's tables as views (edges in lower case); text with a writing keyword is refused."""
    spark = next(iter(graph.nodes.values())).sparkSession
    if not spark.range(1).select(is_read_only(F.lit(sql))).first()[0]:
        raise PermissionError("only reading is allowed")
    text, names = sql_views(graph, sql)
    try:
        return spark.sql(text)  # names are resolved here, so the views may go
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def sql_views(graph: Graph, sql: str) -> tuple[str, list[str]]:
    """Registers the tables under names of this call and rewrites ``{table}`` in the text; other braces stay."""
    tag, names = uuid.uuid4().hex[:8], {}
    for name, table in {**graph.nodes, **{k.lower(): v for k, v in graph.edges.items()}}.items():
        names[name] = f"{name}_{tag}"
        table.createOrReplaceTempView(names[name])
    return re.sub(r"\{(\w+)\}", lambda m: names.get(m[1], m[0]), sql), list(names.values())


def needs_chunking(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active documents without a chunk whose parser makes none by itself (parse_mode)."""
    rows = documents.where(F.coalesce("active", F.lit(True)) & ~F.coalesce("parse_mode", F.lit("")).isin(*CHUNKED_MODES))
    return rows.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")


def searchable(properties: list[str], chunks: DataFrame) -> list[str]:
    """The text properties to embed: descriptions come first once any chunk has one."""
    if "text_description" in chunks.columns and not chunks.where("text_description is not null").isEmpty():
        return ["text_description", "text"]
    return properties


def context(document: Column, section: Column) -> Column:
    """'document > section' for an extraction prompt, whichever of them there is."""
    return F.concat_ws(" > ", F.when(document != "", document), F.when(section != "", section))
