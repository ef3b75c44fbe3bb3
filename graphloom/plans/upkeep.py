"""Queries that keep a graph: building it, hierarchies, cleaning, deletion, what is left to describe and to embed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, document_graph, graph, layout, retrieval, upsert, versioning, visuals
from .documents import LINES, documents, elements, windows
from .registry import query, table

_MODES = {"all": "TRUE", "source": "source_id = 'src5'", "document": "id = 'src7_v1'"}


@query(LINES + " UNION ALL ".join(f"(WITH gone AS (SELECT document_id FROM docs WHERE NOT active AND {test}) SELECT '{mode}' AS mode, 'document' AS label, count(*) AS n FROM gone UNION ALL SELECT '{mode}', 'element', count(*) FROM elements JOIN gone USING (document_id) UNION ALL SELECT '{mode}', 'chunk', count(*) FROM chunks JOIN gone USING (document_id))" for mode, test in _MODES.items()))
def clean_modes(spark, sf_dir):
    """Cleaning inactive documents: all, those of a source, one of them."""
    docs = documents(spark, sf_dir)
    ids = docs.select(F.col("id").alias("_d"), "document_id")
    part = lambda rows: rows.join(ids, "document_id").drop("document_id").withColumnRenamed("_d", "document_id")
    tables = {"document": docs, "element": part(elements(spark, sf_dir).select("document_id")), "chunk": part(windows(spark, sf_dir).select("document_id"))}
    modes = {"all": {}, "source": {"source_id": "src5"}, "document": {"document_id": "src7_v1"}}
    found = [versioning.cleaned(tables, **how)[1].select(F.lit(mode).alias("mode"), "label", "n") for mode, how in modes.items()]
    return reduce(DataFrame.unionByName, found)


@query(LINES + "SELECT document_id, id, active AND source_id <> 'src2' AS active, (SELECT count(*) FROM docs WHERE active AND source_id = 'src2') AS deactivated FROM docs")
def deactivate_documents(spark, sf_dir):
    rows, n = versioning.deactivated(documents(spark, sf_dir), F.col("source_id") == "src2")
    return rows.select("document_id", "id", "active").crossJoin(F.broadcast(n))  # n is one row


@query(LINES + ", kept AS (SELECT document_id, idx FROM chunks WHERE (document_id + idx) % 5 <> 2) SELECT a.document_id, a.idx AS src, b.idx AS dst FROM kept a JOIN kept b ON a.document_id = b.document_id AND b.idx = a.idx + 1")
def delete_chunks(spark, sf_dir):
    """NEXT edges that are left when inactive chunks (every fifth) go: none dangles."""
    name = F.concat_ws("_", "document_id", "idx")
    rows = windows(spark, sf_dir).select("document_id", "idx", name.alias("id"), ((F.col("document_id") + F.col("idx")) % 5 != 2).alias("active"))
    _, edges = versioning.without_chunks(rows, graph.chain(rows, ["document_id"], ["idx"]), only_inactive=True)
    number = lambda end: F.substring_index(end, "_", -1).cast("int").alias(end)
    return edges.select("document_id", number("src"), number("dst"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return graph.repeated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_returnflag AS label, count(DISTINCT l_partkey) AS n_entities, count(DISTINCT o_custkey) AS n_documents FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def documents_by_entity(spark, sf_dir):
    """Parts are mentioned by orders, orders belong to customers."""
    source = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("chunk_id"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
    return analytics.documents_by_entity(source, chunks)


@query("SELECT l_returnflag AS label, l_partkey::VARCHAR AS key, l_suppkey AS chunk_id, arg_max('run' || l_linenumber, l_orderkey * 10 + l_linenumber) AS model FROM lineitem GROUP BY 1, 2, 3")
def provenance_latest(spark, sf_dir):
    """Of each entity and chunk the latest run."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_partkey").cast("string").alias("key"), F.col("l_suppkey").alias("chunk_id"), F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("extracted_at"), F.lit(1).alias("pass_number"), F.lit("full").alias("pass_type"))
    return upsert.provenance(rows).select("label", "key", "chunk_id", "model")


@query(LINES + ", c AS (SELECT document_id, seq, id, text, CASE WHEN seq % 4 = 1 THEN 'about ' || seq END AS about, seq % 3 = 0 AS done, seq % 7 <> 6 AS active FROM elements) SELECT document_id, seq, trim(coalesce(about, '') || ' ' || coalesce(text, '')) AS input FROM c WHERE NOT done AND active AND coalesce(about, text) IS NOT NULL")
def to_embed(spark, sf_dir):
    """Active chunks without an embedding, and the text to embed."""
    s = F.col("seq")
    rows = elements(spark, sf_dir).withColumns({"text_description": F.when(s % 4 == 1, F.concat(F.lit("about "), s.cast("string"))), "text_embedding": F.when(s % 3 == 0, F.array(F.lit(1.0))), "active": s % 7 != 6, "document_name": F.lit("")})
    found = retrieval.to_embed(rows, ["text_description", "text"])
    return found.select("document_id", "seq", F.col("embedding_input").alias("input"))


@query(LINES + "SELECT 'table' AS kind, id FROM elements WHERE type = 'table' AND seq % 2 = 1 AND seq % 10 <> 3 UNION ALL SELECT 'page', document_id || '_page_' || page_number FROM elements GROUP BY document_id, page_number HAVING page_number % 2 = 0")
def to_describe(spark, sf_dir):
    """Tables and pages that have an image and no description yet."""
    image = lambda test: F.when(test, F.lit("x").cast("binary")).alias("image")
    e, s = elements(spark, sf_dir), F.col("seq")
    tables = e.where("type = 'table'").select("id", F.lit("table").alias("kind"), image(s % 2 == 1), "text", F.when(s % 10 == 3, "known").alias("text_description"))
    name = F.concat(F.col("document_id").cast("string"), F.lit("_page_"), F.col("page_number").cast("string"))
    pages = e.select("document_id", "page_number").distinct().select(name.alias("id"), F.lit("page").alias("kind"), image(F.col("page_number") % 2 == 0), F.lit("").alias("text"), F.lit(None).cast("string").alias("text_description"))
    return visuals.to_describe(tables, pages).select("kind", "id")


def _graph(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    page = e.select("document_id", "page_number").distinct().withColumn("id", F.concat_ws("_page_", "document_id", "page_number"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("name "), F.col("doc_id").cast("string")).alias("name"))
    return document_graph.built(docs, page, e)


_EDGES = """, page AS (SELECT DISTINCT document_id, page_number FROM elements
), tree AS (SELECT *, (SELECT max(p.ordinal) FROM sections p WHERE p.document_id = c.document_id AND p.ordinal < c.ordinal AND p.level < c.level) AS up FROM sections c
), under AS (SELECT e.document_id, e.seq FROM elements e WHERE EXISTS (SELECT 1 FROM sections s WHERE s.document_id = e.document_id AND s.ordinal <= e.seq)
), cap AS (SELECT c.document_id, c.seq FROM elements c WHERE c.type = 'caption' AND EXISTS (SELECT 1 FROM elements t WHERE t.document_id = c.document_id AND t.type = 'table' AND abs(t.seq - c.seq) <= 3)
), next_page AS (SELECT lead(page_number) OVER (PARTITION BY document_id ORDER BY page_number) AS n FROM page
), next_element AS (SELECT lead(seq) OVER (PARTITION BY document_id, page_number ORDER BY seq) AS n FROM elements
), next_section AS (SELECT lead(ordinal) OVER (PARTITION BY document_id, up ORDER BY ordinal) AS n FROM tree
)"""


@query(LINES + _EDGES + """ SELECT 'HAS_PAGE' AS type, count(*) AS n FROM page UNION ALL SELECT 'NEXT_PAGE', count(n) FROM next_page UNION ALL SELECT 'HAS_ELEMENT', (SELECT count(*) FROM elements) + (SELECT count(*) FROM under)
UNION ALL SELECT 'NEXT_ELEMENT', count(n) FROM next_element UNION ALL SELECT 'CAPTION_OF', count(*) FROM cap UNION ALL SELECT 'HAS_SECTION', count(*) FROM tree WHERE up IS NULL
UNION ALL SELECT 'HAS_SUBSECTION', count(*) FROM tree WHERE up IS NOT NULL UNION ALL SELECT 'NEXT_SECTION', count(n) FROM next_section""")  # fmt: skip
def graph_edges(spark, sf_dir):
    """The graph of all documents: how many relationships it has of each type."""
    g = _graph(spark, sf_dir)
    return graph.histogram(g.of_types(*g.edges), "type")


@query(LINES.replace("WITH lines", "WITH RECURSIVE lines") + r""", sec AS (SELECT document_id, ordinal, title, CASE WHEN ordinal % 3 = 1 THEN 1 + ordinal % 4 ELSE level END AS level FROM sections
), tree AS (SELECT *, (SELECT max(p.ordinal) FROM sec p WHERE p.document_id = c.document_id AND p.ordinal < c.ordinal AND p.level < c.level) AS up FROM sec c
), paths AS (
  SELECT document_id, ordinal, coalesce(nullif(title, ''), '(untitled)') AS path FROM tree WHERE up IS NULL
  UNION ALL SELECT t.document_id, t.ordinal, p.path || ' > ' || coalesce(nullif(t.title, ''), '(untitled)') FROM paths p JOIN tree t ON t.document_id = p.document_id AND t.up = p.ordinal
), first AS (SELECT document_id, page_number, min(seq) AS seq FROM elements WHERE trim(text) <> '' GROUP BY 1, 2
), idx AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS idx, (SELECT max(s.ordinal) FROM sections s WHERE s.document_id = first.document_id AND s.ordinal <= first.seq) AS own FROM first
) SELECT idx.document_id::VARCHAR AS document_id, idx, path AS section_context, 'name ' || idx.document_id AS document_name FROM idx JOIN paths ON paths.document_id = idx.document_id AND paths.ordinal = own""")  # fmt: skip
def hierarchy_context(spark, sf_dir):
    """Documents chunked by page; given new levels, the tree of sections is rebuilt and chunks get their path."""
    g = document_graph.with_chunks(_graph(spark, sf_dir), "by_page")
    at = F.col("ordinal")
    levels = g.nodes["section"].where(at % 3 == 1).select("id", (1 + at % 4).cast("int").alias("level"))
    chunks = document_graph.with_hierarchy(g, levels).nodes["chunk"]
    return chunks.select("document_id", "idx", "section_context", "document_name")


@query("WITH b AS (SELECT l_orderkey AS page, l_linenumber, l_quantity AS x, l_discount * 300 AS y FROM lineitem) SELECT page, l_linenumber, row_number() OVER (PARTITION BY page ORDER BY y, x, l_linenumber) - 1 AS seq FROM b")
def reading_order(spark, sf_dir):
    box = F.struct(F.col("l_quantity").alias("x0"), (F.col("l_discount") * 300).alias("y0")).alias("box")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.col("l_linenumber").alias("position"), box)
    return layout.reading_order(rows, ["page"]).select("page", "l_linenumber", "seq")


@query(LINES + ", v AS (SELECT document_id, source_id, (document_id % 3) <> 0 AS on_ FROM docs) SELECT document_id, idx FROM chunks JOIN v USING (document_id) WHERE on_ AND (idx % 2 = 0)")
def effective_chunks(spark, sf_dir):
    """Chunks that are active and whose document is."""
    chunks = windows(spark, sf_dir).select("document_id", "idx", (F.col("idx") % 2 == 0).alias("active"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 != 0).alias("active"))
    return versioning.effective_active(chunks, docs).select("document_id", "idx")
