"""Queries over documents: versions, elements, sections, chunks, chains, checks.

Lines of a document are its elements: each fifth is a heading with a level of 1 to 3, four make a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_read_only, placeholders, token_count
from ..operators import chunk, graph, layout, verify, versioning
from ..operators.extract import classified, pending
from .registry import query, table

LINES = r"""
WITH lines AS (
  SELECT doc_id AS document_id, i - 1 AS seq, (i - 1) // 4 AS page_number, string_split(text, chr(10))[i] AS text,
         CASE WHEN (i - 1) % 5 = 0 THEN 'heading' WHEN (i - 1) % 7 = 3 THEN 'table' WHEN (i - 1) % 7 = 5 THEN 'caption' ELSE 'paragraph' END AS type,
         CASE WHEN (i - 1) % 5 = 0 THEN (i - 1) // 5 * 7 % 3 + 1 END AS level
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
), elements AS (
  SELECT *, document_id || '_elem_' || seq AS id FROM lines
), sections AS (
  SELECT document_id, seq AS ordinal, text AS title, level FROM elements WHERE type = 'heading'
), windows AS (
  SELECT doc_id AS document_id, regexp_extract_all(text, '[^ \t\r\n\f]+') AS toks,
         unnest(range(0, len(regexp_extract_all(text, '[^ \t\r\n\f]+')), 450)) AS s FROM documents
), chunks AS (
  SELECT document_id, s // 450 AS idx, array_to_string(toks[s + 1 : s + 500], ' ') AS text, len(toks[s + 1 : s + 500]) AS token_count FROM windows
), versions AS (
  SELECT doc_id, source AS source_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version FROM documents
), docs AS (
  SELECT doc_id AS document_id, source_id, version, source_id || '_v' || version AS id,
         version = max(version) OVER (PARTITION BY source_id) AS active FROM versions
)
"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))  # fmt: skip
    s = F.col("seq")
    kind = F.when(s % 5 == 0, "heading").when(s % 7 == 3, "table").when(s % 7 == 5, "caption").otherwise("paragraph")
    level = F.when(s % 5 == 0, F.floor(s / 5).cast("int") * 7 % 3 + 1)
    return lines.withColumns({"page_number": F.floor(s / 4).cast("int"), "type": kind, "level": level, "id": F.concat(F.col("document_id").cast("string"), F.lit("_elem_"), s.cast("string"))})  # fmt: skip


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).where("type = 'heading'")
    return rows.select("document_id", F.col("seq").alias("ordinal"), F.col("text").alias("title"), "level")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunk.token_windows(docs)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return versioning.versioned(rows, "source", "doc_id").withColumnRenamed("doc_id", "document_id")


@query(LINES + "SELECT document_id, source_id, version, id, active FROM docs")
def doc_versions(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", "source_id", "version", "id", "active")


@query(LINES + ", c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), e AS (SELECT document_id, count(*) AS n, count(DISTINCT page_number) AS p FROM elements GROUP BY 1) SELECT source_id, count(*) AS n_versions, sum(coalesce(c.n, 0))::BIGINT AS n_chunks, sum(coalesce(e.n, 0))::BIGINT AS n_elements, sum(coalesce(e.p, 0))::BIGINT AS n_pages, max(version) AS latest FROM docs LEFT JOIN c USING (document_id) LEFT JOIN e USING (document_id) GROUP BY source_id")  # fmt: skip
def list_documents(spark, sf_dir):
    e = elements(spark, sf_dir).select("document_id", "page_number")
    found = verify.totals(documents(spark, sf_dir), chunks=windows(spark, sf_dir).select("document_id"), elements=e, pages=e.distinct())  # fmt: skip
    return found.select("source_id", "n_versions", "n_chunks", "n_elements", "n_pages", "latest")


@query("SELECT source, doc_id AS src, row_number() OVER w AS number, lead(doc_id) OVER w AS dst FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id) QUALIFY dst IS NOT NULL")  # fmt: skip
def source_chain(spark, sf_dir):
    """The documents of a source, linked in order; a source may hold a third of them."""
    return graph.long_chain(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "doc_id")


@query(LINES + "SELECT document_id, idx, text, token_count FROM chunks")
def chunk_token_window(spark, sf_dir):
    return windows(spark, sf_dir)


@query(LINES + "SELECT document_id, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens, avg(token_count) AS mean_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(*) - 1 AS n_next FROM chunks GROUP BY 1")  # fmt: skip
def chunk_stats(spark, sf_dir):
    chunks = windows(spark, sf_dir).select("document_id", "idx", "token_count")
    stats = verify.chunk_statistics(chunks)
    links = graph.chain(chunks.withColumn("id", F.col("idx")), ["document_id"], ["idx"])
    return graph.counted(stats, "document_id", n_next=links)


@query("SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL")  # fmt: skip
def next_chain(spark, sf_dir):
    return graph.chain(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")


@query("SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS head, turn AS position FROM conversations")
def chain_walk(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))  # fmt: skip
    return graph.walk(turns, graph.chain(turns, ["conv_id"], ["turn"])).select("id", "head", F.col("position").cast("long").alias("position"))  # fmt: skip


_CUT = "turn % 3 <> 1"


@query(f"WITH n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) SELECT conv_id, greatest(count(*) - 1, 0) AS gaps FROM n WHERE dst IS NULL OR NOT ({_CUT}) GROUP BY 1")  # fmt: skip
def chain_gaps(spark, sf_dir):
    """Chains from which every third link is cut."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("id"))  # fmt: skip
    kept = graph.chain(turns.where("true"), ["conv_id"], ["turn"])
    kept = kept.where(F.substring_index("src", "_", -1).cast("int") % 3 != 1)
    return verify.chain_gaps(turns, kept, "conv_id")


@query(f"WITH n AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn FROM n WHERE turn < last AND NOT ({_CUT})")  # fmt: skip
def broken_links(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("id"))  # fmt: skip
    kept = graph.chain(turns, ["conv_id"], ["turn"]).where(F.substring_index("src", "_", -1).cast("int") % 3 != 1)
    return graph.broken(turns, kept, "conv_id", "turn").select("conv_id", "turn")


@query(LINES + "SELECT document_id, ordinal, level, (SELECT max(p.ordinal) FROM sections p WHERE p.document_id = c.document_id AND p.ordinal < c.ordinal AND p.level < c.level) AS parent_ordinal FROM sections c")  # fmt: skip
def section_parent(spark, sf_dir):
    return layout.section_parents(sections(spark, sf_dir)).select("document_id", "ordinal", "level", "parent_ordinal")


_DEEP = LINES + """, deep AS (
  SELECT doc_id AS document_id, i - 1 AS ordinal, (i * 7919 + len(string_split(text, chr(10))[i]) * 31) % 40 + 1 AS level
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
)"""  # fmt: skip


@query(_DEEP + "SELECT document_id, ordinal, level, (SELECT max(p.ordinal) FROM deep p WHERE p.document_id = c.document_id AND p.ordinal < c.ordinal AND p.level < c.level) AS parent_ordinal FROM deep c")  # fmt: skip
def deep_parents(spark, sf_dir):
    """Every line a heading, of forty levels."""
    rows = elements(spark, sf_dir).select("document_id", F.col("seq").alias("ordinal"), (((F.col("seq") + 1) * 7919 + F.length("text") * 31) % 40 + 1).alias("level"))  # fmt: skip
    return layout.section_parents(rows)


_TREE = LINES.replace("WITH lines", "WITH RECURSIVE lines") + """, tree AS (
  SELECT *, (SELECT max(p.ordinal) FROM sections p WHERE p.document_id = c.document_id AND p.ordinal < c.ordinal AND p.level < c.level) AS parent_ordinal FROM sections c
)"""  # fmt: skip


@query(_TREE + ", paths AS (SELECT document_id, ordinal, coalesce(nullif(title, ''), '(untitled)') AS path FROM tree WHERE parent_ordinal IS NULL UNION ALL SELECT t.document_id, t.ordinal, p.path || ' > ' || coalesce(nullif(t.title, ''), '(untitled)') FROM paths p JOIN tree t ON t.document_id = p.document_id AND t.parent_ordinal = p.ordinal) SELECT document_id, ordinal, path FROM paths")  # fmt: skip
def heading_path(spark, sf_dir):
    return layout.heading_paths(sections(spark, sf_dir)).select("document_id", "ordinal", "path")


@query(_TREE + "SELECT document_id, ordinal AS src, lead(ordinal) OVER (PARTITION BY document_id, parent_ordinal ORDER BY ordinal) AS dst FROM tree QUALIFY dst IS NOT NULL")  # fmt: skip
def next_section(spark, sf_dir):
    return layout.next_sections(layout.section_parents(sections(spark, sf_dir)))


@query(LINES + "SELECT document_id, seq, (SELECT max(h.ordinal) FROM sections h WHERE h.document_id = e.document_id AND h.ordinal <= e.seq) AS section_seq FROM elements e")  # fmt: skip
def element_section(spark, sf_dir):
    return layout.current_section(elements(spark, sf_dir)).select("document_id", "seq", "section_seq")


@query(LINES + "SELECT c.document_id, c.seq AS caption_seq, t.seq AS target_seq FROM elements c JOIN elements t ON t.document_id = c.document_id AND t.type = 'table' AND abs(t.seq - c.seq) <= 3 WHERE c.type = 'caption' QUALIFY row_number() OVER (PARTITION BY c.document_id, c.seq ORDER BY abs(t.seq - c.seq), t.seq) = 1")  # fmt: skip
def caption_link(spark, sf_dir):
    return layout.captions(elements(spark, sf_dir))


@query(LINES + "SELECT document_id, page_number, string_agg(trim(text), chr(10) || chr(10) ORDER BY seq) AS text, sum(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')))::BIGINT AS token_count FROM elements WHERE trim(text) <> '' GROUP BY 1, 2")  # fmt: skip
def by_page(spark, sf_dir):
    return chunk.by_page(elements(spark, sf_dir)).select("document_id", "page_number", "text", "token_count")


@query(LINES + """, placed AS (
  SELECT e.*, (SELECT max(h.ordinal) FROM sections h WHERE h.document_id = e.document_id AND h.ordinal <= e.seq) AS o FROM elements e WHERE trim(text) <> ''
), parts AS (
  SELECT document_id, o, 0 AS part, seq AS pos, 'table' AS type, trim(text) AS text FROM placed WHERE type = 'table'
  UNION ALL
  SELECT p.document_id, o, 1, 0, 'text', coalesce(nullif(min(s.title), '') || chr(10) || chr(10), '') || string_agg(trim(p.text), chr(10) || chr(10) ORDER BY seq)
  FROM placed p JOIN sections s ON s.document_id = p.document_id AND s.ordinal = o WHERE type <> 'table' GROUP BY 1, 2
)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY o, part, pos) - 1 AS idx, type, text FROM parts""")  # fmt: skip
def by_section(spark, sf_dir):
    e = layout.current_section(elements(spark, sf_dir))
    named = F.concat_ws("_sec_", "document_id", "section_seq")
    member = e.select(F.col("id").alias("element_id"), named.alias("section_id"), F.col("seq").alias("pos"))
    s = sections(spark, sf_dir).withColumn("id", F.concat_ws("_sec_", "document_id", "ordinal"))
    return chunk.by_section(e, s, member).select("document_id", "idx", "type", "text")


#: Structured chunking, an element of each document a step: of the chunk that is open, its number, the heading it began
#: under, its tokens, elements and whether a heading is last (with that heading's text and tokens); ``moved``: the heading
#: before goes with this element.
_STRUCTURED = LINES.replace("WITH lines", "WITH RECURSIVE lines") + r""", cap AS (
  SELECT document_id, target_seq, arg_min(caption, caption_seq) AS caption FROM (
    SELECT c.document_id, c.seq AS caption_seq, c.text AS caption, t.seq AS target_seq FROM elements c JOIN elements t ON t.document_id = c.document_id AND t.type = 'table' AND abs(t.seq - c.seq) <= 3
    WHERE c.type = 'caption' QUALIFY row_number() OVER (PARTITION BY c.document_id, c.seq ORDER BY abs(t.seq - c.seq), t.seq) = 1) GROUP BY ALL
), e AS (
  SELECT elements.document_id, seq, id, type, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, caption,
         len(regexp_extract_all(text, '[^ 	
]+')) AS n, row_number() OVER (PARTITION BY elements.document_id ORDER BY seq) AS i
  FROM elements LEFT JOIN cap ON cap.document_id = elements.document_id AND target_seq = seq
), s AS (
  SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS c, '' AS h, '' AS st, 0::BIGINT AS tot, 0::BIGINT AS cnt, false AS lh, '' AS lt, 0::BIGINT AS ln, false AS moved, 'none' AS put FROM (SELECT DISTINCT document_id FROM e)
  UNION ALL
  SELECT document_id, i, CASE WHEN put = 'over' THEN c2 + 1 ELSE c2 + (put = 'next')::BIGINT END,
         CASE WHEN moved THEN lt ELSE h2 END,
         CASE WHEN put = 'skip' THEN st WHEN moved THEN lt WHEN put IN ('next', 'over') OR cnt2 = 0 THEN h2 ELSE st END,
         CASE put WHEN 'skip' THEN tot WHEN 'over' THEN 0 WHEN 'next' THEN n + CASE WHEN moved THEN ln ELSE 0 END ELSE tot2 + n END,
         CASE put WHEN 'skip' THEN cnt WHEN 'over' THEN 0 WHEN 'next' THEN 1 + moved::BIGINT ELSE cnt2 + 1 END,
         CASE put WHEN 'skip' THEN lh WHEN 'over' THEN false ELSE type = 'heading' END, CASE put WHEN 'skip' THEN lt ELSE text END, CASE put WHEN 'skip' THEN ln ELSE n END, moved,
         CASE WHEN put = 'over' THEN 'over' WHEN put = 'skip' THEN 'skip' ELSE 'in' END
  FROM (
    SELECT *, put = 'next' AND cnt2 > 1 AND lh AS moved FROM (
      SELECT *, CASE WHEN type = 'table' OR text = '' THEN 'skip' WHEN n > 120 THEN 'over' WHEN cnt2 > 0 AND tot2 + n > 120 THEN 'next' ELSE 'in' END AS put,
      FROM (
        SELECT e.document_id, e.i, e.type, e.text, e.n, s.st, s.tot, s.cnt, s.lh, s.lt, s.ln,
               CASE WHEN e.type = 'heading' AND e.text <> '' THEN e.text ELSE s.h END AS h2, close, CASE WHEN close THEN 0 ELSE s.cnt END AS cnt2, CASE WHEN close THEN 0 ELSE s.tot END AS tot2,
               s.c + (close OR (e.n > 120 AND e.type <> 'table' AND e.text <> '' AND s.cnt > 0))::BIGINT AS c2
        FROM s JOIN e ON e.document_id = s.document_id AND e.i = s.i + 1,
             LATERAL (SELECT e.type = 'heading' AND e.text <> '' AND s.tot >= 60 AND s.cnt > 0 AS close) AS x
      )
    )
  )
), put AS (
  SELECT s.document_id, e.seq, e.id, e.text, e.type, e.caption, s.put, s.h, s.st, s.c - (s.put = 'over')::BIGINT AS own, lead(s.moved AND s.put = 'in') OVER w AS goes, lead(s.c) OVER w AS nxt
  FROM s JOIN e ON e.document_id = s.document_id AND e.i = s.i WHERE s.put <> 'skip' WINDOW w AS (PARTITION BY s.document_id ORDER BY s.i)
), txt AS (
  SELECT document_id, CASE WHEN goes THEN nxt ELSE own END AS chunk, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text, list(id ORDER BY seq) AS element_ids,
         arg_max(CASE WHEN goes THEN text ELSE CASE WHEN put = 'over' THEN h ELSE st END END, seq) AS heading
  FROM put GROUP BY 1, 2
), every AS (
  SELECT document_id, 0 AS part, chunk AS pos, 'text' AS kind, text, element_ids, heading AS section_heading, heading AS section_context FROM txt
  UNION ALL
  SELECT s.document_id, 1, e.seq, 'table', e.text, [e.id], s.h, coalesce(nullif(e.caption, ''), s.h) FROM s JOIN e ON e.document_id = s.document_id AND e.i = s.i WHERE e.type = 'table'
)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, pos) - 1 AS idx, kind, text, array_to_string(element_ids, ' ') AS element_ids, section_heading, section_context,
       len(regexp_extract_all(text, '[^ 	
]+')) AS token_count FROM every"""  # fmt: skip


@query(_STRUCTURED)
def chunk_structured(spark, sf_dir):
    e = elements(spark, sf_dir)
    text = e.select(F.col("document_id"), F.col("seq").alias("caption_seq"), F.col("text").alias("caption"))
    caps = layout.captions(e).join(text, ["document_id", "caption_seq"])
    caps = caps.groupBy("document_id", "target_seq").agg(F.min_by("caption", "caption_seq").alias("caption"))
    caps = caps.select(F.concat(F.col("document_id").cast("string"), F.lit("_elem_"), F.col("target_seq").cast("string")).alias("target_id"), "caption")  # fmt: skip
    found = chunk.structured(e, caps, size=120)
    return found.select("document_id", "idx", "kind", "text", F.array_join("element_ids", " ").alias("element_ids"), "section_heading", "section_context", "token_count")  # fmt: skip


@query(LINES + ", n AS (SELECT document_id, substr(md5(lower(trim(text))), 1, 12) AS hash, count(*) AS n FROM elements WHERE length(trim(text)) >= 5 GROUP BY 1, 2), p AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM elements GROUP BY 1) SELECT document_id, hash, n FROM n JOIN p USING (document_id) WHERE pages >= 3 AND n >= 0.5 * pages")  # fmt: skip
def furniture(spark, sf_dir):
    return layout.furniture(elements(spark, sf_dir))


@query(LINES + ", f AS (SELECT document_id, seq, length(text) % 17 AS size FROM elements), m AS (SELECT document_id, list_sort(list(size) FILTER (size > 0)) AS s FROM f GROUP BY 1) SELECT f.document_id, seq, coalesce(size > 1.2 * s[len(s) // 2 + 1], false) AS is_heading FROM f JOIN m USING (document_id)")  # fmt: skip
def heading_heuristic(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumn("font_size_max", (F.length("text") % 17).cast("double"))
    return layout.headings_by_font(rows).select("document_id", "seq", "is_heading")


@query(_TREE + r""", paths AS (
  SELECT document_id, ordinal, coalesce(nullif(title, ''), '(untitled)') AS path FROM tree WHERE parent_ordinal IS NULL
  UNION ALL SELECT t.document_id, t.ordinal, p.path || ' > ' || coalesce(nullif(t.title, ''), '(untitled)') FROM paths p JOIN tree t ON t.document_id = p.document_id AND t.parent_ordinal = p.ordinal
), c AS (
  SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS body, min(seq) FILTER (type = 'heading') AS head, min(seq) AS start FROM elements WHERE trim(text) <> '' GROUP BY 1, 2
), k AS (
  SELECT c.document_id, c.page_number, coalesce(h.text, '') AS heading, c.page_number % 2 = 0 AS linked, (SELECT max(s.ordinal) FROM sections s WHERE s.document_id = c.document_id AND s.ordinal <= start) AS own
  FROM c LEFT JOIN elements h ON h.document_id = c.document_id AND h.seq = head
)
SELECT k.document_id, page_number, coalesce(CASE WHEN linked THEN (SELECT path FROM paths p WHERE p.document_id = k.document_id AND p.ordinal = own) END,
  CASE WHEN heading <> '' THEN (SELECT arg_min(path, ordinal) FROM paths p WHERE p.document_id = k.document_id AND ends_with(path, heading)) END) AS section_path FROM k""")  # fmt: skip
def chunk_section_path(spark, sf_dir):
    """Chunks of pages: even ones know the section of their first element, odd ones only their first heading."""
    e = layout.current_section(elements(spark, sf_dir)).where(F.trim("text") != "")
    name = F.concat_ws("_", "document_id", "page_number")
    chunks = e.groupBy("document_id", "page_number", name.alias("id")).agg(F.min(F.struct("seq", "id"))["id"].alias("first"), F.coalesce(F.min(F.when(F.col("type") == "heading", F.struct("seq", "text")))["text"], F.lit("")).alias("section_heading"))  # fmt: skip
    chunks = chunks.withColumn("element_ids", F.array("first"))
    section = lambda o: F.concat_ws("_sec_", F.col("document_id"), F.col(o))  # noqa: E731
    member = e.where("page_number % 2 = 0 AND section_seq IS NOT NULL").select(F.col("id").alias("element_id"), section("section_seq").alias("section_id"))
    paths = layout.heading_paths(sections(spark, sf_dir)).withColumn("section_id", section("ordinal"))
    return layout.chunk_sections(chunks, member, paths).select("document_id", "page_number", "section_path")


_BLOCKS = """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS block_id, l_quantity AS x0, l_discount * 300 AS y0, l_quantity + 20 AS x1, l_discount * 300 + 10 AS y1 FROM lineitem),
t AS (SELECT l_orderkey AS page, l_linenumber AS table_idx, l_quantity AS x0, l_tax * 300 AS y0, l_quantity + 30 AS x1, l_tax * 300 + 25 AS y1 FROM lineitem) """  # fmt: skip


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_quantity", "l_discount", "l_tax")  # fmt: skip
    box = lambda y, w, h: F.struct(F.col("l_quantity").alias("x0"), (F.col(y) * 300).alias("y0"), (F.col("l_quantity") + w).alias("x1"), (F.col(y) * 300 + h).alias("y1"))  # noqa: E731  # fmt: skip
    blocks = rows.select("page", F.col("l_linenumber").alias("block_id"), box("l_discount", 20, 10).alias("box"))
    tables = rows.select("page", F.col("l_linenumber").alias("table_idx"), box("l_tax", 30, 25).alias("table_box"))
    return blocks, tables


@query(_BLOCKS + ", o AS (SELECT b.page, block_id, table_idx, greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS overlap FROM b JOIN t ON b.page = t.page) SELECT DISTINCT page, block_id, max(round(overlap, 6)) OVER (PARTITION BY page, block_id) AS overlap FROM o WHERE overlap > 0.5")  # fmt: skip
def box_overlap(spark, sf_dir):
    blocks, tables = _boxes(spark, sf_dir)
    found = layout.best_overlap(blocks, tables, ["page"])
    return found.groupBy("page", "block_id").agg(F.max(F.round("overlap", 6)).alias("overlap"))


@query(_BLOCKS + "SELECT page, count(*) AS n FROM (SELECT page, block_id FROM b EXCEPT SELECT b.page, block_id FROM b JOIN t ON (t.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)) GROUP BY page")  # fmt: skip
def boxes_outside(spark, sf_dir):
    blocks, tables = _boxes(spark, sf_dir)
    out = layout.outside_tables(blocks, tables, ["page"]).select("page", "block_id").distinct()
    return out.groupBy("page").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + _BLOCKS.removeprefix("WITH ") + """, i AS (
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY block_id, x0, y0) AS image_idx, x0, y0 FROM b
), g AS (
  SELECT page, image_idx, true AS stays, [{'x': x0, 'y': y0}] AS kept FROM i WHERE image_idx = 1
  UNION ALL
  SELECT i.page, i.image_idx, len(list_filter(g.kept, lambda e: abs(e.x - i.x0) < 5 AND abs(e.y - i.y0) < 5)) = 0,
         CASE WHEN len(list_filter(g.kept, lambda e: abs(e.x - i.x0) < 5 AND abs(e.y - i.y0) < 5)) = 0 THEN list_append(g.kept, {'x': i.x0, 'y': i.y0}) ELSE g.kept END
  FROM g JOIN i ON i.page = g.page AND i.image_idx = g.image_idx + 1
)
SELECT page, image_idx FROM g WHERE stays""")  # fmt: skip
def distinct_images(spark, sf_dir):
    from pyspark.sql import Window

    blocks, _ = _boxes(spark, sf_dir)
    idx = F.row_number().over(Window.partitionBy("page").orderBy("block_id", "box.x0", "box.y0"))
    return layout.distinct_boxes(blocks.withColumn("image_idx", idx), ["page"]).select("page", "image_idx")


@query(LINES + "SELECT id, document_id, CASE WHEN type = 'table' THEN 'TABLE' ELSE 'TEXT' END AS chunk_class, type = 'table' AND seq % 2 = 1 AS needs_vision FROM elements")  # fmt: skip
def classify_chunks(spark, sf_dir):
    rows = elements(spark, sf_dir).withColumns({"labels": F.array(F.lit("Chunk")), "image": F.when(F.col("seq") % 2 == 1, F.lit("x").cast("binary"))})  # fmt: skip
    return classified(rows).select("id", "document_id", "chunk_class", "needs_vision")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return pending(docs, done).select(F.col("id").alias("doc_id"), "source")


@query(LINES + "SELECT document_id, id, CASE WHEN source_id = 'src3' THEN version = 2 ELSE active END AS active FROM docs")  # fmt: skip
def activate_version(spark, sf_dir):
    return versioning.activated(documents(spark, sf_dir), "src3_v2").select("document_id", "id", "active")


@query(LINES + ", gone AS (SELECT document_id FROM docs WHERE NOT active AND source_id = 'src5') SELECT 'document' AS label, count(*) AS n FROM gone UNION ALL SELECT 'element', count(*) FROM elements JOIN gone USING (document_id) UNION ALL SELECT 'section', count(*) FROM sections JOIN gone USING (document_id) UNION ALL SELECT 'chunk', count(*) FROM chunks JOIN gone USING (document_id)")  # fmt: skip
def cascade_delete_counts(spark, sf_dir):
    """Cleaning the inactive versions of one source."""
    docs = documents(spark, sf_dir)
    ids = docs.select(F.col("id").alias("_d"), "document_id")
    part = lambda rows: rows.join(ids, "document_id").drop("document_id").withColumnRenamed("_d", "document_id")  # noqa: E731  # fmt: skip
    tables = {"document": docs, "element": part(elements(spark, sf_dir)), "section": part(sections(spark, sf_dir)), "chunk": part(windows(spark, sf_dir))}  # fmt: skip
    return versioning.cleaned(tables, source_id="src5")[1]


@query(LINES + ", used AS (SELECT document_id, seq FROM elements WHERE page_number % 3 <> 1) SELECT document_id, seq FROM elements e WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.document_id = e.document_id AND u.seq = e.seq)")  # fmt: skip
def orphans(spark, sf_dir):
    """Elements left over when every third page has no chunk."""
    e = elements(spark, sf_dir)
    chunks = chunk.by_page(e.where("page_number % 3 <> 1"))
    return verify.orphans(e, chunks).select("document_id", "seq")


@query(LINES + "SELECT document_id, string_agg(CASE WHEN type = 'heading' THEN repeat('#', level::INT) || ' ' ELSE '' END || text, chr(10) || chr(10) ORDER BY seq) AS text FROM elements WHERE type = 'heading' OR text <> '' GROUP BY 1")  # fmt: skip
def reconstruct_markdown(spark, sf_dir):
    return verify.markdown(elements(spark, sf_dir))


@query(LINES + "SELECT document_id, string_agg('--- chunk ' || idx || ' (' || token_count || ' tokens) ---' || chr(10) || text, chr(10) || chr(10) ORDER BY idx) AS text FROM chunks GROUP BY 1")  # fmt: skip
def reconstruct_chunks(spark, sf_dir):
    rows = windows(spark, sf_dir).withColumn("id", F.col("idx").cast("string"))
    return verify.rejoined(rows)


@query("SELECT item_id, text, NOT regexp_matches(upper(text), '\\b(MERGE|CREATE|INSERT|SET|DELETE|REMOVE|ADD)\\b') AS read_only FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'match (n) return n -- ' || text WHEN 1 THEN 'Create x ' || text WHEN 2 THEN 'resets ' || text ELSE 'SELECT ''set'' ' || text END AS text FROM benchmark)")  # fmt: skip
def readonly_gate(spark, sf_dir):
    k = F.col("item_id") % 4
    head = F.when(k == 0, "match (n) return n -- ").when(k == 1, "Create x ").when(k == 2, "resets ").otherwise("SELECT 'set' ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(head, "text").alias("text"))
    return rows.withColumn("read_only", is_read_only(F.col("text")))


@query("WITH t AS (SELECT doc_id, 'see [IMAGE: img_' || doc_id % 7 || '] and [TABLE: tab_' || doc_id % 5 || '] [OTHER: x] ' AS text FROM documents), i AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[(IMAGE|TABLE): ([^\\]]+)\\]', 2)) AS visual FROM t) SELECT doc_id, visual FROM i WHERE visual IN (SELECT DISTINCT 'img_' || doc_id % 6 FROM documents UNION SELECT DISTINCT 'tab_' || doc_id % 4 FROM documents)")  # fmt: skip
def placeholder_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    mark = lambda kind, name, k: F.concat(F.lit(f"[{kind}: {name}_"), (F.col("doc_id") % k).cast("string"), F.lit("]"))  # noqa: E731  # fmt: skip
    text = F.concat(F.lit("see "), mark("IMAGE", "img", 7), F.lit(" and "), mark("TABLE", "tab", 5), F.lit(" [OTHER: x] "))  # fmt: skip
    found = docs.select("doc_id", F.explode(placeholders(text)).alias("id"))
    visual = lambda name, k: docs.select(F.concat(F.lit(f"{name}_"), (F.col("doc_id") % k).cast("string")).alias("id")).distinct()  # noqa: E731  # fmt: skip
    return graph.lookup(found, visual("img", 6), visual("tab", 4)).select("doc_id", F.col("id").alias("visual"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) AS n FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n"))
