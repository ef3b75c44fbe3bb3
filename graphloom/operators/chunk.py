"""Chunking: token windows, structured accumulation, by section, by page."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_images, token_count, tokens
from .graph import chain, numbered
from .stream import streamed

PARAGRAPH_GAP = "\n\n"


def ordered_text(rows: DataFrame, keys: list[str], order: str, text: str = "text", gap: str = PARAGRAPH_GAP) -> DataFrame:
    """(keys, text, element_ids): texts of each group joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id").alias("i"), F.col(text).alias("t"))))
    grouped = rows.groupBy(*keys).agg(items.alias("_x"))
    return grouped.select(*keys, F.array_join(F.transform("_x", lambda x: x["t"]), gap).alias("text"), F.transform("_x", lambda x: x["i"]).alias("element_ids"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n tokens; an overlap of the size or more gives the first window only."""
    starts = F.array(F.lit(0)) if overlap >= size else F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def token_windows(texts: DataFrame, size: int = 500, overlap: int = 50, key: str = "document_id") -> DataFrame:
    """(key, idx, text, token_count) of each window over a text's tokens."""
    rows = texts.select(key, tokens(F.col("text")).alias("_t"))
    rows = rows.select(key, "_t", F.posexplode(window_starts(F.size("_t"), size, overlap)).alias("idx", "_s"))
    piece = F.slice("_t", F.col("_s") + 1, size)
    return rows.select(key, "idx", F.array_join(piece, " ").alias("text"), F.size(piece).alias("token_count"))


def by_page(elements: DataFrame) -> DataFrame:
    """One chunk a page, from its non-empty elements in order."""
    rows = elements.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return ordered_text(rows, ["document_id", "page_number"], "seq").withColumn("token_count", token_count(F.col("text")))


def by_section(elements: DataFrame, sections: DataFrame, membership: DataFrame, prepend: bool = True) -> DataFrame:
    """Tables and images of a section as chunks of their own, then its text under its title; what no section has comes
    last as one chunk of the document.

    ``membership``: (element_id, section_id, pos).  Documents without sections are chunked by page.
    """
    rows = elements.withColumn("text", strip(F.col("text"))).where("text <> ''")
    placed = rows.join(membership.select(F.col("element_id").alias("id"), "section_id", "pos"), "id")
    placed = placed.join(sections.select(F.col("id").alias("section_id"), "ordinal", "title"), "section_id")
    special = F.col("type").isin("table", "image")
    own = placed.where(special).select("document_id", "ordinal", F.lit(0).alias("part"), "pos", F.col("type"), strip_images(F.col("text")).alias("text"), F.array("id").alias("element_ids"))
    body = ordered_text(placed.where(~special), ["document_id", "section_id", "ordinal", "title"], "pos")
    head = F.when(F.lit(prepend) & (F.coalesce("title", F.lit("")) != ""), F.concat("title", F.lit(PARAGRAPH_GAP))).otherwise("")
    body = body.select("document_id", "ordinal", F.lit(1).alias("part"), F.lit(0).alias("pos"), F.lit("text").alias("type"), F.concat(head, "text").alias("text"), "element_ids")
    sectioned = sections.select("document_id").distinct()
    loose = rows.join(membership.select(F.col("element_id").alias("id")), "id", "left_anti").join(sectioned, "document_id", "left_semi")
    rest = ordered_text(loose, ["document_id"], "seq").select("document_id", F.lit(1 << 30).alias("ordinal"), F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit("text").alias("type"), "text", "element_ids")
    pages = by_page(elements.join(sectioned, "document_id", "left_anti")).select("document_id", F.col("page_number").alias("ordinal"), F.lit(1).alias("part"), F.lit(0).alias("pos"), F.lit("text").alias("type"), "text", "element_ids")
    out = own.unionByName(body).unionByName(rest).unionByName(pages).withColumn("token_count", token_count(F.col("text")))
    return numbered(out, ["document_id"], ["ordinal", "part", "pos"], F.col("document_id").cast("string"), "_chunk_")


_STRUCTURED = "pos long, kind string, text string, element_ids array<string>, section_heading string, section_context string"


def structured(elements: DataFrame, captions: DataFrame | None = None, size: int = 500) -> DataFrame:
    """Elements gathered in reading order into chunks of up to ``size`` tokens.

    A heading closes a chunk that is half full; a heading at the end of a full chunk moves to the next; an element over
    the size is a chunk of its own; tables and images follow the text, with their caption as context.  Elements run through
    ``Gather`` in order; what is held of a document is one chunk.  ``captions``: (target_id, caption).
    """
    rows = elements.select("document_id", "seq", F.col("id").cast("string").alias("id"), "type", "text", F.lit(None).cast("string").alias("caption"))
    if captions is not None:  # only tables and images look for one
        special = F.coalesce(F.col("type").isin("table", "image"), F.lit(False))
        known = captions.select(F.col("target_id").alias("id"), F.col("caption").alias("_c"))
        captioned = rows.where(special).join(known, "id", "left").withColumn("caption", F.col("_c")).drop("_c")
        rows = rows.where(~special).unionByName(captioned)
    columns = ["id", "type", "text", "caption"]
    found = streamed(rows.select("document_id", "seq", *columns), ["document_id"], ["seq"], columns, lambda: Gather(size), _STRUCTURED)
    found = found.withColumn("token_count", token_count(F.col("text"))).withColumn("_special", F.col("kind") != "text")
    return numbered(found, ["document_id"], ["_special", "pos"], F.col("document_id").cast("string"), "_chunk_").drop("_special", "pos")


_TOKEN = re.compile(r"[^ \t\r\n\f]+")
_IMAGE = re.compile(r"!\[[^\]]*\]\(data:image/[^)]*\)")


class Gather:
    """Structured chunking of one document, an element at a time."""

    def __init__(self, size: int):
        self.size, self.given = size, 0
        self.held: list[tuple[str, str, bool, int]] = []  # id, text, whether a heading, tokens
        self.total = 0
        self.heading = self.at_start = ""

    def _chunk(self, kind: str, text: str, ids: list[str], heading: str, context: str) -> tuple:
        self.given += 1
        return self.given, kind, text, ids, heading, context

    def end(self) -> list[tuple]:
        """Closes the chunk that is held."""
        if not self.held:
            return []
        out = self._chunk("text", PARAGRAPH_GAP.join(x[1] for x in self.held), [x[0] for x in self.held], self.at_start, self.at_start)
        self.held, self.total = [], 0
        return [out]

    def _hold(self, *element) -> None:
        self.held.append(element)
        self.total += element[3]

    def row(self, name: str, kind: str, text: str | None, caption: str | None) -> list[tuple]:
        text = (text or "").strip()
        if kind in ("table", "image"):
            return [self._chunk(kind, _IMAGE.sub("", text).strip() or text, [name], self.heading, caption or self.heading)]
        if not text:
            return []
        out, is_heading, n = [], kind == "heading", len(_TOKEN.findall(text))
        if is_heading:
            self.heading = text
            if self.total >= self.size // 2:
                out += self.end()
        if not self.held:
            self.at_start = self.heading
        if n > self.size:
            out += self.end()
            self.at_start = self.heading
            return [*out, self._chunk("text", text, [name], self.heading, self.heading)]
        if self.held and self.total + n > self.size:
            carried = None
            if len(self.held) > 1 and self.held[-1][2]:
                carried = self.held.pop()
                self.total -= carried[3]
            out += self.end()
            self.at_start = self.heading
            if carried:
                self.heading = self.at_start = carried[1]
                self._hold(*carried)
        self._hold(name, text, is_heading, n)
        return out


def next_chunks(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return chain(chunks, [key], ["idx"], "id")


STRATEGIES = ("token_window", "structured", "by_section", "by_page")


def chunked(strategy: str, elements: DataFrame, sections: DataFrame | None = None, membership: DataFrame | None = None, captions: DataFrame | None = None, size: int = 500, overlap: int = 50) -> DataFrame:
    """Dispatches to a strategy by name."""
    if strategy == "token_window":
        rows = elements.withColumn("text", strip(F.col("text"))).where("text <> '' AND type NOT IN ('table', 'image')")
        return token_windows(ordered_text(rows, ["document_id"], "seq"), size, overlap)
    if strategy == "structured":
        return structured(elements, captions, size)
    if strategy == "by_section":
        return by_section(elements, sections, membership)
    if strategy == "by_page":
        return by_page(elements)
    raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
