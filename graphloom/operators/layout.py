"""Layout joins: reading order, headings and sections, captions, boxes, furniture."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, text_hash
from .stream import streamed

class _Headings:
    """The open headings of a document, levels ascending: once those as low or lower are closed, the top one is the nearest
    of a higher rank."""

    def __init__(self):
        self.open: list[tuple[int, int, str]] = []  # level, ordinal, path

    def row(self, ordinal, level, title, *rest):
        title = title or "(untitled)"
        while level is not None and self.open and self.open[-1][0] >= level:
            self.open.pop()
        above = self.open[-1] if self.open and level is not None else (None, None, None)
        path = f"{above[2]} > {title}" if above[2] is not None else title
        if level is not None:
            self.open.append((level, ordinal, path))
        return [(*rest, above[1], path)]

    def end(self):
        return []


def heading_paths(sections: DataFrame, doc: str = "document_id", ordinal: str = "ordinal", level: str = "level", title: str = "title", tasks: int | None = None) -> DataFrame:
    """Adds parent_ordinal, the nearest section before with a lower level (null for roots), and path: titles from the root
    down, with ' > ' between; a missing title is (untitled).

    Levels are any numbers.  One pass in the order of the document; what is held are the open headings, at most one of a
    level.  A section without a level is a root and nobody's parent.
    """
    kind = lambda c: sections.schema[c].dataType.simpleString()
    rest = [c for c in sections.columns if c not in (doc, ordinal)]
    named = [F.col(doc), F.col(ordinal), *(F.col(c).alias(f"_{c}") for c in rest)]
    schema = ", ".join([f"`{ordinal}` {kind(ordinal)}", *(f"`{c}` {kind(c)}" for c in rest), f"parent_ordinal {kind(ordinal)}", "path string"])
    fed = [ordinal, f"_{level}", f"_{title}", ordinal, *(f"_{c}" for c in rest)]
    return streamed(sections.select(*named), [doc], [ordinal], fed, _Headings, schema, tasks).select(*sections.columns, "parent_ordinal", "path")


def section_parents(sections: DataFrame, doc: str = "document_id", ordinal: str = "ordinal", level: str = "level", tasks: int | None = None) -> DataFrame:
    """Adds parent_ordinal: the nearest section before with a lower level (null for roots), see ``heading_paths``."""
    return heading_paths(sections.withColumn("_title", F.lit("")), doc, ordinal, level, "_title", tasks).drop("_title", "path")


def next_sections(sections: DataFrame, doc: str = "document_id") -> DataFrame:
    """(document, src, dst): chains among roots and among each parent's children; needs parent_ordinal."""
    w = Window.partitionBy(doc, "parent_ordinal").orderBy("ordinal")
    return sections.select(doc, F.col("ordinal").alias("src"), F.lead("ordinal").over(w).alias("dst")).where("dst is not null")


def current_section(elements: DataFrame, doc: str = "document_id") -> DataFrame:
    """Adds section_seq: the seq of the heading an element stands under; a heading stands under itself."""
    upto = Window.partitionBy(doc).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("section_seq", F.last(F.when(F.col("type") == "heading", F.col("seq")), ignorenulls=True).over(upto))


def captions(elements: DataFrame, reach: int = 3, doc: str = "document_id", kinds: tuple[str, ...] = ("image", "table")) -> DataFrame:
    """(document, caption_seq, target_seq): each caption's nearest figure or table within ``reach`` places; ties go to
    the earlier one.  A band join on the place: each target is put at every place it can serve."""
    target = elements.where(F.col("type").isin(*kinds)).select(doc, F.col("seq").alias("target_seq"))
    target = target.withColumn("caption_seq", F.explode(F.sequence(F.col("target_seq") - reach, F.col("target_seq") + reach)))
    rows = elements.where("type = 'caption'").select(doc, F.col("seq").alias("caption_seq")).join(target, [doc, "caption_seq"])
    best = F.min(F.struct(F.abs(F.col("caption_seq") - F.col("target_seq")).alias("d"), "target_seq")).alias("b")
    return rows.groupBy(doc, "caption_seq").agg(best).select(doc, "caption_seq", F.col("b.target_seq").alias("target_seq"))


def _area(box: str, other: str) -> Column:
    side = lambda p: F.greatest(F.lit(0.0), F.least(f"{box}.{p}1", f"{other}.{p}1") - F.greatest(f"{box}.{p}0", f"{other}.{p}0"))
    return side("x") * side("y")


def inside(points: DataFrame, tables: DataFrame, page: list[str], box: str = "table_box") -> DataFrame:
    """Points (x, y) joined with the table boxes of their page that hold them (borders count), each pair once.

    A table lies in a grid whose cells are as wide as its longer side, rounded up to a power of two, so in four cells at
    most; a point looks into one cell for each such width that its page has.  Equi-joins on page and cell take the place of
    all pairs of a page, and a page with very many boxes is spread over tasks.
    """
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_level")).cast("long")
    side = F.greatest(F.col(f"{box}.x1") - F.col(f"{box}.x0"), F.col(f"{box}.y1") - F.col(f"{box}.y0"), F.lit(1e-6))
    placed = tables.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    widths = placed.select(*page, "_level").distinct()
    for c in ("x", "y"):
        placed = placed.withColumn(f"_{c}", F.explode(F.sequence(at(f"{box}.{c}0"), at(f"{box}.{c}1"))))
    rows = points.join(widths, page).withColumns({"_x": at("x"), "_y": at("y")})
    found = rows.join(placed, [*page, "_level", "_x", "_y"])
    held = F.col("x").between(F.col(f"{box}.x0"), F.col(f"{box}.x1")) & F.col("y").between(F.col(f"{box}.y0"), F.col(f"{box}.y1"))
    return found.where(held).drop("_level", "_x", "_y")


def best_overlap(blocks: DataFrame, tables: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """(page, block_id, table_idx, overlap): the table that covers most of a block, if over ``least`` of its area; the
    first wins ties.  ``blocks`` have block_id and box, ``tables`` table_idx and table_box; ``least`` is 0.05 or more.

    A box that covers more than a share of a block covers more than that share of each side, and so one of the points that
    lie that share apart; for a half this is the centre.  Only tables that hold such a point are compared.
    """
    if not 0.05 <= least < 1:
        raise ValueError("least is from 0.05 to below 1")
    steps = [least * k for k in range(1, math.ceil(1 / least))] or [least]
    side = lambda p, q: F.col(f"box.{p}0") + q * (F.col(f"box.{p}1") - F.col(f"box.{p}0"))
    spots = F.explode(F.array(*(F.struct(side("x", q).alias("x"), side("y", r).alias("y")) for q in steps for r in steps)))
    points = blocks.select(*page, "block_id", "box", spots.alias("_s")).select(*page, "block_id", "box", "_s.x", "_s.y")
    size = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    # A trifle wider, as areas are rounded too; the overlap itself decides.
    wider = lambda c, sign: (F.col(f"table_box.{c}") + sign * 1e-9 * (1 + F.abs(F.col(f"table_box.{c}")))).alias(c)
    wide = tables.select(*page, "table_idx", "table_box", F.struct(wider("x0", -1), wider("y0", -1), wider("x1", 1), wider("y1", 1)).alias("_wide"))
    rows = inside(points, wide, page, "_wide").withColumn("overlap", F.when(size > 0, _area("box", "table_box") / size).otherwise(F.lit(0.0)))
    best = F.max(F.struct("overlap", (-F.col("table_idx")).alias("i"))).alias("b")
    return rows.where(F.col("overlap") > least).groupBy(*page, "block_id").agg(best).select(*page, "block_id", (-F.col("b.i")).alias("table_idx"), F.col("b.overlap").alias("overlap"))


def outside_tables(blocks: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Blocks whose centre lies in no table box of their page (borders count as inside)."""
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    hit = inside(blocks.select(*page, "block_id", x.alias("x"), y.alias("y")), tables.select(*page, "table_box"), page)
    return blocks.join(hit.select(*page, "block_id").distinct(), [*page, "block_id"], "left_anti")


class _Corners:
    """Corners of the images of a page that stay, by cells as wide as ``near``."""

    def __init__(self, near: float):
        self.near = near
        self.cells: dict[tuple[int, int], list[tuple[float, float]]] = {}

    def row(self, idx, x, y):
        if x is not None and y is not None:
            cx, cy = int(x // self.near), int(y // self.near)
            around = (c for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1) for c in self.cells.get((i, j), ()))
            if any(abs(a - x) < self.near and abs(b - y) < self.near for a, b in around):
                return [(idx,)]
            self.cells.setdefault((cx, cy), []).append((x, y))
        return []

    def end(self):
        return []


def distinct_boxes(images: DataFrame, page: list[str], near: float = 5.0) -> DataFrame:
    """Drops an image whose corner is within ``near`` of an earlier image of its page that stays, in both directions.

    One pass over each page in the order of image_idx; what is held are the corners that stay (no two of them near, so a
    cell holds four at most).  Images without a corner stay.
    """
    rows = images.select(*page, "image_idx", F.col("box.x0").alias("_x"), F.col("box.y0").alias("_y"))
    kind = images.schema["image_idx"].dataType.simpleString()
    gone = streamed(rows, page, ["image_idx"], ["image_idx", "_x", "_y"], lambda: _Corners(near), f"image_idx {kind}")
    return images.join(gone, [*page, "image_idx"], "left_anti")


def real_tables(tables: DataFrame, least: int = 2) -> DataFrame:
    """Without tables that have both fewer than ``least`` rows and fewer than ``least`` columns (n_rows, n_columns)."""
    return tables.where((F.col("n_rows") >= least) | (F.col("n_columns") >= least))


def large_enough(boxes: DataFrame, least: float = 30.0) -> DataFrame:
    return boxes.where((F.col("box.x1") - F.col("box.x0") >= least) & (F.col("box.y1") - F.col("box.y0") >= least))


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Adds seq by top, then left edge, then input position."""
    return blocks.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy("box.y0", "box.x0", "position")) - 1)


def furniture(blocks: DataFrame, doc: str = "document_id", share: float = 0.5, pages: int = 3, length: int = 5) -> DataFrame:
    """(document, hash, n): texts that recur on at least ``share`` as many blocks as the document has pages, with
    ``pages`` pages at least and ``length`` characters at least: running heads and feet."""
    rows = blocks.withColumn("_t", strip(F.col("text"))).where(F.length("_t") >= length)
    total = blocks.groupBy(doc).agg(F.countDistinct("page_number").alias("_pages")).where(F.col("_pages") >= pages)
    n = rows.groupBy(doc, text_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"))
    return n.join(total, doc).where(F.col("n") >= share * F.col("_pages")).select(doc, "hash", "n")


def without_furniture(blocks: DataFrame, doc: str = "document_id", **how) -> DataFrame:
    found = furniture(blocks, doc, **how).select(doc, F.col("hash").alias("_h"))
    return blocks.withColumn("_h", text_hash(F.col("text"))).join(found, [doc, "_h"], "left_anti").drop("_h")


def headings_by_font(blocks: DataFrame, doc: str = "document_id", ratio: float = 1.2) -> DataFrame:
    """Adds is_heading: a font over ``ratio`` times the document's median (the upper middle of positive sizes).

    The median is found by running counts over the distinct sizes of a document, which are few."""
    sizes = blocks.where("font_size_max > 0").groupBy(doc, "font_size_max").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(doc)
    upto = F.sum("_n").over(own.orderBy("font_size_max"))
    middle = F.floor(F.sum("_n").over(own) / 2)  # place of the median, from 0
    sizes = sizes.withColumns({"_upto": upto, "_middle": middle}).where("_upto > _middle AND _upto - _n <= _middle")
    median = sizes.select(doc, F.col("font_size_max").alias("median_font"))
    return blocks.join(median, doc, "left").withColumn("is_heading", F.coalesce(F.col("font_size_max") > ratio * F.col("median_font"), F.lit(False)))


def chunk_sections(chunks: DataFrame, membership: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds section_path to chunks (id, document_id, element_ids, section_heading): the path of the first element with a
    section, else the first path of the document that ends with the chunk's heading.

    ``membership``: (element_id, section_id); ``paths``: (document_id, section_id, ordinal, path).
    """
    at = chunks.select("id", F.posexplode("element_ids").alias("_pos", "element_id")).join(membership, "element_id")
    first = at.groupBy("id").agg(F.min_by("section_id", "_pos").alias("section_id"))
    known = first.join(paths.select("section_id", F.col("path").alias("_p")), "section_id").select("id", "_p")
    rows = chunks.join(known, "id", "left")
    other = rows.where("_p is null and section_heading <> ''").select("id", "document_id", "section_heading")
    # An equi-join on ends of paths, of the lengths that the document's headings have.
    other = other.withColumn("_end", F.xxhash64("section_heading"))
    lengths = other.select("document_id", F.length("section_heading").alias("_l")).distinct()
    ends = paths.select("document_id", "ordinal", "path").join(lengths, "document_id").where(F.col("_l") <= F.length("path"))
    ends = ends.withColumn("_tail", F.expr("right(path, _l)")).withColumn("_end", F.xxhash64("_tail"))
    firsts = ends.groupBy("document_id", "_end", "_tail").agg(F.min_by("path", "ordinal").alias("_q"))
    other = other.join(firsts, ["document_id", "_end"]).where(F.col("_tail") == F.col("section_heading")).select("id", "_q")
    return rows.join(other, "id", "left").withColumn("section_path", F.coalesce("_p", "_q")).drop("_p", "_q")
