"""What Spark cannot supply: interfaces, with stand-ins where something offline is of use."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Parser(Protocol):
    """PDF files (path, content) to tables of documents, pages, elements and sections."""

    def parse(self, files: DataFrame, **how) -> dict[str, DataFrame]: ...


class Embedder(Protocol):
    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Extractor(Protocol):
    """Chunks (id, idx, text) to responses (chunk_id, idx, response JSON)."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


class Describer(Protocol):
    def __call__(self, rows: pd.DataFrame) -> pd.Series: ...


class TextOnlyParser:
    """A stand-in: rows (document_id, page_number, text) that are parsed already, one paragraph a page."""

    def parse(self, files: DataFrame, **how) -> dict[str, DataFrame]:
        from pyspark.sql import functions as F

        element = files.select(F.concat_ws("_elem_", "document_id", "page_number").alias("id"), "document_id", "page_number", F.col("page_number").alias("seq"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("int").alias("level"))
        page = files.select(F.concat_ws("_page_", "document_id", "page_number").alias("id"), "document_id", "page_number", "text")
        return {"page": page, "element": element.where("text <> ''")}


def word_table(label_of: dict[str, str], key_name: str = "name") -> list[tuple[str, str, str]]:
    """Rows (label, key_name, term) for the dictionary extractor."""
    return [(label, key_name, term) for term, label in label_of.items()]
