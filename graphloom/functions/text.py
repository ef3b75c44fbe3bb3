"""Scalar text functions, JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip

__all__ = ["strip", "tokens", "token_count", "strip_images", "placeholders", "embedding_text", "clean_key", "text_hash", "suffix_number", "clamp_level", "is_read_only", "settings", "cosine"]

#: What ends a token of the default tokenizer; an explicit class, so that all engines agree.
TOKEN = r"[^ \t\r\n\f]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def strip_images(c: Column) -> Column:
    """Without inline base64 images; a text that is nothing else stays."""
    bare = strip(F.regexp_replace(c, r"!\[[^\]]*\]\(data:image/[^)]*\)", ""))
    return F.when(bare == "", c).otherwise(bare)


def placeholders(c: Column) -> Column:
    """Ids of [IMAGE: id] and [TABLE: id] marks."""
    return F.regexp_extract_all(c, F.lit(r"\[(IMAGE|TABLE): ([^\]]+)\]"), 2)


def data_uri(c: Column) -> Column:
    """struct<mime, data> of a data:<mime>;base64,<data> address; null for anything else."""
    parts = lambda k: F.regexp_extract(c, r"^data:([^;,]+);base64,([A-Za-z0-9+/=]*)$", k)
    return F.when(parts(1) != "", F.struct(parts(1).alias("mime"), F.unbase64(parts(2)).alias("data")))


def embedding_text(*parts: Column) -> Column:
    """Parts with one space between; an empty part leaves its space."""
    return F.trim(reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.coalesce(p, F.lit("")) for p in parts]))


def clean_key(c: Column) -> Column:
    return F.translate(c, " -", "__")


def text_hash(c: Column) -> Column:
    """Twelve digits of the MD5 of the trimmed text in lower case."""
    return F.substring(F.md5(F.lower(strip(c)).cast("binary")), 1, 12)


def suffix_number(c: Column, mark: str) -> Column:
    return F.element_at(F.split(c, mark), -1).try_cast("int")


def clamp_level(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), c))


def is_read_only(c: Column) -> Column:
    """No writing keyword anywhere in a query's text, comments and literals included."""
    return ~c.rlike(r"(?i)\b(MERGE|CREATE|INSERT|SET|DELETE|REMOVE|ADD)\b")


def settings(c: Column) -> Column:
    """KEY=VALUE pairs as a map."""
    pairs = F.regexp_extract_all(c, F.lit(r"(\w+=\S*)"), 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, r"^\w+=", ""))))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
