"""Exact deduplication by content-defined chunk recipes.

A text is normalised, cut into chunks where a rolling hash of its own bytes says so, and becomes the ordered list of
its chunks' 64-bit identifiers.  Identifiers are verified against the chunks' SHA-256; an identifier that stands for
two contents is told apart by them.  Equal texts are equal lists, so only lists are shuffled and compared: a long
document is read once and never moves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import in_arrow, written

#: Bytes of a chunk, least and most; a cut is expected every 2 ** CUT_BITS bytes after the least.
LEAST, MOST, CUT_BITS, WINDOW = 2048, 16384, 11, 32
_GEAR = (K.mix(np.arange(256, dtype=np.uint64), 7) >> np.uint64(32)).astype(np.uint32)


def cuts(buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row the ends of its chunks.  A cut depends on the WINDOW bytes before it and the cut before."""
    h, width = _GEAR[buf], 1
    while width < WINDOW:  # h[i]: sum over the last 2 * width bytes of gear << age
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while b - a > LEAST:
            k = np.searchsorted(marks, a + LEAST)
            at = min(int(marks[k]) if k < len(marks) else b, a + MOST, b)
            ends.append(at)
            a = at
        out.append([*ends, b] if b > a else ends)
    return out


def recipes(docs: DataFrame, id_col: str, text_col: str, id_bits: int = 64) -> DataFrame:
    """(id, text_hash, n_chars, text_sha256, recipe, proof) of every row: code points of the text, the digest of the
    normalised text, the list of chunk identifiers and the rest of their digests (three longs a chunk).

    Normalising deletes [\\x20\\x09-\\x0D]; null counts as empty, and an empty text has an empty recipe.  ``text_hash``
    is Spark's xxhash64 of the text as it came.  ``id_bits`` shortens identifiers, to test collisions.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.ArrayType(T.LongType())), T.StructField("proof", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            buf, offsets = K.flat(batch.column(2))
            chars, digests, counts, parts = [], [], [], []
            for a, b in K.slices(offsets):
                raw, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chars.append(_per_row((raw & 0xC0) != 0x80, at))
                keep = ~K.IS_SPACE[raw]
                norm, at = raw[keep], np.concatenate([[0], np.cumsum(_per_row(keep, at))])
                data = norm.tobytes()
                for begin, ends in zip(at[:-1].tolist(), cuts(norm, at), strict=True):
                    whole = hashlib.sha256(data[begin : ends[-1]] if ends else b"")
                    digests.append(whole.hexdigest())
                    counts.append(len(ends))
                    if len(ends) == 1:
                        parts.append(whole.digest())
                    elif ends:
                        parts += [hashlib.sha256(data[x:y]).digest() for x, y in zip([begin, *ends[:-1]], ends, strict=True)]
            longs = np.frombuffer(b"".join(parts), ">i8").astype(np.int64).reshape(-1, 4)
            ids = longs[:, 0] & np.int64(-1 if id_bits == 64 else (1 << id_bits) - 1)
            first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            proof = longs[:, 1:].reshape(-1) if id_bits == 64 else (longs[:, 1:] ^ (longs[:, :1] & ~ids[:, None])).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.concatenate(chars) if chars else [], pa.int64()), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(first), pa.array(ids)), pa.ListArray.from_arrays(pa.array(3 * first), pa.array(proof)),
            ], names=schema.names)

    return in_arrow(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col), run, schema)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per document, dropped ones too: (id, text_hash, text_sha256, keep_id, group_size, kept).

    Of equal normalised texts the row with the most code points in its original text stays, then the one with the
    smallest id (null ids last; ids are longs).  Null texts count as empty and are one group with the empty ones.  Rows that repeat
    the keeper's id and text are all marked kept and all counted.  An empty table gives no rows; other columns are not
    looked at.
    """
    lists = written(recipes(docs, id_col, text_col, id_bits), "recipes")
    verified = _told_apart(lists)
    key = ["recipe", "variants"]
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("minus"))).alias("best")  # falls as the id grows, for the least long too
    groups = verified.groupBy(*key).agg(best, F.count("*").alias("group_size"))
    groups = groups.select(*key, "group_size", F.bitwise_not("best.minus").alias("keep_id"))
    out = verified.select("id", "text_hash", "text_sha256", *key).join(groups, key)
    return out.select("id", "text_hash", "text_sha256", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def _told_apart(lists: DataFrame) -> DataFrame:
    """Adds ``variants``: the digests of those chunks whose identifier stands for more than one content; mostly none."""
    digest = F.transform(F.col("recipe"), lambda x, i: F.struct(x.alias("chunk"), *(F.get("proof", 3 * i + k).alias(f"p{k}") for k in range(3))))
    chunks = lists.select(F.explode(digest).alias("c")).select("c.*")
    ends = [f(f"p{k}").alias(f"{name}{k}") for k in range(3) for name, f in (("least", F.min), ("most", F.max))]
    two = F.expr(" or ".join(f"least{k} <> most{k}" for k in range(3)))
    mixed = written(chunks.groupBy("chunk").agg(*ends).where(two).select("chunk"), "mixed-chunks")
    none = F.array().cast("array<bigint>")
    if mixed.isEmpty():
        return lists.withColumn("variants", none)
    numbered = lists.withColumn("row", F.xxhash64("text_sha256", "recipe"))
    rows = numbered.select("text_sha256", F.posexplode(digest).alias("at", "c")).select("text_sha256", "at", "c.*").distinct()
    told = rows.join(mixed, "chunk", "left_semi").groupBy("text_sha256", "chunk", "at", "p0", "p1", "p2").count()
    told = told.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "p0", "p1", "p2"))).alias("c"))
    flat = F.flatten(F.transform("c", lambda x: F.array(x["at"].cast("long"), x["p0"], x["p1"], x["p2"])))
    told = told.select("text_sha256", flat.alias("variants"))
    return numbered.drop("row").join(told, "text_sha256", "left").withColumn("variants", F.coalesce("variants", none))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each group of equal texts cut to its kept row; the columns stay.

    Of rows that repeat the kept id and text, one stays.  Rows are matched by id and text hash.
    """
    kept = classes(docs, id_col, text_col).where("kept").select(_id("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name can clash with those added here
    at = [f"c{docs.columns.index(name)}" for name in (id_col, text_col)]
    rows = plain.withColumns({"_id": _id(at[0]), "_hash": F.xxhash64(at[1])})
    rows = rows.join(kept.hint("merge"), ["_id", "_hash"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    return rows.withColumn("_nth", nth).where("_nth = 1").select(*plain.columns).toDF(*docs.columns)


def _id(name: str):
    return F.coalesce(F.col(name), F.lit(-(1 << 63)).cast("long"))
