"""SimHash near-duplicates through pigeonring filtering.

A fingerprint of B bits is cut into m segments on a ring.  If two fingerprints differ in at most t bits, then from some
segment on, every chain of 1, 2, ... m consecutive segments differs in at most (length * t / m) bits.  The first links
of that chain are the index: with t < m the first segment is equal and the second differs in at most one bit, so the
key is an exact segment with its successor within one bit (32 bits of key for 64-bit fingerprints and t = 3).  The
longer chains prune candidates before the full Hamming check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import checkpoint, in_arrow
from .components import components
from .hamming import Forest, by_run, dealt, keyed, pairs

SEGMENT = 16


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, words64: int = 1) -> DataFrame:
    """(id, f0, f1, ...) of every whole text: SimHash over word shingles, repeats included.

    Words are maximal runs without [\\x20\\x09-\\x0D], A-Z lower-cased; a shingle is ``shingle`` words joined by one
    space, or the whole sequence if there are fewer.  A bit is 1 if it is set in over half of the shingles' hashes; the
    first 64 bits come from XXH64 (seed 42) itself, further words from a mix of it.  No word (or null): all bits zero.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(f"f{k}", T.LongType()) for k in range(words64)])

    def run(batches):
        for batch in batches:
            buf, offsets = K.flat(batch.column(1))
            out = np.zeros((words64, batch.num_rows), np.uint64)
            for a, b in K.slices(offsets):
                part = K.LOWER[buf[offsets[a] : offsets[b]]]
                starts, ends, first = K.tokens(part, offsets[a : b + 1] - offsets[a])
                words, at, to = K.squeeze(part, starts, ends)
                n = np.diff(first)
                count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
                row_at = np.concatenate([[0], np.cumsum(count)])
                begin = np.arange(row_at[-1]) - np.repeat(row_at[:-1], count) + np.repeat(first[:-1], count)
                last = np.minimum(begin + shingle, np.repeat(first[1:], count)) - 1
                h = K.xxh64(words, at[begin], to[last], 42)
                for k in range(words64):
                    bits = K.bit_counts(K.mix(h, k) if k else h, row_at)
                    out[k, a:b] = K.pack_bits(2 * bits > count[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], names=schema.names)

    return in_arrow(docs.select(id_col, text_col), run, schema)


def links(prints: DataFrame, words64: int, most_bits: int) -> DataFrame:
    """Distinct fingerprints (id, f0, ...) -> links (a, b) that span the graph of all pairs within ``most_bits``
    (fewer than there are segments)."""
    words = [f"f{k}" for k in range(words64)]
    per = 64 // SEGMENT
    m = words64 * per
    seg = [F.shiftrightunsigned(words[k // per], SEGMENT * (k % per)).bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long")) for k in range(m)]
    if most_bits >= m:
        raise ValueError(f"{most_bits} bits apart need more than {m} segments")
    keys = [keyed(seg[(k + 1) % m], F.xxhash64(F.lit(k), seg[k]), SEGMENT, k) for k in range(m)]
    rows = prints.select("id", *words, F.explode(F.concat(*keys)).alias("x")).select("x.key", "x.role", "x.segment", "id", *words)

    def work(whole: pa.Table, bounds: np.ndarray):
        if len(bounds) - 1 == whole.num_rows:
            return
        size = np.diff(bounds)
        keep = np.repeat(size > 1, size)
        whole, bounds = whole.filter(pa.array(keep)), np.append(0, np.cumsum(size[size > 1]))
        col = {n: whole.column(n).to_numpy() for n in whole.column_names}
        codes = np.stack([col[w].view(np.uint64) for w in words])
        forest, out = Forest(col["id"]), []
        for i, j in pairs(bounds, col["role"], col["own"], col["lo"], col["hi"]):
            differ = codes[:, i] ^ codes[:, j]
            # the chain from this segment on, length by length
            good, total = np.ones(len(i), bool), np.zeros(len(i), np.int64)
            for step in range(1, m):
                k = (col["segment"][i].astype(np.int64) + step - 1) % m
                word = differ[k // per, np.arange(len(i))] >> (SEGMENT * (k % per)).astype(np.uint64)
                total += np.bitwise_count(word & np.uint64((1 << SEGMENT) - 1))
                good &= total * m <= step * most_bits
            i, j, differ = i[good], j[good], differ[:, good]
            near = np.bitwise_count(differ).sum(axis=0) <= most_bits
            out += forest.link(i[near], j[near])
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_run(dealt(rows), work, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words64: int = 1, most_bits: int = 3) -> DataFrame:
    """One row per document: (id, f0, ..., component): the smallest id reachable through fingerprints within
    ``most_bits`` bits.

    Ids are longs.  Equal fingerprints are one node, named by the smallest id, so that copies never make pairs.  Null texts count as
    empty; empty texts share the zero fingerprint and link like any other.  Null ids keep their rows and are never
    the smallest; a fingerprint that has null ids only gets a null component.  Repeated rows stay repeated.  An empty
    table gives no rows; extra columns are not looked at.
    """
    words = [f"f{k}" for k in range(words64)]
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, words64))
    nodes = prints.groupBy(*words).agg(F.min("id").alias("node"))
    named = nodes.where("node is not null").select(F.col("node").alias("id"), *words)
    groups = components(checkpoint(links(named, words64, most_bits)))
    nodes = nodes.join(groups, "node", "left").select(*words, F.coalesce("component", "node").alias("component"))
    return prints.join(nodes, words)
