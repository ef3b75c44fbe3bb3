"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

Rotations of the centred vectors are learned so that their signs lose little (balanced binary codes).  Codes are cut into
segments, one table each; vectors meet where they agree in a whole segment.  Pairs whose first bits are near are then
compared by the original vectors.  A pair that meets in several tables counts in the first; no pair leaves its task, only
counts and the links that span a group.

A table's rows carry a key, the vector's number and HEAD bits of its code, so they are narrow; vectors and whole codes join
only those rows that have a near partner there.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_arrow, written
from .components import components
from .hamming import Forest, by_run, dealt, pairs

#: Rotations are learned from at most this many vectors (those with the smallest hashes) and this many numbers.
SAMPLE, SAMPLE_NUMBERS, ROUNDS, SEED = 8_000, 8_000_000, 15, 5
#: The chance to find a pair at the threshold (if tables were independent), by which the number of tables is chosen.
RECALL = 0.995
#: Least bits of a segment, and strangers that share a vector's key in a table, at most on average; segments get a bit
#: longer with each doubling of the vectors, tables more, so that this number and RECALL stay as they are.
LEAST_BITS, STRANGERS = 16, 16
#: Bits by which pairs that meet are first compared, standard deviations of their distance that are allowed, and rows of
#: a key in a block.
HEAD, SPARE, BLOCK = 128, 4, 1024
#: Pairs whose whole codes or vectors are compared in one numpy step.
STEP = 1 << 14


def learn(sample: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projections [d, 64 * rotations]; each block of 64 is a rotation of the principal directions."""
    r, d = np.random.default_rng(SEED), sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :64]
    if d < 64:  # too few directions for 64 bits: add random ones
        axes = np.concatenate([axes, r.normal(size=(d, 64 - d)) / math.sqrt(d)], axis=1)
    blocks, v = [], x @ axes
    for _ in range(rotations):
        turn, _ = np.linalg.qr(r.normal(size=(64, 64)))
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        blocks.append(axes @ turn)
    return mean, np.concatenate(blocks, axis=1)


def shape(rows: int, cosine: float) -> tuple[int, int, int]:
    """Bits of a segment, tables, and the distance of HEAD bits up to which pairs are compared.

    A bit of two vectors differs with a chance of their angle over pi.  Whatever the number of rows, a pair at the
    threshold is found with the chance RECALL.
    """
    flip = math.acos(cosine) / math.pi
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 2) / STRANGERS)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - flip) ** bits))
    return bits, tables, math.ceil(HEAD * flip + SPARE * math.sqrt(HEAD * flip * (1 - flip)))


def segments(bits: int, tables: int) -> np.ndarray:
    """The first bit of each table's segment; those of the first tables lie within the words of the HEAD bits."""
    per = 64 // bits
    head = [64 * w + bits * k for w in range(HEAD // 64) for k in range(per)]
    return np.array((head + [HEAD + bits * k for k in range(max(0, tables - len(head)))])[:tables])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their cosine in double precision is ``cosine`` or more and the search finds them (recall in the README;
    never below the threshold).  Equal vectors are one node with a count, so copies make no pairs.  Null, empty, zero
    and non-finite vectors link with nothing; so do rows with a null id, and vectors of different lengths.  Rows that
    repeat an id are linked as rows of their own.  component_id: the smallest id reachable.  An empty table gives no
    rows; other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("v"))
    good = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # The number is drawn once, when the table is written: an id may name several vectors, a number names one.
    nodes = good.groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for length, n in nodes.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect():
        part = checkpoint(_links(nodes.where(F.size("v") == length), length, n, cosine))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, links long, other long")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("h", "v", "id", "copies", "node").join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("id").alias("component_id"))
    known = known.join(least, "component").select("h", F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    member = good.join(known, "h").where("v = w").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("v")) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(nodes: DataFrame, d: int, n: int, cosine: float) -> DataFrame:
    """Nodes (v, node, copies) of one length -> (node, links, null): links found in one table; (node, null, other):
    spanning links."""
    bits, tables, most = shape(n, cosine)
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    sample = nodes.orderBy(F.xxhash64(F.lit(SEED), "v"), "id").limit(size).select("v").toArrow().column("v")
    sample = sample.combine_chunks().flatten().to_numpy().reshape(-1, d)
    starts = segments(bits, tables)
    rotations = -(-max(HEAD, int(starts[-1]) + bits) // 64)
    model = nodes.sparkSession.sparkContext.broadcast(pickle.dumps(learn(sample / np.linalg.norm(sample, axis=1, keepdims=True), rotations)))
    words = [f"c{k}" for k in range(HEAD // 64)]

    def encode(batches):
        mean, project = pickle.loads(model.value)
        for batch in batches:
            every = batch.column(0).flatten().to_numpy().reshape(-1, d)
            for a in range(0, len(every), 2048):
                v = every[a : a + 2048]
                signs = (v / np.linalg.norm(v, axis=1, keepdims=True) - mean) @ project >= 0
                head = np.packbits(signs[:, :HEAD], axis=1, bitorder="little").view("<i8")
                keys = np.zeros((len(v), tables), np.int64)
                for k in range(bits):
                    keys |= signs[:, starts + k].astype(np.int64) << k
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, len(v)), *(pa.array(head[:, k].copy()) for k in range(len(words))), lists], names=["node", *words, "keys"])

    heads = ", ".join(f"{w} long" for w in words)
    codes = written(in_arrow(nodes.select("v", "node"), encode, f"node long, {heads}, keys array<bigint>"), "codes")
    rows = codes.select("node", *words, F.posexplode("keys").alias("at", "segment"))
    rows = rows.select(F.xxhash64("at", "segment").alias("key"), "at", F.col("node").alias("id"), *words)

    def close(whole: pa.Table, bounds: np.ndarray):
        """Rows that have a partner with a near code that they have not met in a table within the HEAD bits."""
        col = _runs(whole, bounds)
        if col is None:
            return
        whole, bounds, col = col
        code = np.stack([col[w].view(np.uint64) for w in words])
        keep = np.zeros(whole.num_rows, bool)
        for i, j in _near_pairs(bounds, col, code, most):
            new = ~_met_before(code[:, i] ^ code[:, j], col["at"][i], bits)
            keep[i[new]] = keep[j[new]] = True
        if keep.any():
            yield from whole.filter(pa.array(keep)).select(kept).combine_chunks().to_batches()

    kept = ["key", "at", "own", "lo", "hi", "id"]
    some = by_run(dealt(rows, BLOCK), close, "key long, at int, own int, lo int, hi int, id long")
    some = some.withColumnRenamed("id", "node").join(nodes.select("node", "v", "copies").join(codes, "node"), "node")

    def compare(whole: pa.Table, bounds: np.ndarray):
        """Counts the links of each row, and the links that span them."""
        col = _runs(whole, bounds)
        if col is None:
            return
        whole, bounds, col = col
        code = np.stack([col[w].view(np.uint64) for w in words])
        v = whole.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        keys = whole.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        norm = np.sqrt((v * v).sum(axis=1))
        links, forest, out = np.zeros(whole.num_rows, np.int64), Forest(col["node"]), []
        for i, j in _near_pairs(bounds, col, code, most):
            for a in range(0, len(i), STEP):
                x, y = i[a : a + STEP], j[a : a + STEP]
                ok = np.einsum("nd,nd->n", v[x], v[y]) / (norm[x] * norm[y]) >= cosine
                x, y = x[ok], y[ok]
                ok = (keys[x] == keys[y]).argmax(axis=1) == col["at"][x]  # here first
                x, y = x[ok], y[ok]
                links += np.bincount(x, col["copies"][y], len(links)).astype(np.int64)
                links += np.bincount(y, col["copies"][x], len(links)).astype(np.int64)
                out += forest.link(x, y)
        some = np.flatnonzero(links)
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([col["node"][some], a])), pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64()), pa.array([*[None] * len(some), *b.tolist()], pa.int64()),
        ], names=["node", "links", "other"])

    return by_run(some, compare, "node long, links long, other long")


def _runs(whole: pa.Table, bounds: np.ndarray):
    """Only runs of two rows and more, with their columns as arrays."""
    size = np.diff(bounds)
    if not (size > 1).any():
        return None
    whole = whole.filter(pa.array(np.repeat(size > 1, size)))
    names = [n for n in whole.column_names if n not in ("v", "keys")]
    return whole, np.append(0, np.cumsum(size[size > 1])), {n: whole.column(n).to_numpy() for n in names}


def _near_pairs(bounds: np.ndarray, col: dict, code: np.ndarray, most: int):
    """Pairs of one key whose HEAD bits are near; a row's own table tells keys apart that share a hash."""
    for i, j in pairs(bounds, np.zeros(len(col["at"]), np.int8), col["own"], col["lo"], col["hi"]):
        ok = np.bitwise_count(code[:, i] ^ code[:, j]).sum(axis=0, dtype=np.int64) <= most
        ok &= col["at"][i] == col["at"][j]
        if ok.any():
            yield i[ok], j[ok]


def _met_before(differ: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Whether the segment of a table before this one, within the HEAD bits, is equal, so that the pair counts there."""
    out, per, mask = np.zeros(len(at), bool), 64 // bits, np.uint64((1 << bits) - 1)
    for k in range(len(differ) * per):
        part = (differ[k // per] >> np.uint64(bits * (k % per))) & mask
        out |= (k < at) & (part == 0)
    return out
