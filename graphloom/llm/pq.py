"""Product-quantised codes of vectors, computed in integers.

A vector's components become integers; each of its equal parts gets a codebook that a few rounds of assignment and means
refine.  The nearest entry is found with a float32 matrix product first.  Each of its results comes with an interval that
holds the true value, whatever the order of the sum; entries whose interval reaches below the best upper end are compared
in int64, and of equal distances the lower index wins.  So the result does not depend on how numpy multiplies.

Each round is one pass over the vectors that brings home sums and counts of each entry of each part, and nothing else.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of at most so many bits: squared distances and sums of a task then fit in 64 bits.
BITS = 26
#: Vectors in one numpy step; unit roundoff of float32.
STEP, UNIT = 4096, 2.0**-24
#: Labels whose sums are broadcast; beyond it they are joined, with each label's rows spread over SALT keys.
LABELS_BROADCAST, SALT = 100_000, 64


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (int64) for each row of ``x`` (int64), ties to the lower, and the squared
    distance."""
    n, d = x.shape
    if not d or not len(book):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # |c|^2 - 2 x.c in float32: d + 1 additions and products, two roundings of the inputs.
    length = (book * book).sum(axis=1)
    near = (x.astype(np.float32) @ (-2 * book).astype(np.float32).T) + length.astype(np.float32)
    size = 2 * np.sqrt((x * x).sum(axis=1).astype(float))[:, None] * np.sqrt(length.astype(float)) + length
    error = (d + 6) * UNIT * 1.001 * size  # of each value, by Cauchy's bound of the sum of absolute products
    best = (near + error).min(axis=1)
    open_ = near - error <= best[:, None]
    row, entry = np.nonzero(open_)
    gap = x[row] - book[entry]
    exact = np.full(near.shape, np.iinfo(np.int64).max)
    exact[row, entry] = (gap * gap).sum(axis=1)
    index = exact.argmin(axis=1)  # the first of equals
    return index, exact[np.arange(n), index]


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * x) of a batch of vectors of length d."""
    whole = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    if whole.size and np.abs(whole).max() >= 1 << BITS:
        raise ValueError(f"a component of a vector is {1 << BITS} / {SCALE} or more")
    return whole.astype(np.int64).reshape(-1, d) if d else np.zeros((len(column), 0), np.int64)


def trained(good: DataFrame, d: int, id_col: str, vector_col: str) -> list[np.ndarray]:
    """Codebooks [entries, d / PARTS] of each part, after ROUNDS rounds."""
    if d % PARTS:
        raise ValueError(f"vectors of length {d} do not cut into {PARTS} equal parts")
    first = good.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(ENTRIES).select(vector_col)
    start = integers(first.toArrow().column(0).combine_chunks(), d)
    w = d // PARTS
    books = [start[:, p * w : (p + 1) * w] for p in range(PARTS)]
    for _ in range(ROUNDS):
        data = good.sparkSession.sparkContext.broadcast(pickle.dumps(books))

        def gather(batches, data=data):
            books = pickle.loads(data.value)
            k = len(books[0])
            sums, counts = np.zeros((PARTS * k, w), np.int64), np.zeros(PARTS * k, np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, STEP):
                    x = integers(batch.column(0).slice(a, STEP), d)
                    for p in range(PARTS):
                        part = x[:, p * w : (p + 1) * w]
                        index = nearest(part, books[p])[0] + p * k
                        counts += np.bincount(index, minlength=PARTS * k)
                        np.add.at(sums, index, part)
            met = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(met, pa.int64()), pa.array(counts[met]), pa.array([*sums[met]], pa.list_(pa.int64())),
            ], names=["entry", "n", "sums"])

        each = in_arrow(good.select(vector_col), gather, "entry long, n long, sums array<long>")
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(w)]
        k = len(books[0])
        books = [b.copy() for b in books]
        for r in each.groupBy("entry").agg(F.sum("n").alias("n"), *total).collect():  # PARTS * ENTRIES rows at most
            books[r.entry // k][r.entry % k] = [int(r[f"s{i}"]) // r.n for i in range(w)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, with a comma between."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector.

    Rows whose vector is null or holds null, NaN or infinite components are left out.  The vectors with the ENTRIES
    smallest ids (null ids last, of equal ids the smaller vector first) start the codebooks; fewer vectors give fewer
    entries.  code: two hex digits for each part; error: squared distances, summed over parts; label_error: errors
    summed over equal labels, nulls together.  Repeated rows count as often as they are there.  Vectors of another
    length have codebooks of their own; lengths that do not cut into PARTS, and components of 2^18 and beyond, are an
    error.  An empty table gives no rows; other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_label"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("_v").isNotNull() & ~bad)
    kind, label = (rows.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    schema = f"vec_id {kind}, _label {label}, code string, error long, codebooks_sha256 string"
    found = None
    for length in sorted(r.d for r in good.select(F.size("_v").alias("d")).distinct().collect()):
        part = _codes(good.where(F.size("_v") == length), length, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    sums = found.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    if sums.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST:
        key, sums = F.lit(0), F.broadcast(sums.withColumn("_s", F.lit(0)))
    else:
        key = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")
        sums = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sums = sums.select(F.col("_label").alias("_l"), "_s", "label_error")
    found = found.withColumn("_k", key).join(sums, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_k") == F.col("_s")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes(good: DataFrame, d: int, schema: str) -> DataFrame:
    books = trained(good, d, "_id", "_v")
    data, sha, w = good.sparkSession.sparkContext.broadcast(pickle.dumps(books)), digest(books), d // PARTS

    def assign(batches):
        books = pickle.loads(data.value)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                piece = batch.slice(a, STEP)
                x = integers(piece.column(1), d)
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    code[:, p], off = nearest(x[:, p * w : (p + 1) * w], books[p])
                    error += off
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(2), pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                    pa.array(error), pa.array([sha] * len(x), pa.string()),
                ], names=["vec_id", "_label", "code", "error", "codebooks_sha256"])

    return in_arrow(good.select("_id", "_v", "_label"), assign, schema)
