"""Embedding, vector search, full-text search and their combination."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from ..functions.text import cosine, embedding_text

#: BM25's usual constants.
K1, B = 1.2, 0.75


def to_embed(chunks: DataFrame, properties: list[str], document: str | None = None, again: bool = False) -> DataFrame:
    """Rows that need an embedding, with ``embedding_input``: any property set, none embedded yet, active or of the named
    document."""
    some = F.coalesce(*properties).isNotNull()
    rows = chunks.where(some if again else some & F.col("text_embedding").isNull())
    rows = rows.where(F.col("document_name") == document if document is not None else F.coalesce("active", F.lit(True)))
    return rows.withColumn("embedding_input", embedding_text(*(F.col(p) for p in properties)))


def embedded(rows: DataFrame, embed: Callable[[pd.Series], pd.Series], key: str = "id", batch: int = 100, retries: int = 3) -> DataFrame:
    """(key, text_embedding) of embedding_input, in batches; a batch that fails ``retries`` times is left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                for left in range(retries - 1, -1, -1):
                    try:
                        yield pd.DataFrame({key: part[key].tolist(), "text_embedding": list(embed(part["embedding_input"]))})
                        break
                    except (OSError, RuntimeError):
                        if not left:
                            break

    return rows.select(key, "embedding_input").mapInPandas(run, f"{key} {kind}, text_embedding array<float>")


def hashed_words(rows: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, vector): a stand-in for an embedding model, JVM-side: counts of a text's words by hash.

    Words are found once; what is shuffled are counts by bucket, ``dims`` a text at most.  Texts without words are left out.
    """
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\d]+)"), 1)).alias("w")
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 4), 16, 10).cast("int") % dims
    counts = rows.select(key, words).groupBy(key, bucket.alias("b")).agg(F.count("*").cast("double").alias("n"))
    sparse = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return sparse.select(key, dense.alias("vector"))


#: Numbers of a block of vectors (8 bytes each) and its rows, at most; blocks that a task holds of the vectors, and goes
#: through of the queries; bytes of blocks that go to a worker at a time.
BLOCK_NUMBERS, BLOCK_ROWS, HELD, ASKED, BATCH_BYTES = 1 << 16, 1024, 64, 16, 4 << 20


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """(query_key, key, score, rank): the k vectors of highest cosine for each query; ties (9 places) go to the smaller key.

    Blocks of queries meet blocks of vectors; k rows of a query and a task go on.  Neither side is held whole anywhere.
    Vectors that are zero or null have no neighbours.
    """
    return best_of_blocks(packed(queries, query_key, query), packed(vectors, key, vector), k, query_key, key)


def packed(rows: DataFrame, key: str, vector: str, of: str | None = None, marks: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(keys, unit, of, marks): blocks of unit vectors, ordered by key; rows without a direction are left out.

    A block has rows of one value of the column ``of`` (-1 if none is named).  ``marks``: some int32 numbers for each row.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col(of).cast("int") if of else F.lit(-1)).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = units(batch.column("v"))
            if not len(at):
                continue
            own = pa.table({"of": batch.column("of").take(pa.array(at)), "key": batch.column("key").take(pa.array(at))})
            order = pc.sort_indices(own, sort_keys=[("of", "ascending"), ("key", "ascending")], null_placement="at_start")
            own, unit = own.take(order), unit[order.to_numpy()]
            names, group = own.column("key").combine_chunks(), own.column("of").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            many = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // unit.shape[1]))
            for first, last in zip(cuts, cuts[1:]):
                for a in range(first, last, many):
                    b = min(a + many, last)
                    said = b"" if marks is None else marks(unit[a:b]).astype(np.int32).tobytes()
                    held = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), names.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([held, pa.array([unit[a:b].tobytes()], pa.binary()), pa.array(group[a : a + 1], pa.int32()), pa.array([said], pa.binary())], names=["keys", "unit", "of", "marks"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, f"keys array<{kind}>, unit binary, of int, marks binary")


def units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction, and their unit vectors; vectors are of one length."""
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(some))
    size = np.unique(np.diff(column.offsets.to_numpy()))
    if len(size) > 1:
        raise ValueError(f"vectors of several lengths: {size.tolist()}")
    if not len(size) or not size[0]:
        return some[:0], np.zeros((0, 1))
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(some), size[0])
    norm = np.sqrt((v * v).sum(axis=1))
    ok = (norm > 0) & np.isfinite(norm)
    return some[ok], v[ok] / norm[ok, None]


def best_of_blocks(asked: DataFrame, blocks: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """(query_key, key, score, rank) from packed queries and vectors.  A query with marks meets only the blocks ``of`` one
    of these numbers."""
    kinds = [x.schema["keys"].dataType.elementType.simpleString() for x in (asked, blocks)]
    asked, blocks = checkpoint(asked), checkpoint(blocks)
    many, cores = blocks.count(), asked.sparkSession.sparkContext.defaultParallelism
    left = asked.select(F.monotonically_increasing_id().alias("number"), F.col("keys").alias("asked"), F.col("unit").alias("query"), "marks")
    left = left.repartition(max(1, -(-asked.count() // ASKED)))
    right = blocks.select("keys", "unit", "of").repartition(max(1, min(many, cores), -(-many // HELD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i]  # noqa: B023, E731
                if found is None or of("number").as_py() != number:
                    if found is not None:
                        yield from found.rows()
                    number, found = of("number").as_py(), _Best(k, of("asked").values, of("query").as_buffer(), of("marks").as_buffer(), query_key, key)
                found.add(of("keys").values, of("unit").as_buffer(), of("of").as_py())
        if found is not None:
            yield from found.rows()

    best = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, score double")
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best rows of each query of a block, of the blocks seen so far."""

    def __init__(self, k: int, names: pa.Array, unit: pa.Buffer, marks: pa.Buffer, query_key: str, key: str):
        self.k, self.names, self.query_key, self.key = k, names, query_key, key
        self.unit = np.frombuffer(unit).reshape(len(names), -1)
        self.marks = np.frombuffer(marks, np.int32).reshape(len(names), -1)
        self.held: list[pa.Table] = []

    def add(self, keys: pa.Array, unit: pa.Buffer, of: int) -> None:
        asked = np.flatnonzero((self.marks == of).any(axis=1)) if self.marks.size else np.arange(len(self.names))
        if not len(asked):
            return
        scores = np.round(self.unit[asked] @ np.frombuffer(unit).reshape(len(keys), -1).T, 9)
        keep = np.ones(scores.shape, bool)
        if self.k < len(keys):  # of rows that tie at the k-th place, the first ones: keys ascend
            least = np.partition(scores, -self.k, axis=1)[:, -self.k, None]
            above, tied = scores > least, scores == least
            keep = above | (tied & (np.cumsum(tied, axis=1) <= self.k - above.sum(axis=1)[:, None]))
        q, row = np.nonzero(keep)
        self.held.append(pa.table({"q": pa.array(asked[q]), "key": keys.take(pa.array(row)), "score": pa.array(scores[q, row])}))
        if sum(t.num_rows for t in self.held) > 8 * self.k * len(self.names):
            self.held = [self._kept()]

    def _kept(self) -> pa.Table:
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
        q = rows.column("q").to_numpy()
        return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = self._kept()
        q, key, score = (rows.column(c).combine_chunks() for c in ("q", "key", "score"))
        yield pa.RecordBatch.from_arrays([self.names.take(q), key, score], names=[self.query_key, self.key, "score"])


def nearest(vectors: DataFrame, query: Column, k: int, key: str, vector: str, where: Column | None = None) -> DataFrame:
    """(key, score): the k rows of highest cosine after the filter; ties go to the smaller key.

    One scan; only k rows of each task are sorted together.
    """
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(key, cosine(F.col(vector), query).alias("score")).where("score is not null")
    return rows.orderBy(F.desc("score"), key).limit(k)


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([^ \t\r\n\f]+)"), 1)


def fused(*ranked: DataFrame, key: str, query_key: str, k: int, constant: int = 60) -> DataFrame:
    """(query_key, key, score, rank): reciprocal-rank fusion of ranked lists (query_key, key, rank), k for each query."""
    rows = reduce(DataFrame.unionByName, [r.select(query_key, key, "rank") for r in ranked])
    score = rows.groupBy(query_key, key).agg(F.round(F.sum(1 / (F.col("rank") + constant)), 9).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_neighbours(seeds: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Seeds of a search with the nodes one hop away: (key, neighbour)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return seeds.select(key).join(both.select(F.col("src").alias(key), F.col("dst").alias("neighbour")), key).distinct()
