"""A vector index that is kept: inverted lists of a coarse quantiser as partitions of a table, exact scores of what they hold.

The quantiser (spherical k-means) is fitted on a bounded sample; every row is put in the list of its nearest centre.  A
search reads the lists nearest to its queries, and of those only the rows that pass a filter on stored properties, which
the files' own filters see.  How many lists a query needs for a given recall is measured on the sample when the index is
made, so data without clusters are searched more widely than clustered ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from .retrieval import best_of_blocks, nearest_many, packed, units

#: Rows of the sample (those with the smallest hashes of their keys); rounds of fitting; most lists; queries and
#: neighbours by which the lists of a query are counted.
SAMPLE, ROUNDS, MOST_LISTS, TRIED, NEIGHBOURS, SEED = 20_000, 12, 4096, 400, 10, 7
#: Vectors whose distances to all centres are in memory together.
STEP = 1024
#: The list of rows without a direction: null and zero vectors.  No search reads it.
NOWHERE = -1


def centres(unit: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means; a centre that loses all its rows starts anew at a row."""
    r = np.random.default_rng(SEED)
    own = unit[r.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        at = (unit @ own.T).argmax(axis=1)
        total = np.zeros_like(own)
        np.add.at(total, at, unit)
        size = np.sqrt((total * total).sum(axis=1))
        lost = size < 1e-12
        total[lost], size[lost] = unit[r.choice(len(unit), lost.sum())], 1.0
        own = total / size[:, None]
    return own


def probes(unit: np.ndarray, own: np.ndarray, recall: float) -> int:
    """Lists that a query must read so that ``recall`` of its neighbours in the sample are among them, on average."""
    asked = unit[:: max(1, len(unit) // TRIED)]
    near = np.argsort(-(asked @ unit.T), axis=1)[:, 1 : NEIGHBOURS + 1]  # the first is the row itself
    order = np.argsort(np.argsort(-(asked @ own.T), axis=1), axis=1)  # the place of each list for each query
    place = np.take_along_axis(order, (unit @ own.T).argmax(axis=1)[near], axis=1).ravel()
    found = np.cumsum(np.bincount(place, minlength=len(own))) / max(1, len(place))
    return int(min(np.searchsorted(found, recall) + 1, len(own)))


def lists_of(own: np.ndarray, n: int, unit: np.ndarray) -> np.ndarray:
    """The n lists nearest to each query."""
    return np.argsort(-(unit @ own.T), axis=1, kind="stable")[:, :n]


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    centres: np.ndarray
    probes: int

    @staticmethod
    def create(spark: SparkSession, path: str, rows: DataFrame, key: str, vector: str, properties: tuple[str, ...] = (), lists: int | None = None, recall: float = 0.95) -> VectorIndex:
        """An index of the vectors of ``rows`` (of one length) with the columns that searches may filter by."""
        vectors = rows.select(key, *properties, F.transform(vector, lambda x: x.cast("double")).alias("vector"))
        sample = vectors.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64(key)).limit(SAMPLE).select("vector").toPandas()["vector"]
        unit = np.array(sample.tolist(), float).reshape(len(sample), -1)
        unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
        own = centres(unit, lists or int(min(MOST_LISTS, max(1, math.isqrt(rows.count()))))) if len(unit) else np.zeros((1, 0))
        names = [key, *properties]

        def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at, v = _units(frame["vector"])
                number = np.full(len(frame), NOWHERE, np.int32)
                for a in range(0, len(at), STEP):
                    number[at[a : a + STEP]] = (v[a : a + STEP] @ own.T).argmax(axis=1)
                yield frame.assign(list=number)

        kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)
        out = vectors.mapInPandas(placed, f"{kinds}, vector array<double>, list int")
        out.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")  # large lists become several files
        n = probes(unit, own, recall) if len(unit) else 1
        table = pd.DataFrame({"list": range(len(own)), "centre": own.tolist()})
        spark.createDataFrame(table, "list int, centre array<double>").withColumns({"probes": F.lit(n), "key": F.lit(key)}).write.mode("overwrite").parquet(f"{path}/centres")
        return VectorIndex(spark, path, key, own, n)

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        table = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
        return VectorIndex(spark, path, table["key"][0], np.array(table["centre"].tolist(), float), int(table["probes"][0]))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query", where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query_key, key, score, rank): of each query k rows that pass the filter, by cosine; ties (9 places) go to
        the smaller key.

        Scores are exact; a row in a list that is not read can be missed.  A query that finds fewer than k rows in its
        lists, as with a narrow filter, is searched in all of them.
        """
        n = min(probes or self.probes, len(self.centres))
        asked = checkpoint(packed(queries, query_key, query, marks=partial(lists_of, self.centres, n)))
        rows = self.rows().where(F.col("list").isin(self._lists(asked, n)))
        rows = rows if where is None else rows.where(where)
        top = checkpoint(best_of_blocks(asked, packed(rows, self.key, "vector", of="list"), k, query_key, self.key))  # k rows a query
        if n == len(self.centres):
            return top
        full = top.groupBy(query_key).count().where(F.col("count") >= k)
        short = queries.join(full, query_key, "left_anti")
        if short.isEmpty():
            return top
        every = self.rows() if where is None else self.rows().where(where)
        more = nearest_many(every, short, k, self.key, "vector", query_key, query)
        return top.join(full, query_key, "left_semi").unionByName(more)

    def report(self, queries: DataFrame, query_key: str = "query_id", query: str = "query", probes: int | None = None) -> DataFrame:
        """(query_key, lists, rows_read, rows): how many rows are in the lists that a query reads, and in all."""
        n = min(probes or self.probes, len(self.centres))
        sizes = {r["list"]: r["count"] for r in self.rows().groupBy("list").count().collect()}  # MOST_LISTS rows at most
        own, held, every = self.centres, np.array([sizes.get(c, 0) for c in range(len(self.centres))]), sum(sizes.values())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = units(batch.column("v"))
                rows = [held[lists_of(own, n, unit[a : a + STEP])].sum(axis=1) for a in range(0, len(at), STEP)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))], names=[query_key, "rows_read"])

        asked = queries.select(query_key, F.transform(query, lambda x: x.cast("double")).alias("v"))
        out = asked.mapInArrow(read, f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, rows_read long")
        return out.select(query_key, F.lit(n).alias("lists"), "rows_read", F.lit(every).cast("long").alias("rows"))

    def _lists(self, asked: DataFrame, n: int) -> list[int]:
        """The lists that some query reads; MOST_LISTS numbers at most."""

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("marks"):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(x.as_buffer(), np.int32)))], names=["list"])

        return sorted(r.list for r in asked.select("marks").mapInArrow(seen, "list int").distinct().collect())


def _units(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction, and their unit vectors."""
    some = np.flatnonzero(column.notna().to_numpy())
    v = np.array(column.iloc[some].tolist(), float).reshape(len(some), -1)
    size = np.sqrt((v * v).sum(axis=1))
    return some[size > 0], v[size > 0] / size[size > 0, None]
