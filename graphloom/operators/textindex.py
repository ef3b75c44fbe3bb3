"""A full-text index that is kept: posting lists as a table bucketed by term, with the documents of each shard.

A shard is a run of documents that one task reads; their posting lists are made in that task, so no posting is shuffled
alone.  A list is cut into blocks of BLOCK postings, those with the highest frequencies first.  A block's row holds its
postings and the bounds of their frequencies and lengths, so a search knows what a block can add to a score without
taking it apart.  Blocks are dealt to files by bucket of terms; a shard's documents and their lengths are one more list,
without a term, in a bucket of its own.

Every batch of documents is a segment of its own.  A generation (a row of ``meta``) names the segments that count and the
totals of the corpus; it is written last, so a batch that breaks off changes nothing and can be repeated.  Documents that
a later segment replaces are listed as dead until ``compacted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import K1, B, terms

#: Postings of a block; documents and postings of a shard, about; buckets of terms, and the one of the shards' documents.
BLOCK, SHARD, POSTINGS, BUCKETS, DOCUMENTS = 128, 1 << 13, 500_000, 32, -1
#: Files of a batch, at most; beyond it blocks are shuffled, each bucket's to so many tasks at most.  Bytes of documents
#: that go to a worker at a time.
MOST_FILES, FILES, BATCH_BYTES = 50_000, 1024, 8 << 20
#: Terms of a search that are pushed down to the files' own filters, and terms of all its queries, at most.
PUSHED, PAIRS = 2000, 1_000_000
#: Scores (queries by documents), and matches of a posting with a query, in one numpy step.
CELLS, MATCHES = 4_000_000, 500_000
#: Scores that differ by less than this are not told apart by the bounds.
SLACK = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """One generation of an index; every change gives a new one."""

    spark: SparkSession
    path: str
    generation: int
    segments: tuple[int, ...]
    dirty: tuple[int, ...]  # segments with dead documents
    n_docs: int
    mean: float | None

    @staticmethod
    def create(spark: SparkSession, path: str, rows: DataFrame, key: str, text: str = "text") -> TextIndex:
        """An index of the texts of ``rows``; keys are unique and not null."""
        return _segment(TextIndex(spark, path, -1, (), (), 0, None), rows, key, text)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        """The latest generation."""
        r = spark.read.parquet(f"{path}/meta").orderBy(F.desc("generation")).first()
        return TextIndex(spark, path, r.generation, tuple(r.segments), tuple(r.dirty), r.n_docs, r.mean)

    def added(self, rows: DataFrame, key: str, text: str = "text") -> TextIndex:
        """With these documents; those whose key is known replace the version before.  Safe to repeat."""
        return _segment(self, rows, key, text)

    def removed(self, keys: DataFrame, key: str) -> TextIndex:
        """Without the documents of these keys."""
        gone = self.documents().join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        return _stored(self, self.segments, self.dead().unionByName(gone.select("key", "segment", "shard")))

    def compacted(self) -> TextIndex:
        """One segment without dead postings; no text is read and no shard is mixed with another."""
        flat = self._live(self.postings().select("segment", "bucket", "shard", "term", F.explode("postings").alias("p")).select("segment", "bucket", "shard", "term", "p.*"))
        s = max(self.segments, default=-1) + 1
        rows = flat.select("bucket", "shard", "term", "key", "tf", "length").repartition("bucket", "shard").sortWithinPartitions("bucket", "shard")
        _written(self, rows.mapInArrow(partial(_again, BLOCK), _schema(_key_kind(self.postings()))), s)
        return _stored(self, (s,), self.dead().limit(0))

    def documents(self) -> DataFrame:
        """(key, length, segment, shard) of every document that counts; length is null for a null text."""
        rows = self.postings().where(F.col("bucket") == DOCUMENTS).select("segment", "shard", F.explode("postings").alias("p"))
        return self._live(rows.select("p.key", "p.length", "segment", "shard"))

    def dead(self) -> DataFrame:
        """(key, segment, shard) of replaced and removed versions."""
        return self.spark.read.parquet(f"{self.path}/dead/generation={self.generation}")

    def postings(self) -> DataFrame:
        """(term, shard, block, n, bounds, postings, segment, bucket) of the segments that count."""
        return self.spark.read.option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/segment={s}" for s in self.segments))

    def vocabulary(self) -> DataFrame:
        """(term, df, occurrences, most_tf, least_length) over the documents that count."""
        rows = self.postings().where(F.col("bucket") != DOCUMENTS)
        if not self.dirty:  # least_length needs the postings only where a block holds several
            sums = F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["tf"])
            return rows.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum(sums).alias("occurrences"), F.max("most_tf").alias("most_tf"), F.min("least_length").alias("least_length"))
        flat = self._live(rows.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.*"))
        return flat.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """(query_key, key, score, rank): the k best documents of each query by BM25; ties (9 places) go to the smaller key.

        Blocks of the queries' terms go to the tasks of their shards, as they are; there all that a document gets meets,
        and k documents of each query go on.  Raises if the queries hold over PAIRS terms together: search for parts of them.
        """
        asked = self._asked(queries, k, query_key, query)
        found = self._needed(asked).select("segment", "shard", "term", "postings")
        if self.dirty:
            gone = self.dead().where(F.col("segment").isin(list(self.dirty)))
            posting = F.struct("key", F.lit(0).alias("tf"), F.lit(0).alias("length"))
            gone = gone.groupBy("segment", "shard").agg(F.collect_list(posting).alias("postings"))  # SHARD rows or so at most
            found = found.unionByName(gone.withColumn("term", F.lit(None).cast("string")))
        kinds = found.schema["postings"].dataType.elementType["key"].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
        score = partial(_scored, asked, k, self.mean or 1.0, CELLS, MATCHES)
        rows = found.repartition("segment", "shard").sortWithinPartitions("segment", "shard")
        best = rows.mapInArrow(score, f"q int, key {kinds[0]}, score double")
        named = self.spark.createDataFrame([(i, name) for i, name in enumerate(asked.names)], f"q int, `{query_key}` {kinds[1]}")
        w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "key")
        top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return top.join(F.broadcast(named), "q").select(query_key, "key", "score", "rank")

    def report(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """(query_key, blocks, needed): how many blocks a query's terms have, and how many it needs."""
        asked = self._asked(queries, k, query_key, query)
        kind = queries.schema[query_key].dataType.simpleString()
        pairs = [(asked.names[q], asked.terms[t], float(asked.idf[t]), float(x)) for q, t, x in zip(asked.query.tolist(), asked.term.tolist(), asked.spare)]
        pairs = self.spark.createDataFrame(pairs, f"`{query_key}` {kind}, term string, idf double, spare double")
        rows = self._wanted(asked.terms).drop("postings").join(pairs, "term")
        needed = F.col("idf") * self._factor("most_tf", "least_length") + F.col("spare") >= 0
        return rows.groupBy(query_key).agg(F.count("*").alias("blocks"), F.count_if(needed).alias("needed"))

    def _factor(self, tf: str, length: str) -> Column:
        """A posting's part of the score but for the term's idf: more for a higher tf, less for a longer text."""
        return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.lit(self.mean or 1.0)))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without postings of dead versions; rows have key and segment."""
        return rows.join(self.dead(), ["key", "segment"], "left_anti") if self.dirty else rows

    def _wanted(self, some: list[str]) -> DataFrame:
        """Blocks of these terms: whole buckets are left out by their names, the rest by the files' filters."""
        buckets = self.spark.createDataFrame([(t,) for t in some], "term string").select(_bucket(F.col("term")).alias("b")).distinct()
        rows = self.postings().where(F.col("bucket").isin(sorted(r.b for r in buckets.collect())))  # BUCKETS numbers at most
        if len(some) <= PUSHED:
            return rows.where(F.col("term").isin(some))
        return rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in some], "term string")), "term", "left_semi")  # PAIRS rows at most

    def _needed(self, asked: _Asked) -> DataFrame:
        """Blocks that some query needs."""
        spare = np.full(len(asked.terms), -np.inf)
        np.maximum.at(spare, asked.term, asked.spare)
        rows = [(t, float(i), float(x)) for t, i, x in zip(asked.terms, asked.idf, spare)]
        known = self.spark.createDataFrame(rows, "term string, idf double, spare double")
        found = self._wanted(asked.terms).join(F.broadcast(known), "term")  # PAIRS rows at most
        return found.where(F.col("idf") * self._factor("most_tf", "least_length") + F.col("spare") >= 0)

    def _asked(self, queries: DataFrame, k: int, query_key: str, query: str) -> _Asked:
        """The queries' terms with idf, and what a block of a term may lack.

        A query's k-th score is at least what any block of k live postings or more gives to each of them.  A block is left
        out if its best posting and the best of all other terms stay below that: none of its documents is among the k,
        and what a document loses by it had left it below anyway.
        """
        pairs = queries.select(query_key, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
        held = pairs.limit(PAIRS + 1).collect()
        if len(held) > PAIRS:
            raise ValueError(f"queries of over {PAIRS} terms at a time")
        every = sorted({r.term for r in held})
        rows = self._wanted(every)
        sure = F.col("n") >= k
        if self.dirty:
            sure &= ~F.col("segment").isin(list(self.dirty))
        best, least = F.max(self._factor("most_tf", "least_length")), F.max(F.when(sure, self._factor("least_tf", "most_length")))
        stats = rows.groupBy("term").agg(F.sum("n").alias("df"), best.alias("best"), F.coalesce(least, F.lit(0.0)).alias("least"))
        stats = {r.term: r for r in stats.collect()}  # a row for each term asked for
        gone = {}
        if self.dirty:
            flat = rows.where(F.col("segment").isin(list(self.dirty))).select("segment", "term", F.explode("postings").alias("p"))
            flat = flat.select("segment", "term", F.col("p.key").alias("key")).join(self.dead(), ["key", "segment"], "left_semi")
            gone = {r.term: r["count"] for r in flat.groupBy("term").count().collect()}
        known = sorted(stats)
        number = {t: i for i, t in enumerate(known)}
        df = np.array([stats[t].df - gone.get(t, 0) for t in known], float)
        idf = np.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))
        best, least = (idf * np.array([stats[t][c] for t in known], float) for c in ("best", "least"))
        names = list(dict.fromkeys(r[0] for r in held))
        at = {name: i for i, name in enumerate(names)}
        kept = [(at[r[0]], number[r.term]) for r in held if r.term in number]
        q, t = np.array(kept, np.int64).reshape(-1, 2).T
        whole, floor = np.zeros(len(names)), np.zeros(len(names))
        np.add.at(whole, q, best[t])
        np.maximum.at(floor, q, least[t])
        return _Asked(names, known, idf, q, t, whole[q] - best[t] - floor[q] + SLACK)


@dataclass(frozen=True)
class _Asked:
    """Queries by number, their terms by number, and of each pair how much a posting may lack and still matter."""

    names: list
    terms: list[str]
    idf: np.ndarray
    query: np.ndarray
    term: np.ndarray
    spare: np.ndarray


def _scored(asked: _Asked, k: int, mean: float, cells: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query from each shard; rows without a term hold the shard's dead documents."""
    number = {t: i for i, t in enumerate(asked.terms)}
    order = np.argsort(asked.term, kind="stable")
    query, start = asked.query[order], np.searchsorted(asked.term[order], np.arange(len(asked.terms) + 1))
    held: list[pa.RecordBatch] = []

    def finish() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        term = np.array([-1 if t is None else number[t] for t in rows.column("term").to_pylist()], np.int64)
        lists = rows.column("postings").combine_chunks()
        term, flat = np.repeat(term, np.diff(lists.offsets.to_numpy())), lists.flatten()
        codes = flat.field("key").dictionary_encode()
        keys, code = codes.dictionary, codes.indices.to_numpy()
        alive = np.ones(len(keys), bool)
        alive[code[term < 0]] = False
        ok = (term >= 0) & alive[code]
        tf, length = (flat.field(c).to_numpy()[ok].astype(float) for c in ("tf", "length"))
        term, code = term[ok], code[ok]
        part = asked.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        many = max(1, cells // max(1, len(keys)))  # queries in one step
        for a in range(0, len(asked.names), many):
            b = min(a + many, len(asked.names))
            lo, hi = (start[term], start[term + 1]) if b - a == len(asked.names) else _between(query, start, term, a, b)
            total = np.zeros((b - a) * len(keys))
            for c, d in _stretches(hi - lo, most):
                n = hi[c:d] - lo[c:d]
                at = np.repeat(lo[c:d] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cell = (query[at] - a) * len(keys) + np.repeat(code[c:d], n)
                np.add.at(total, cell, np.repeat(part[c:d], n))
            total = total.reshape(b - a, len(keys))
            for q in range(b - a):
                some = np.flatnonzero(total[q])
                if len(some) > k:
                    place = np.round(total[q], 9)
                    least = np.partition(place[some], -k)[-k]
                    some = some[place[some] >= least]
                    if len(some) > k:  # of those that tie, the smaller keys
                        tied = some[place[some] == least]
                        ranks = pc.sort_indices(keys.take(pa.array(tied))).to_numpy()
                        some = np.concatenate([some[place[some] > least], tied[ranks]])[:k]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), a + q, np.int32)), keys.take(pa.array(some)), pa.array(total[q][some])], names=["q", "key", "score"])

    unit = None
    for batch in batches:
        segment, shard = batch.column("segment").to_numpy(), batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero((segment[1:] != segment[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and unit != (segment[a], shard[a]):
                    yield from finish()
                    held = []
                unit = segment[a], shard[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield from finish()


def _stretches(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of postings that hold at most ``most`` pairs of a posting and a query, or one posting."""
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _between(query: np.ndarray, start: np.ndarray, term: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term's queries (ascending) those from a to below b."""
    span = int(query.max(initial=0)) + 1
    by = np.repeat(np.arange(len(start) - 1), np.diff(start)) * span + query
    return np.searchsorted(by, term * span + a), np.searchsorted(by, term * span + b)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _key_kind(postings: DataFrame) -> str:
    return postings.schema["postings"].dataType.elementType["key"].dataType.simpleString()


def _schema(key: str) -> str:
    return f"shard long, term string, block int, n int, most_tf int, least_tf int, least_length int, most_length int, postings array<struct<key: {key}, tf: int, length: int>>"


def _segment(index: TextIndex, rows: DataFrame, key: str, text: str) -> TextIndex:
    s = max(index.segments, default=-1) + 1
    docs = rows.select(F.col(key).alias("key"), F.col(text).alias("t"))
    cores = index.spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # one small file would be one task
        docs = docs.repartition(cores)
    blocks = _counted(docs).mapInArrow(partial(_shards, BLOCK, SHARD, s), _schema(docs.schema["key"].dataType.simpleString()))
    _written(index, blocks, s)
    new = replace(index, segments=(s,), dirty=())
    if index.generation < 0:
        return _stored(new, (s,), new.documents().select("key", "segment", "shard").limit(0))
    gone = index.documents().join(new.documents().select("key"), "key", "left_semi")
    return _stored(index, (*index.segments, s), index.dead().unionByName(gone.select("key", "segment", "shard")))


def _counted(docs: DataFrame) -> DataFrame:
    """(key, length, runs) of the texts ``t``: a text's sorted words are counted in its own row."""
    rows = docs.select("key", F.sort_array(terms(F.col("t"))).alias("w"))
    new = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2)))
    rows = rows.select("key", "w", F.when(F.size("w") > 0, new).otherwise(F.array().cast("array<int>")).alias("first"))  # places where another word begins
    runs = F.transform("first", lambda i, k: F.struct(F.get("w", i - 1).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("w") + 1) - i).alias("tf")))
    return rows.select("key", F.when(F.col("w").isNotNull(), F.size("w")).alias("length"), runs.alias("runs"))


def _shards(block: int, most: int, segment: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of a task, a shard after another."""
    held, docs, postings, number = [], 0, 0, 0
    first = segment << 44 | TaskContext.get().partitionId() << 20

    def shard() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        runs = rows.column("runs").combine_chunks()
        size, flat = np.diff(runs.offsets.to_numpy()), runs.flatten()
        n = rows.num_rows
        at = pa.array(np.concatenate([np.arange(n), np.repeat(np.arange(n), size)]))  # the list of documents, and the others
        term = pa.concat_arrays([pa.nulls(n, pa.string()), flat.field("term").cast(pa.string())])
        tf = pa.concat_arrays([pa.array(np.zeros(n, np.int32)), flat.field("tf")])
        key, length = (rows.column(c).combine_chunks().take(at) for c in ("key", "length"))
        return _blocks_of(np.full(len(term), first + number, np.int64), term, key, tf, length, block)

    for batch in batches:
        a = 0
        while a < batch.num_rows:
            size = np.cumsum(np.diff(batch.column("runs").offsets.to_numpy())[a:])
            b = a + max(1, min(most - docs, int(np.searchsorted(size, POSTINGS - postings, "right"))))
            held.append(batch.slice(a, b - a))
            docs, postings, a = docs + held[-1].num_rows, postings + int(size[min(b - a, len(size)) - 1]), min(b, batch.num_rows)
            if docs >= most or postings >= POSTINGS:
                yield shard()
                held, docs, postings, number = [], 0, 0, number + 1
    if held:
        yield shard()


def _again(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks anew from postings in the order of (bucket, shard)."""
    held, unit = [], None
    flush = lambda: _blocks_of(*_columns(pa.Table.from_batches(held).combine_chunks()), block)
    for batch in batches:
        bucket, shard = (batch.column(c).to_numpy() for c in ("bucket", "shard"))
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and unit != (bucket[a], shard[a]):
                    yield flush()
                    held = []
                unit = bucket[a], shard[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _columns(rows: pa.Table) -> tuple:
    return rows.column("shard").to_numpy(), *(rows.column(c).combine_chunks() for c in ("term", "key", "tf", "length"))


def _blocks_of(shard: np.ndarray, term: pa.Array, key: pa.Array, tf: pa.Array, length: pa.Array, block: int) -> pa.RecordBatch:
    """Blocks of the postings of some shards, in the order of falling frequency, then length, then key."""
    code = term.dictionary_encode().indices.fill_null(-1).to_numpy()
    ranks = pc.rank(key, tiebreaker="dense").to_numpy()
    often, long = tf.to_numpy(), length.fill_null(0).to_numpy()
    order = np.lexsort((ranks, long, -often, code, shard))
    shard, code, often, long = shard[order], code[order], often[order], long[order]
    flat = pa.StructArray.from_arrays([x.take(pa.array(order)) for x in (key, tf, length)], names=["key", "tf", "length"])
    start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])])
    nth = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
    at = np.flatnonzero(nth % block == 0)
    ends = np.append(at, len(code)).astype(np.int32)
    bounds = [np.maximum.reduceat(often, at), np.minimum.reduceat(often, at), np.minimum.reduceat(long, at), np.maximum.reduceat(long, at)]
    numbers = [pa.array(x.astype(np.int32)) for x in (nth[at] // block, np.diff(ends), *bounds)]
    names = ["shard", "term", "block", "n", "most_tf", "least_tf", "least_length", "most_length", "postings"]
    return pa.RecordBatch.from_arrays([pa.array(shard[at]), term.take(pa.array(order[at])), *numbers, pa.ListArray.from_arrays(pa.array(ends), flat)], names=names)


def _written(index: TextIndex, blocks: DataFrame, segment: int) -> None:
    """Files of a bucket, sorted by term.  Each task writes its own, so blocks are not shuffled, unless that would be over
    MOST_FILES; then blocks of some shards go together."""
    bucket = F.when(F.col("term").isNull(), F.lit(DOCUMENTS)).otherwise(_bucket(F.col("term")))
    rows = blocks.withColumn("bucket", bucket)
    if blocks.rdd.getNumPartitions() * (BUCKETS + 1) > MOST_FILES:
        rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("shard"), F.lit(FILES)))
    rows = rows.sortWithinPartitions("bucket", "term", "shard", "block")
    conf, name = index.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    was = conf.get(name)
    conf.set(name, str(BATCH_BYTES))  # rows are whole texts
    try:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/segment={segment}")
    finally:
        conf.set(name, was)


def _stored(index: TextIndex, segments: tuple[int, ...], dead: DataFrame) -> TextIndex:
    """The next generation."""
    g, spark = index.generation + 1, index.spark
    dead.distinct().write.mode("overwrite").parquet(f"{index.path}/dead/generation={g}")
    dirty = [r.segment for r in spark.read.parquet(f"{index.path}/dead/generation={g}").select("segment").distinct().collect()]
    new = TextIndex(spark, index.path, g, segments, tuple(s for s in dirty if s in segments), 0, None)
    n, mean = new.documents().agg(F.count("*"), F.avg("length")).first()
    row = [(list(segments), list(new.dirty), n, mean)]
    spark.createDataFrame(row, "segments array<int>, dirty array<int>, n_docs long, mean double").write.mode("overwrite").parquet(f"{index.path}/meta/generation={g}")
    return replace(new, n_docs=n, mean=mean)
