"""The kept indexes: full text against BM25 by definition, vectors against brute force."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import retrieval, textindex
from graphloom.operators.textindex import TextIndex
from graphloom.operators.vectorindex import VectorIndex
from graphloom.plans import search


def bm25(docs, asked, k):
    words = {i: t.lower().split() for i, t in docs.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in asked:
        score = {}
        for w in dict.fromkeys(text.lower().split()):
            for i, ws in words.items():
                if tf := ws.count(w):
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    score[i] = score.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(q, n, i, round(score[i], 6)) for n, i in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,shard", [(128, 1 << 16), (4, 50)])
def test_index_through_batches_versions_removal_and_compaction(spark, tmp_path, monkeypatch, block, shard):
    monkeypatch.setattr(textindex, "BLOCK", block)
    monkeypatch.setattr(textindex, "SHARD", shard)
    r = random.Random(6)
    pool = [f"w{k}" for k in range(80)]
    text = lambda: " ".join(r.choices(pool, [1 / (k + 1) for k in range(80)], k=r.randint(0, 50)))
    docs = {k: text() for k in range(240)} | {500: None, 501: "", 502: "w3 w3 W70"}
    asked = [(k, " ".join(r.choices(pool, k=r.randint(1, 6)))) for k in range(15)]
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query string")

    def same(index, docs, k=3):
        got = index.search(queries, k).collect()
        assert sorted((x.query_id, x["rank"], x.key, round(x.score, 6)) for x in got) == bm25(docs, asked, k)

    path = str(tmp_path)
    index = TextIndex.create(spark, path, frame(docs), "doc")
    same(index, docs)
    more = {k: text() for k in range(600, 640)} | {k: text() for k in range(0, 240, 9)}
    index = index.added(frame(more), "doc")
    docs |= more
    same(index, docs)
    index = index.added(frame(more), "doc")  # the same batch again changes nothing
    same(index, docs)
    index = index.removed(frame({k: "" for k in range(100, 130)}), "doc")
    docs = {k: t for k, t in docs.items() if k not in range(100, 130)}
    same(index, docs)
    assert index.dirty and sorted(x.key for x in index.documents().collect()) == sorted(docs)
    index = index.compacted()
    assert not index.dirty and len(index.segments) == 1
    same(index, docs)
    same(TextIndex.load(spark, path), docs, 20)
    monkeypatch.setattr(textindex, "CELLS", 1000)  # queries in several steps
    same(index, docs)
    df = Counter(w for t in docs.values() if t for w in set(t.lower().split()))
    assert {x.term: x.df for x in index.vocabulary().collect()} == df


def test_bounds_leave_blocks_out(spark, tmp_path, monkeypatch):
    """One frequent term: blocks of low frequencies in long texts cannot reach the best."""
    monkeypatch.setattr(textindex, "BLOCK", 8)
    docs = {k: "w " * (1 + 40 // (k + 1)) + "x " * (k % 60) for k in range(400)}
    index = TextIndex.create(spark, str(tmp_path), spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc")
    asked = [(1, "w"), (2, "w nowhere")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = index.search(queries, 5).collect()
    assert sorted((x.query_id, x["rank"], x.key, round(x.score, 6)) for x in got) == bm25(docs, asked, 5)
    assert all(4 * x.needed <= x.blocks and x.blocks >= 50 for x in index.report(queries, 5).collect())


def test_a_batch_that_breaks_off_leaves_the_generation_before(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc long, text string")
    index = TextIndex.create(spark, str(tmp_path), docs, "doc")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(textindex, "_stored", fail)
        with pytest.raises(OSError):
            index.added(docs.withColumn("text", F.lit("z")), "doc")
    index = TextIndex.load(spark, str(tmp_path))
    assert {x.term for x in index.vocabulary().collect()} == {"a", "b", "c"}
    index = index.added(docs.where("doc = 2").withColumn("text", F.lit("z")), "doc")
    assert {x.term for x in index.vocabulary().collect()} == {"a", "b", "z"}


def test_a_search_reads_no_document(spark, tmp_path):
    """The documents' files are gone when the index is searched, and only buckets of the terms asked for are scanned."""
    docs = spark.createDataFrame([(k, f"word{k % 50} common text") for k in range(400)], "doc long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    index = TextIndex.create(spark, str(tmp_path / "index"), spark.read.parquet(str(tmp_path / "docs")), "doc")
    os.rename(tmp_path / "docs", tmp_path / "gone")
    found = index.search(spark.createDataFrame([(1, "word7")], "query_id long, query string"), 50)
    assert sorted(x.key for x in found.collect()) == list(range(7, 400, 50))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    assert "In(term" in plan or "EqualTo(term" in plan


def test_vectors_with_and_without_filter(spark, sf, tmp_path):
    rows, asked = spark.read.parquet(f"{sf}/embeddings.parquet"), search._asked(spark, sf)
    for where in (None, F.col("label").isin(1, 2)):
        index = search.vector_index(spark, sf)
        got = {(x.query_id, x.vec_id) for x in index.search(asked, 10, where=where).collect()}
        want = {(x.query_id, x.vec_id) for x in retrieval.nearest_many(rows if where is None else rows.where(where), asked, 10, "vec_id", "embedding").collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    every = index.search(asked, 10, probes=10_000).collect()
    exact = retrieval.nearest_many(rows, asked, 10, "vec_id", "embedding").collect()
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in every) == sorted((x.query_id, x["rank"], x.vec_id) for x in exact)


def test_clustered_vectors_are_read_in_part(spark, tmp_path):
    """Clusters, one of them with a third of all rows, rows without a direction, a narrow filter, and a reloaded index."""
    r = np.random.default_rng(2)
    middle = r.normal(size=(40, 16))
    of = np.r_[np.zeros(1000, int), r.integers(0, 40, 2000)]
    v = middle[of] + 0.15 * r.normal(size=(3000, 16))
    data = [(i, v[i].tolist(), int(of[i])) for i in range(3000)] + [(9000, None, 1), (9001, [0.0] * 16, 1)]
    rows = spark.createDataFrame(data, "id long, vector array<double>, kind int").repartition(4)
    VectorIndex.create(spark, str(tmp_path), rows, "id", "vector", ("kind",))
    index = VectorIndex.load(spark, str(tmp_path))
    asked = rows.where("id % 20 = 0 AND id < 3000").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {(x.query_id, x.id) for x in index.search(asked, 10).collect()}
    want = {(x.query_id, x.id) for x in retrieval.nearest_many(rows, asked, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    share = index.report(asked).agg(F.sum("rows_read") / F.sum("rows")).first()[0]
    assert share < 0.6 and index.rows().count() == 3002
    narrow = index.search(asked, 10, where=F.col("kind") == 39).collect()
    exact = retrieval.nearest_many(rows.where("kind = 39"), asked, 10).collect()
    assert len(narrow) == len(exact)
    plan = index.search(asked.limit(1), 10, where=F.col("kind") == 39, probes=1)
    assert plan.count() == 10


def test_searches_by_blocks_hold_no_side_whole(spark, tmp_path, monkeypatch):
    """Queries stay in tasks, copies beyond the k-th place stay where they are, and small blocks give the same rows."""
    r = random.Random(8)
    some = [[r.gauss(0, 1) for _ in range(6)] for _ in range(150)] + [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 300 + [[0.0] * 6, None]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(some)], "id long, vector array<double>").repartition(4)
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    unit = np.array(some[:450]) / np.linalg.norm(np.array(some[:450]), axis=1)[:, None]
    want = []
    for q in range(0, 450, 4):
        score = np.round(unit @ unit[q], 9)
        want += [(q, n, int(i)) for n, i in enumerate(sorted(range(450), key=lambda i: (-score[i], i))[:5], 1)]
    index = VectorIndex.create(spark, str(tmp_path), rows, "id", "vector", lists=6)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", lambda self: pytest.fail("a side goes through the driver"))
    for found in (retrieval.nearest_many(rows, asked, 5), index.search(asked, 5, probes=6)):
        assert sorted((x.query_id, x["rank"], x.id) for x in found.collect()) == want
    assert index.report(asked, probes=2).count() == 113
    with pytest.raises(Exception, match="several lengths"):
        retrieval.nearest_many(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], rows.schema).coalesce(1), asked, 5).collect()


def test_scores_of_frequent_words_are_summed_in_stretches(spark, tmp_path, monkeypatch):
    """Questions that share frequent words: matches in one step stay few, and scores are the same."""
    r = random.Random(2)
    docs = {k: " ".join(r.choices("abcdefgh", k=r.randint(1, 12))) for k in range(120)}
    asked = [(k, " ".join(r.sample("abcdefgh", 6))) for k in range(20)]
    index = TextIndex.create(spark, str(tmp_path), spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc")
    monkeypatch.setattr(textindex, "MATCHES", 50)
    got = index.search(spark.createDataFrame(asked, "query_id long, query string"), 4).collect()
    assert sorted((x.query_id, x["rank"], x.key, round(x.score, 6)) for x in got) == bm25(docs, asked, 4)
    n = np.array([30, 30, 0, 80, 10, 10])
    assert list(textindex._stretches(n, 50)) == [(0, 1), (1, 3), (3, 4), (4, 6)] and textindex.POSTINGS <= 500_000
