"""Queries of retrieval: vectors, full text, hybrid; samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..functions.text import embedding_text
from ..operators import retrieval
from ..operators.textindex import TextIndex
from ..operators.vectorindex import VectorIndex
from .registry import query, table

_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) "


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()["embedding"]
    return rows, F.array(*(F.lit(float(x)) for x in first))


@query(_Q + "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    return retrieval.nearest(rows, q, 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(_Q + "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE label IN (1, 2) ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10")
def vector_topk_prefilter(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    found = retrieval.nearest(rows, q, 10, "vec_id", "embedding", F.col("label").isin(1, 2))
    return found.select("vec_id", F.round("score", 6).alias("score"))


#: Indexes by session, tables and kind: made once, then read by every search of the session.
_KEPT: dict[tuple[str, str, str], object] = {}


def _kept(spark, sf_dir, kind, make):
    name = spark.sparkContext.applicationId, sf_dir, kind
    if name not in _KEPT:
        _KEPT[name] = make(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _KEPT[name]


def text_index(spark, sf_dir):
    make = lambda path: TextIndex.create(spark, path, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _kept(spark, sf_dir, "text", make)


def vector_index(spark, sf_dir):
    make = lambda path: VectorIndex.create(spark, path, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ("label",))
    return _kept(spark, sf_dir, "vectors", make)


def word_vectors(spark, sf_dir):
    """Hashed-word vectors of all documents, as a table."""

    def make(path):
        retrieval.hashed_words(table(spark, sf_dir, "documents"), "doc_id", "text").write.parquet(path)
        return path

    return spark.read.parquet(_kept(spark, sf_dir, "words", make))


_BM25 = r"""WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\r\n\f]+') AS w FROM documents
), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t
), x AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t
), tf AS (SELECT term, doc_id, length, count(*) AS tf FROM x GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[^ \t\r\n\f]+'))) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL
)
"""


@query(_BM25 + "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r QUALIFY rank <= 5")
def fulltext_bm25(spark, sf_dir):
    """Looks the questions up in the index of the session; no document is read."""
    found = text_index(spark, sf_dir).search(table(spark, sf_dir, "benchmark"), 5, "item_id", "text")
    return found.select("item_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_BM25.rstrip() + ", o AS (SELECT term, sum(tf)::BIGINT AS occurrences, max(tf) AS most_tf, min(length) AS least_length FROM tf GROUP BY 1) SELECT term, df, occurrences, most_tf, least_length FROM df JOIN o USING (term)")
def fulltext_index(spark, sf_dir):
    """Makes an index of all documents and gives its vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TextIndex.create(spark, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}", docs, "doc_id").vocabulary()


_LATER = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' zebra ' || coalesce(source, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query(_BM25.replace("FROM documents", f"FROM ({_LATER})") + "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM r QUALIFY rank <= 10")
def fulltext_versions(spark, sf_dir):
    """An index kept up to date: a first batch, a second, new versions of a fifth, a seventh removed; then searched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = TextIndex.create(spark, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}", docs.where("doc_id % 3 <> 0"), "doc_id")
    index = index.added(docs.where("doc_id % 3 = 0"), "doc_id")
    later = docs.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" zebra "), F.coalesce("source", F.lit(""))))
    index = index.added(later, "doc_id").removed(docs.where("doc_id % 7 = 0"), "doc_id")
    found = index.search(table(spark, sf_dir, "benchmark"), 10, "item_id", "text")
    return found.select("item_id", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_BM25.rstrip() + r""", hw AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\d]+')) AS w FROM documents
  UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\d]+')) FROM benchmark
), hc AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS b, count(*)::DOUBLE AS n FROM hw GROUP BY ALL
), hn AS (SELECT kind, id, sqrt(sum(n * n)) AS size FROM hc GROUP BY ALL
), cs AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(q.n * d.n) / any_value(nq.size * nd.size) AS score
  FROM hc q JOIN hc d ON q.kind = 'q' AND d.kind = 'd' AND q.b = d.b JOIN hn nq ON nq.kind = 'q' AND nq.id = q.id JOIN hn nd ON nd.kind = 'd' AND nd.id = d.id GROUP BY 1, 2
), ranked AS (
  SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cs QUALIFY rank <= 50
  UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 50
), f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM ranked GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")  # fmt: skip
def hybrid(spark, sf_dir):
    """Words and hashed-word vectors of every question, fused by rank; both are read from what the session keeps."""
    asked = table(spark, sf_dir, "benchmark")
    words = text_index(spark, sf_dir).search(asked, 50, "item_id", "text").withColumnRenamed("key", "doc_id")
    questions = retrieval.hashed_words(asked, "item_id", "text")
    near = retrieval.nearest_many(word_vectors(spark, sf_dir), questions, 50, "doc_id", "vector", "item_id", "vector")
    return retrieval.fused(words, near, key="doc_id", query_key="item_id", k=10)


@query("WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, q) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_search_many(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.nearest_many(rows, asked, 10, "vec_id", "embedding")
    return found.withColumn("score", F.round("score", 6))


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query()
def vector_index_search(spark, sf_dir):
    """Every vector whose id is divisible by 20 against the index; tested for recall against ``vector_search_many``."""
    return vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query()
def vector_index_filtered(spark, sf_dir):
    """The same among the vectors of two labels."""
    found = vector_index(spark, sf_dir).search(_asked(spark, sf_dir), 10, where=F.col("label").isin(1, 2))
    return found.withColumn("score", F.round("score", 6))


@query()
def vector_index_report(spark, sf_dir):
    """How many rows each of these searches reads, of how many."""
    return vector_index(spark, sf_dir).report(_asked(spark, sf_dir))


@query("SELECT s_suppkey, trim(s_name || ' ' || coalesce(n_name, '') || ' ' || CASE WHEN s_acctbal > 0 THEN 'solvent' ELSE '' END || ' end') AS input FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def embed_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf_dir, "supplier").join(n, "s_nationkey", "left")
    parts = F.col("s_name"), F.col("n_name"), F.when(F.col("s_acctbal") > 0, "solvent"), F.lit("end")
    return s.select("s_suppkey", embedding_text(*parts).alias("input"))


@query("SELECT doc_id, source FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 10")
def random_sample(spark, sf_dir):
    """Ten rows in the order of a seeded hash: the same whatever the partitions."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(10)
