"""The training-data pipeline: language id, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, langid, mixing, recipes, shingles
from graphloom.llm.common import table, written

#: Texts whose best language is less probable than this are rejected, as are those without any letter.
LEAST_SCORE = 0.3
#: Words of a shingle; documents whose distinct shingles have a similarity of 0.8 (``shingles.LEAST``) are near-duplicates.
SHINGLE = 5



def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, empty or without letters go."""
    net = langid.fit(docs)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name can clash with the prediction's
    found = langid.predict(plain, net, plain.columns, f"c{docs.columns.index('text')}")
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*plain.columns).toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    return recipes.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, then text hash.  Rows with a null id stay."""
    found = shingles.classes(docs, shingle=SHINGLE)
    dropped = found.where("id <> keep_id or text_hash <> keep_hash").select("id", "text_hash").distinct()
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name can clash with those of the classes
    at = [F.col(f"c{docs.columns.index(name)}") for name in ("doc_id", "text")]
    same = (at[0] == F.col("id")) & (F.xxhash64(at[1]) == F.col("text_hash"))
    return plain.join(dropped, same, "left_anti").toDF(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal parts, about as many rows as came in; copies are rows of their own."""
    return mixing.mixed(docs).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256) of every row."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encoded(docs, path, ["doc_id", "source", "lang"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("bpe", bpe_tokens),
]

#: A trained network and a tokenizer are beyond SQL; tests/llm compares the pipeline with a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
