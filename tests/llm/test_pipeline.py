"""The pipeline against a plain-Python version of each stage's decision on its own input."""

import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from graphloom.llm import langid  # noqa: E402

from .test_shingles import kept as kept_by_similarity  # noqa: E402

def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, "12 !!", "en", "x", 0), (9004, docs.first().text + " ", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen, now = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (now.collect(), (now := spark.read.parquet(str(tmp_path / name))).collect())
    before, after = seen["language_id"]
    letter = {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    kept = {r.doc_id for r in after}
    assert kept <= letter and len(kept) >= 0.99 * len(letter) and not kept & {9001, 9002, 9003}
    before, after = seen["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(min(g)[1] for g in groups.values())
    before, after = seen["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == kept_by_similarity([(r.doc_id, r.text) for r in before])
    before, after = seen["mixing"]
    n = Counter(r.source for r in before)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and abs(len(after) - len(before)) < 6 * len(before) ** 0.5
    assert len(n) >= len({r.source for r in after})
    before, after = seen["bpe"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in before)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"score": F.lit("mine"), "n_tokens": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.bpe_tokens(spark, docs.limit(0), "").count() == 0
    got = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and got.select("score").distinct().first().score == "mine"
    assert langid.fit(docs.limit(0)) is None


def test_stages_on_odd_rows(spark):
    """Null ids, repeated ids with other texts, repeated rows, null sources, long texts."""
    long = "some words that go on and on in one long text " * 4000
    rows = [(None, "the only row without an id here", "en", "a"), (1, "a text of its own with six words", "en", None), (1, "another text of its own under that id", "en", "a"),
            (2, long, "en", "a"), (3, long + "end", "en", "b"), (4, "the last row twice in the table", "en", "b"), (4, "the last row twice in the table", "en", "b"), (5, None, None, None)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        left.append(sorted(((r.doc_id, r.text[:9]) for r in now.collect()), key=repr) if name != "bpe" else sorted((r.n_tokens for r in now.collect())))
    ids = lambda *x: sorted(x, key=repr)
    assert left[0] == ids(*((i, t[:9]) for i, t, _, _ in rows if t))
    assert left[1] == ids(*((i, t[:9]) for i, t, _, _ in rows[:6]))
    assert left[2] == ids(*((i, t[:9]) for i, t, _, _ in (*rows[:4], rows[5])))
    assert {*left[3]} <= {*left[2]} and len(left[4]) == len(left[3])
