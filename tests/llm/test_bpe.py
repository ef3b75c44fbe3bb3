import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_random_texts_equal_the_library():
    codec, t, r = bpe.Codec(open(PATH).read()), Tokenizer.from_file(PATH), random.Random(3)
    pool = [chr(i) for i in range(1, 0x3000)] + ["<|endoftext|>", "<|startoftext|>", "<|", "'s", "ΑΣ", "日本", "😀", "\x1c", "\x85", "é", "్᫄"]
    common = ["er", "th", "a", "ing", " ", "1", "The", "!", "...", "é", "'t", "ation", "\0", "\1"]
    for _ in range(4000):
        x = "".join(r.choice(pool if r.random() < 0.4 else common) for _ in range(r.randint(0, 25)))
        ids = t.encode(x, add_special_tokens=False).ids
        assert codec.encode(x) == ids and codec.decode(ids) == t.decode(ids, skip_special_tokens=False), repr(x)


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == library(texts[r.doc_id])


def test_odd_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    rows = [(1, None), (2, ""), (3, "x" * 20000), (4, "a b c d e f g <|endoftext|>"), (4, "a b c d e f g <|endoftext|>"), (None, "long text " * 20000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(df, PATH, ["doc_id"]).collect())
    assert got == sorted((repr(i), *library(t)) for i, t in rows)
    ids = bpe.encoded(df.where("doc_id = 4"), PATH, ["doc_id"], ids=True).first().ids
    assert sha(" ".join(map(str, ids))) == library(rows[3][1])[1]
    assert bpe.encoded(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_random_words_equal_merging_by_rank():
    """Words of the vocabulary's own parts, encoded together through the trie and one by one by the definition."""
    v, r = bpe.Vocabulary(open(PATH).read()), random.Random(9)
    parts = r.sample([t for t in v.id if len(t) < 7], 300)
    words = {"".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(5000)} | {"a" * n for n in range(1, 200)}
    found = v.encode(words)
    assert found.keys() == words and all(found[w] == v.merged(w) for w in words)


def test_slices_do_not_change_the_result(monkeypatch):
    texts = ["one two", "", "three " * 30, "one onetwo twothree"] * 5
    codec = bpe.Codec(open(PATH).read())
    want = list(codec.spelled(texts))
    import pyarrow as pa

    for size in (1, 50):
        monkeypatch.setattr(bpe, "SLICE", size)
        assert [x for part in bpe._slices(pa.array([t or None for t in texts])) for x in codec.spelled(part)] == want
