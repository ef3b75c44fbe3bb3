import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def library(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return pieces.Codec(f.read())


def test_random_texts_equal_the_library(codec):
    r = random.Random(3)
    pool = [chr(i) for i in range(0x3000)] + ["<s>", "</s>", "<0x41>", "日本", "😀", "▁", "�", "é", "  "]
    common = ["er", "th", "a", "ing", " ", "1", "The", "!", "...", "\n", "ation", "▁", "ab", "  "]
    names = [p.replace("▁", " ") for p in codec.vocabulary.id if len(p) > 1]
    for k in range(6000):
        x = "".join(r.choice(pool if r.random() < 0.4 else common) for _ in range(r.randint(0, 25))) if k % 2 else "".join(r.choices(names, k=r.randint(1, 7)))
        ids = LIBRARY.encode(x, add_eos=True)
        assert codec.encode(x) == ids and codec.decode(ids) == LIBRARY.decode(ids), repr(x)
        assert [y for _, y in codec.spelled([x])] == [LIBRARY.decode(ids)], repr(x)


def test_walk_equals_merging_by_rank(codec):
    """Words of the vocabulary's own parts: what backtracking finds is what merging by rank gives; long runs too."""
    v, r = codec.vocabulary, random.Random(5)
    parts = [p for p in v.id if p.isascii() and p.isalpha()]
    words = ["".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(4000)] + ["a" * n for n in range(1, 120)] + ["ab" * 40, "lll" * 31]
    assert all([v.text[i] for i in ids] == v.merged(w) for w, ids in zip(words, v.encode(words)))


def test_places_that_fail_are_left_and_not_tried_again(codec):
    """A vocabulary in which the longest pieces mislead: every word takes steps back, and the result is still exact."""
    v = codec.vocabulary
    seen = 0
    for w in ("".join(random.Random(k).choices("aeinorst", k=30)) for k in range(300)):
        longest = [-1] * (len(w) + 1)
        for last, t in v.automaton.iter(w):
            longest[last + 1 - v.size[t]] = t
        greedy, at = [], 0
        while at < len(w):
            greedy.append(longest[at])
            at += v.size[longest[at]]
        found = v.encode([w])[0]
        seen += greedy != found
        assert [v.text[i] for i in found] == v.merged(w)
    assert seen > 100


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == library(texts[r.doc_id])


def test_odd_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 3)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 5)
    rows = [(1, None), (2, ""), (3, "x" * 20000), (4, "a b c d e f g </s>"), (4, "a b c d e f g </s>"), (None, "long text " * 20000), (5, " "), (6, "\0 \n")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded(df, PATH, ["doc_id"]).collect())
    assert got == sorted((repr(i), *library(t)) for i, t in rows)
    ids = pieces.encoded(df.where("doc_id = 4"), PATH, ["doc_id"], ids=True).first().ids
    assert sha(" ".join(map(str, ids))) == library(rows[3][1])[1]
    assert pieces.encoded(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_other_models_are_refused():
    with open(PATH, "rb") as f:
        data = f.read()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")
    with pytest.raises(ValueError, match="BPE"):
        pieces.Vocabulary(data[:at] + b"\x18\x01" + data[at + 2 :])
