"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import hamming

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def kept(rows):
    """Rows (id, text) that are the first of their component; ids differ, so text hashes do not matter."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] == s[j] or 9 * both >= 4 * (len(s[i]) + len(s[j])) > 0:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    best = {}
    for (i, _), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, i), i)
    return sorted(best.values())


def documents():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = []
    for n in [8] * 20 + [9] * 10 + [14, 25, 60, 120, 300] * 12:
        base = r.choices(words, k=n)
        texts.append(base)
        texts.append([*base, r.choice(words)])  # one shingle more: 4 of 5 at eight words
        for changes in (1, 2, 4, 6, 8):
            copy = list(base)
            for k in r.sample(range(n), min(n, max(1, changes * n // 300))):
                copy[k] = r.choice(words)
            texts.append(copy)
    passage = r.choices(words, k=14) * 20
    texts += [r.choices(words, k=150) + passage + r.choices(words, k=150) for _ in range(6)]  # far apart, but share repeats
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("most", [4096, 4])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, most):
    monkeypatch.setattr(hamming, "BLOCK", most)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == kept(rows)


def test_stage_equals_brute_force_on_documents(spark, sf):
    df = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet").where("text is not null"), sf)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == kept([(r.doc_id, r.text) for r in df.collect()])


def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    rows = [(1, "one text of six words here"), (2, "quite another text with other words"), (2, "one text of six words HERE"), (None, "one text of six words here"), (None, "x")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[1], rows[3], rows[4]], key=repr)


def test_parity_bits_differ_in_no_more_places_than_sets():
    import numpy as np

    from graphloom.llm import shingles as S

    r = np.random.default_rng(5)
    for n, m in ((1, 1), (60, 70), (300, 260), (1000, 1030), (2000, 2100)):
        both = r.integers(0, 2**63, n // 2).astype(np.uint64)
        x, y = (np.concatenate([both, r.integers(0, 2**63, k - len(both)).astype(np.uint64)]) for k in (n, m))
        bits = S._parity(np.concatenate([x, y]), np.repeat([0, 1], [n, m]), np.array([n, m])).to_pylist()
        differ = len({*x.tolist()} ^ {*y.tolist()})
        assert S._apart(*bits) <= differ and S._apart(bits[0], bits[0]) == 0
        assert n < 64 or S._apart(*bits) > 0.3 * min(n, m)  # enough bits to tell most pairs apart


def test_rows_of_a_common_part_meet_the_others_only():
    import numpy as np

    from graphloom.llm import shingles as S

    r = np.random.default_rng(7)
    for _ in range(20):
        size = r.integers(1, 200, 6)
        bounds = np.append(0, np.cumsum(size))
        part = np.concatenate([np.where(r.random(k) < r.choice([0.1, 0.6, 0.95]), 9, r.integers(0, 5, k)) for k in size])
        lo, hi = (np.repeat(r.choice(x, 6), size) for x in ([0], [0, 1]))
        own = np.where(r.random(len(part)) < 0.5, lo, hi)
        got = [(min(i, j), max(i, j)) for a, b in S._pairs_of_parts(bounds, part, own, lo, hi) for i, j in zip(a.tolist(), b.tolist()) if part[i] != part[j]]
        want = [(i, j) for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b) for j in range(i + 1, b) if part[i] != part[j] and (lo[i] == hi[i] or own[i] != own[j])]
        assert sorted(got) == want


def test_sets_below_the_threshold_make_no_pairs_and_links_few(spark):
    from graphloom.llm import shingles as S

    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    lines = [" ".join(r.choices(words, k=20)) for _ in range(30)]
    texts = [" ".join(lines[k] for k in sorted(r.sample(range(30), 23))) for _ in range(80)]  # most pairs: 0.5 to 0.75 alike
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.sets(df, "doc_id", "text", 5)
    alone = rows.select("id", F.col("node").alias("part")).where("false")
    found = S.rest(rows, alone, df, "text", 5).count()
    s = [shingles(t) for t in texts]
    links = sum(9 * len(s[i] & s[j]) >= 4 * (len(s[i]) + len(s[j])) for i in range(80) for j in range(i))
    assert links <= found <= 3 * links + 100  # 3,160 pairs, which share some ten first shingles each


def test_wide_parity_bits_differ_as_those_of_one_pair():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import shingles as S

    r = np.random.default_rng(6)
    bits = [r.bytes(8 << k) for k in (0, 1, 1, 3, 4, 0, 6)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(7)))
    got = S._Wide(pa.chunked_array([pa.array(bits[:3]), pa.array(bits[3:])])).apart(i, j)
    assert got.tolist() == [S._apart(bits[a], bits[b]) for a, b in zip(i, j)]
