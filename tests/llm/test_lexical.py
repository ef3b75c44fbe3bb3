import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    kept = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(kept), sum(len(ts) for _, ts in kept)
    df = Counter(t for _, ts in kept for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for i, ts in kept:
            tf, m = Counter(ts), 100 - 25 + 25 * len(ts) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i, s))
        out += [(item, n, x[3], x[4]) for n, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_terms_are_the_pattern_s():
    r = random.Random(2)
    for _ in range(500):
        x = "".join(chr(r.choice([r.randrange(128), r.randrange(0x3000)])) for _ in range(60))
        assert [t.decode() for t in lexical.terms(x.encode())] == words(x)


@pytest.mark.parametrize("held,products,passes", [(200_000, 4_000_000, 200_000), (5, 40, 30)])
def test_rows_of_all_kinds_equal_brute_force(spark, monkeypatch, held, products, passes):
    """Skewed words, ties, copies, nulls, a very long text; with tiny steps and several passes too."""
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "PRODUCTS", products)
    monkeypatch.setattr(lexical, "TERMS", passes)
    r = random.Random(11)
    pool = [f"w{k}" for k in range(60)] + ["É", "日本", "THE"]
    weights = [1 / (k + 1) for k in range(len(pool))]
    docs = [(k, " ".join(r.choices(pool, weights, k=r.randint(0, 40)))) for k in range(300)]
    docs += [(1000 + k, "w7 w9 w9 the W50") for k in range(60)] + [(2000, None), (2001, ""), (2002, "!?"), (None, "w59 w58 w57"), (2003, "w3 w40 " * 20000)]
    items = [(k, " ".join(r.choices(pool, k=r.randint(1, 12)))) for k in range(25)] + [(90, None), (91, "..."), (None, "w9 W9 the"), (92, "nowhere"), (93, "w50 w50"), (93, "w50 w50")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, score string").repartition(7)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    for k in (1, 20):
        got = lexical.ranked(d, q, k).collect()
        assert sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in got), key=repr) == brute(docs, items, k)
    assert lexical.ranked(d.limit(0), q).collect() == [] and lexical.ranked(d, q.limit(0)).collect() == []
    assert lexical.ranked(d.where("doc_id in (2000, 2001)"), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_string_ids_and_all_documents_alike(spark):
    d = spark.createDataFrame([(f"d{k:03}", "a b c") for k in range(90)], "doc_id string, text string").repartition(5)
    q = spark.createDataFrame([("i", "a c")], "item_id string, text string")
    got = lexical.ranked(d, q).collect()
    # Every document holds every term: weights are floor(1000 ln(182 / 181)) = 5 each.
    assert [(x.rank, x.doc_id) for x in sorted(got, key=lambda x: x.rank)] == [(k + 1, f"d{k:03}") for k in range(20)]


def test_thresholds_are_safe_and_cut_terms(spark, sf):
    """Every item's threshold is at most its K-th score, and the terms that do not lead stay below it together."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    every = lexical.asked(items, "item_id", "text")
    vocabulary = sorted(bytes(r.term) for r in every.select("term").distinct().collect())
    postings = lexical.index(docs, vocabulary)
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.selectExpr("explode(terms) AS t").groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    total = postings.selectExpr("count(*) AS n", "sum(n) AS l").first()
    stored = lexical.impacts(postings, lexical.Weights(total.n, total.l, df))
    rows = lexical.seeded(lexical.numbered(every, vocabulary), stored).collect()
    name = {r.q: r.item_id for r in every.collect()}
    kth = {r.item_id: r.score for r in lexical.ranked(docs, items).collect() if r["rank"] == 20}
    assert all(r.threshold <= kth.get(name[r.q], 1 << 62) for r in rows) and all(r.rest < r.threshold or not r.rest for r in rows)
    assert any(r.threshold for r in rows) and any(not r.leads for r in rows)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP11_SQL})").fetchall())
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in queries.op11_lexical_search(spark, sf).collect())
    assert got == want and len(got) > 100
