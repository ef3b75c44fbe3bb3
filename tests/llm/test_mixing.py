import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import mixing


def draw(seed, i, mean):
    pieces = max(1, math.ceil(mean / 500))
    total = 0
    for p in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}|{'' if i is None else i}|{p}".encode()).hexdigest()[:13], 16) / 2**52
        term = c = math.exp(-mean / pieces)
        k = 0
        while c <= u:
            k += 1
            term *= mean / pieces / k
            c += term
            total += 1
            if k > mean and term < 1e-30:  # past the mode; before it, the terms of a large mean are smaller still
                break
    return total


def test_counts_are_hash_seeded_poisson_draws(spark, monkeypatch):
    rows = [(i, f"t{i}", "hot") for i in range(300)] + [(1000 + i, None, "b") for i in range(20)] + [(2000, "x", "one"), (2001, "y", None), (None, "z", None), (2001, "y", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, n_copies int")
    weights = spark.createDataFrame([("hot", 1.0), ("b", 1.0), ("one", 20.0), (None, 2.0)], "source string, weight double")
    rate = mixing.rates(df, weights, F.lit(2400))
    means = {r.source: r.rate for r in rate.collect()}
    assert {k: round(v, 9) for k, v in means.items()} == {"hot": round(100 / 300, 9), "b": 5.0, "one": 2000.0, None: round(200 / 3, 9)}
    for most in (20_000, 0):
        monkeypatch.setattr(mixing, "SOURCES_BROADCAST", most)
        got = mixing.mixed(df, rate, seed=3).collect()
        want = Counter()
        for i, t, s in rows:
            want[(i, t, s)] += draw(3, i, means[s])
        assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
        assert all(1 <= r.copy_number <= r.n_copies for r in got)


def test_no_python_in_the_plan_and_empty_table(spark, sf):
    df = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0
