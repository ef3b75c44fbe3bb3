import numpy as np
import pytest

from graphloom.llm import itq


def brute(ids, vectors, cosine=0.9):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = len(ids), [set() for _ in ids]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if ids[i] is not None and ids[j] is not None and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.float32(a).astype(float), np.float32(b).astype(float)
                if np.array_equal(a, b) or a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out.append((ids[i], len(links[i]), None if ids[i] is None else min(ids[j] for j in seen)))
    return sorted(out, key=repr)


def rows(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in frame.collect()), key=repr)


def near_groups(seed, groups, size, noise, d=64, alone=150):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    v = [c + noise * r.normal(size=d) for c in centres for _ in range(size)] + list(r.normal(size=(alone, d)))
    return [x.tolist() for x in v]


@pytest.mark.parametrize("most", [1024, 7])
def test_tight_groups_and_copies_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(itq, "BLOCK", most)
    v = near_groups(1, 8, 12, 0.15, alone=40) + near_groups(2, 1, 1, 0, alone=1) * 20
    ids = list(range(len(v)))[::-1]
    df = spark.createDataFrame(list(zip(ids, v, ["x"] * len(v))), "vec_id long, embedding array<float>, n_links string")
    assert rows(itq.near(df)) == brute(ids, v)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    v = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.01, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.01]]
    ids = [1, 1, 2, 1, 7]
    df = spark.createDataFrame(list(zip(ids, v)), "vec_id long, embedding array<double>")
    assert rows(itq.near(df)) == brute(ids, v)


def test_shape_keeps_its_chances_at_every_size():
    import math

    for n in (2, 1 << 20, 1 << 26, 1 << 30):
        bits, tables, most = itq.shape(n, 0.9)
        hit = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - hit) ** tables >= itq.RECALL and n / 2**bits <= itq.STRANGERS and 18 < most < 40
        at = itq.segments(bits, tables)
        used = (at[:, None] + np.arange(bits)).reshape(-1)
        assert len(at) == tables and len(set(used.tolist())) == len(used)


def test_odd_vectors(spark):
    v = [None, [], [0.0] * 3, [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [2.0, -0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]
    ids = [*range(11), None, 6]
    df = spark.createDataFrame(list(zip(ids, v)), "vec_id long, embedding array<float>")
    assert rows(itq.near(df)) == brute(ids, v)
    assert itq.near(df.limit(0)).count() == 0
    assert rows(itq.near(df.where("vec_id < 3"))) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("least_bits", [16, 26])
def test_near_finds_pairs_at_the_threshold_among_more_than_4096_vectors(spark, monkeypatch, least_bits):
    """End to end, at the segments of a million vectors and at those of a billion."""
    monkeypatch.setattr(itq, "LEAST_BITS", least_bits)
    r = np.random.default_rng(11)
    a = r.normal(size=(2200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.9005, 0.92, (len(a), 1))
    v = np.concatenate([a, c * a + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = np.zeros(len(v), int)
    for x in itq.near(df).select("vec_id", "n_links").collect():
        got[x.vec_id] = x.n_links
    assert len(v) > 4096 and (got <= want).all() and got.sum() >= 0.995 * want.sum()


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    seen = []

    def none(nodes, d, n, cosine):
        seen.append((d, n))
        return spark.createDataFrame([], "node long, links long, other long")

    monkeypatch.setattr(itq, "_links", none)
    v = [[1.0] * d for d in range(1, 71)] + [[1.0] * (d - 1) + [2.0] for d in range(2, 71)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert itq.near(df).count() == len(v) and seen == [(d, 2) for d in range(2, 71)]
