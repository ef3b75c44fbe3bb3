import duckdb
import numpy as np
import pytest

from graphloom.llm import pq, queries


def brute(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread", [3, 500, 1 << 25])
def test_nearest_equals_int64_with_many_ties(spread):
    r = np.random.default_rng(4)
    for d in (1, 4, 7):
        x, book = r.integers(-spread, spread, (3000, d)), r.integers(-spread, spread, (64, d))
        book[40] = book[3]  # equal entries: the lower index
        x[:50] = book[r.integers(0, 64, 50)]
        index, off = pq.nearest(x, book)
        want, least = brute(x, book)
        assert (index == want).all() and (off == least).all()


def test_values_that_float32_cannot_tell_apart():
    """All entries within the rounding error of one another: the screening keeps them open, int64 decides."""
    base = (1 << 25) + 3
    book = np.array([[base + k, base - k] for k in range(64)])
    x = np.array([[base + k, base + 1 - k] for k in range(64)])
    index, off = pq.nearest(x, book)
    want, least = brute(x, book)
    assert (index == want).all() and (off == least).all()


def plain(rows):
    """The definition in Python's integers: {(id, label): [(code, error, label_error)]} and the digest."""
    import hashlib

    kept = [(i, [int(np.floor(256 * float(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    parts = [[r[1][p * w : (p + 1) * w] for r in kept] for p in range(16)]
    books = [xs[:64] for xs in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            at = [near(x, books[p])[1] for x in parts[p]]
            books[p] = [[sum(x[i] for x, a in zip(parts[p], at) if a == k) // at.count(k) for i in range(w)] if k in at else c for k, c in enumerate(books[p])]
    found = [[near(x, books[p]) for x in parts[p]] for p in range(16)]
    code = ["".join(f"{found[p][n][1]:02x}" for p in range(16)) for n in range(len(kept))]
    error = [sum(found[p][n][0] for p in range(16)) for n in range(len(kept))]
    total = {r[2]: sum(e for e, q in zip(error, kept) if q[2] == r[2]) for r in kept}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr(r[0]), c, e, total[r[2]], sha) for r, c, e in zip(kept, code, error))


def test_rows_of_all_kinds_equal_the_definition(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=32), 2)], None if i % 3 == 0 else int(i % 2)) for i in range(150)]
    rows += [(5, rows[5][1], 0), (7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[0][1], 9), (-1, [0.0] * 32, 4), (-2, None, 1), (-3, [1.0] * 31 + [None], 1), (-4, [1.0] * 31 + [float("nan")], 1), (-5, [float("-inf")] * 32, 1)]
    df = spark.createDataFrame([(i, v, label, "x", 3) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, _id int").repartition(5)
    for most in (pq.LABELS_BROADCAST, 1):
        monkeypatch.setattr(pq, "LABELS_BROADCAST", most)
        got = sorted((repr(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in pq.encoded(df).collect())
        assert got == plain(rows)
    assert pq.encoded(df.limit(0)).collect() == []
    assert pq.encoded(df.where("vec_id = -2")).collect() == []
    few = [x for x in rows if x[0] in (3, 4)]
    got = sorted((repr(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in pq.encoded(df.where("vec_id in (3, 4)")).collect())
    assert got == plain(few)


def test_lengths_and_sizes(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.5] * 32, 1), (3, [], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in pq.encoded(df).collect()}
    assert len(got) == 3 and len({r.codebooks_sha256 for r in got.values()}) == 3 and all(r.error == 0 and r.code == "00" * 16 for r in got.values())
    for bad in ([1.0] * 17, [float(1 << 18)] * 16):
        with pytest.raises(Exception, match="parts|component"):
            pq.encoded(df.unionByName(spark.createDataFrame([(4, bad, 1)], df.schema))).collect()


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLES['op12_vector_codes']})").fetchall())
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op12_vector_codes(spark, sf).collect())
    assert got == want and len(got) > 400
