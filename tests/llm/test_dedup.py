import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import components, hamming, kernels, queries, recipes, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "Onetwo"), (7, "x" * 9000), (8, "x " * 9000), (9, "a b c d"),
    (10, "a b c d"), (10, "a b c d"), (11, "É b c"), (12, "long " * 20000), (13, "long " * 20000 + "end"), (14, "lo ng " * 20000), (None, "null id"), (None, None),
]


def fingerprint(text):
    t = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    g = [" ".join(t[i : i + 3]) for i in range(len(t) - 2)] or ([" ".join(t)] if t else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(prints, most=3):
    """prints: (id, fingerprint) -> smallest id reachable, by plain search over distinct fingerprints."""
    names = {}
    for i, f in prints:
        names[f] = min(x for x in (names.get(f), i) if x is not None) if (names.get(f), i) != (None, None) else None
    nodes = [f for f in names if names[f] is not None]
    found = {}
    for f in nodes:
        if f not in found:
            group, todo = {f}, [f]
            while todo:
                x = todo.pop()
                new = {g for g in nodes if (g ^ x).bit_count() <= most} - group
                group |= new
                todo += new
            least = min(names[g] for g in group)
            found |= dict.fromkeys(group, least)
    return [found.get(f) for _, f in prints]


def test_simhash_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(i, fingerprint(t)) for i, t in docs]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(prints, classes(prints))}
    assert {tuple(r) for r in queries.op6_simhash_neardup(spark, sf).collect()} == want


def test_simhash_odd_rows(spark):
    prints = [(i, fingerprint(t)) for i, t in ODD]
    want = sorted(((i, f, c) for (i, f), c in zip(prints, classes(prints))), key=repr)
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, component string")
    got = [(r.id, r.f0 % 2**64, r.component) for r in simhash.classes(df).collect()]
    assert sorted(got, key=repr) == want
    assert simhash.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("words64, most_bits", [(1, 3), (2, 7)])
def test_pigeonring_links_random_codes_as_brute_force_does(spark, monkeypatch, words64, most_bits):
    r = random.Random(4)
    codes = [r.getrandbits(64 * words64) for _ in range(60)]
    for _ in range(600):
        x = r.choice(codes)
        for k in r.sample(range(64 * words64), r.choice([1, 2, 3, 3, 4, 5, 7, 8])):
            x ^= 1 << k
        codes.append(x)
    prints = list(enumerate(dict.fromkeys(codes)))
    words = lambda f: [int(np.uint64(f >> 64 * k & (2**64 - 1)).view(np.int64)) for k in range(words64)]
    df = spark.createDataFrame([(i, *words(f)) for i, f in prints], "id long, " + ", ".join(f"f{k} long" for k in range(words64)))
    want = classes(prints, most_bits)
    for most in (4096, 5):  # in one block, and split
        monkeypatch.setattr(hamming, "BLOCK", most)
        got = {r.node: r.component for r in components.components(simhash.links(df, words64, most_bits)).collect()}
        assert [got.get(i, i) for i, _ in prints] == want
    with pytest.raises(ValueError):
        simhash.links(df, words64, 4 * words64)


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(5, k) for k in range(6, 60)] + [(7, 7), (3, 4), (4, 3)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for a, b in edges]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1000 for k in range(1000, 1101)} | {k: 5 for k in (5, *range(6, 60))} | {3: 3, 4: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        same = [(-len(t or ""), j is None, j or 0) for (j, t), m in zip(rows, norm) if m == n]
        keep = min(same)
        keep = None if keep[1] else keep[2]
        out.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_recipes_equal_brute_force_with_and_without_colliding_identifiers(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in ODD], "doc_id long, text string, recipe int")
    for bits in (64, 2):
        got = recipes.classes(df, id_bits=bits).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted((tuple(x) for x in got), key=repr) == exact(ODD)
    assert recipes.classes(df.limit(0)).count() == 0


def test_deduplicated_keeps_one_row_of_each_group_and_the_columns(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in ODD], "doc_id long, text string, _nth int")
    got = recipes.deduplicated(df)
    assert got.columns == df.columns
    want = {(k, s) for _, k, _, _, s in exact(ODD)}
    assert len(want) == got.count() and {r.doc_id for r in got.collect()} == {k for k, _ in want}


def test_cuts_follow_content():
    r = np.random.default_rng(1)
    a = r.integers(97, 123, 100_000).astype(np.uint8)
    b = np.concatenate([r.integers(97, 123, 777).astype(np.uint8), a])
    x, y = (recipes.cuts(v, np.array([0, len(v)]))[0] for v in (a, b))
    assert x[-1] == len(a) and all(m - n <= recipes.MOST for n, m in zip([0, *x], x))
    assert len({*(k - len(a) for k in x)} & {*(k - len(b) for k in y)}) > 0.7 * len(x)


def test_xxh64_kernel():
    r = random.Random(1)
    parts = [bytes(r.choices(range(256), k=n)) for n in [*range(0, 140), 255, 256, 257, 3000]]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    got = kernels.xxh64(buf, end - [len(p) for p in parts], end, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_the_least_long_is_an_id_like_any_other(spark):
    from graphloom.llm import recipes

    least = -(1 << 63)
    df = spark.createDataFrame([(5, "a b"), (least, "ab"), (least, "b a"), (None, "a  b"), (7, "ab")], "doc_id long, text string")
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in recipes.classes(df).collect()), key=repr)
    assert got == sorted([(5, None, 4, False), (least, None, 4, False), (None, None, 4, True), (7, None, 4, False), (least, least, 1, True)], key=repr)
    got = {(r.id, r.keep_id) for r in recipes.classes(df.where("text = 'ab'")).collect()}
    assert got == {(least, least), (7, least)}
