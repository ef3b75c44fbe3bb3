import zlib

import numpy as np
import pytest

from graphloom.llm import langid, queries


def test_held_out_accuracy_and_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == {*docs} and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the cat sat"), (4, "the cat sat"), (5, "el gato " * 30000), (None, "the dog"), (7, "ñ")]
    df = spark.createDataFrame([(i, t, "es" if "el gato" in (t or "") else "en", 1.0) for i, t in rows], "doc_id long, text string, lang string, score double")
    net = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, net, ["doc_id"]).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[5].lang_pred == "es"
    assert langid.fit(df.limit(0)) is None and {r.lang_pred for r in langid.predict(df, None, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), net, ["doc_id"]).count() == 0


def test_windows_cover_every_byte():
    offsets = np.array([0, 0, 5, 133, 1000])
    at, n, row = langid.windows(offsets)
    assert np.concatenate([np.arange(a, a + m) for a, m in zip(at, n)]).tolist() == list(range(1000))
    assert np.bincount(row, minlength=4).tolist() == [0, 1, 1, 7]


def plain(net, text):
    """Mean probabilities of a text's windows, one multiplication after another."""
    data, total = text.encode(), np.zeros(len(net.labels))
    for a in range(0, len(data), langid.WINDOW):
        window, top = data[a : a + langid.WINDOW], []
        for f, width in enumerate(net.width):
            seen = []
            for i in range(max(1, len(window) - width + 1)):
                x = [window[i + k] if i + k < len(window) else 256 for k in range(width)]
                seen.append(sum(float(net.embed[b, e]) * float(net.bank[k * langid.EMBED + e, f]) for k, b in enumerate(x) for e in range(langid.EMBED)))
            top.append(max(0.0, max(seen) + float(net.bias[f])))
        z = np.array([sum(t * float(net.out[f, c]) for f, t in enumerate(top)) + float(net.out_bias[c]) for c in range(len(net.labels))])
        p = np.exp(z - z.max())
        total += len(window) * p / p.sum()
    return total / len(data)


def test_prediction_equals_a_plain_network(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs)
    texts = [r.text[:n] for r, n in zip(docs.where("length(text) > 700").orderBy("doc_id").limit(8).collect(), (3, 40, 127, 128, 129, 200, 300, 700))]
    got = langid.predict(spark.createDataFrame(list(enumerate([*texts, "é", "ß!"])), "doc_id long, text string"), net, ["doc_id"])
    for r, text in zip(sorted(got.collect()), [*texts, "é", "ß!"]):
        want = plain(net, text)
        assert abs(r.score - want.max()) < 1e-4 and r.lang_pred == net.labels[int(want.argmax())]


def test_every_language_is_learned_and_the_sample_covers_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid.Network, "train", lambda self, x, lengths, y: seen.update(labels=self.labels, x=x, lengths=lengths, y=y))
    rows = [(i, f"text {i} " * 3, f"l{i:03}") for i in range(201)] + [(900, "a" * 12_800 + "b" * 12_799, "long"), (900, "a" * 12_800 + "b" * 12_799, "long")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen["labels"]) == 202 and sorted(set(seen["y"].tolist())) == list(range(202))
    mine = seen["x"][seen["y"] == seen["labels"].index("long")]
    assert len(mine) == 200 and (mine[:, 0] == ord("a")).sum() == 100 and sorted(seen["lengths"])[-1] == 128
    monkeypatch.setattr(langid, "SAMPLE", 50)
    langid.fit(spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string"))
    mine = seen["x"][seen["y"] == seen["labels"].index("long")]
    assert len(mine) == 50 and 10 < (mine[:, 0] == ord("a")).sum() < 40
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages_whose_rows_repeat_are_learned_as_a_whole(spark, monkeypatch):
    """Repeats are counted once: neither one text 200,000 times nor 40 texts 1,000 times each lose windows or languages."""
    seen = {}
    monkeypatch.setattr(langid.Network, "train", lambda self, x, lengths, y: seen.update(labels=self.labels, y=y))
    from pyspark.sql import functions as F

    one = spark.range(200_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("ein Text immer wieder").alias("text"), F.lit("de").alias("lang"))
    some = spark.range(40_000).select((F.col("id") % 40 + 1000).alias("doc_id"), F.concat(F.lit("un texte "), (F.col("id") % 40).cast("string")).alias("text"), F.lit("fr").alias("lang"))
    other = spark.range(200).select((F.col("id") + 2000).alias("doc_id"), F.concat(F.lit("a text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    langid.fit(one.unionByName(some).unionByName(other))
    assert seen["labels"] == ["de", "en", "fr"] and np.bincount(seen["y"]).tolist() == [1, 200, 40]


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"])
    for p in ("embed", "bank", "bias", "out", "out_bias"):
        setattr(net, p, getattr(net, p).astype(float))
    x, y, n = r.integers(97, 110, (6, langid.WINDOW + 3)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2]), np.array([128, 5, 1, 77, 128, 3])
    x[np.arange(x.shape[1])[None] >= n[:, None]] = 256
    w = np.ones(3)

    def loss():
        h = np.where(net._outside(n), -np.inf, np.einsum("nlk,kf->nlf", np.lib.stride_tricks.sliding_window_view(net.embed[x].reshape(6, -1), 4 * langid.EMBED, axis=1)[:, :: langid.EMBED][:, : langid.WINDOW], net.bank))
        z = np.maximum(h.max(axis=1) + net.bias, 0) @ net.out + net.out_bias
        return -np.mean((z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(6), y])

    g = net._gradients(x, n, y, w)
    for p in g:
        a = getattr(net, p)
        for i in {tuple(int(r.integers(s)) for s in a.shape) for _ in range(5)}:
            if p == "bank" and not net.mask[i]:
                continue
            was, e = a[i], 1e-5
            a[i] = was + e
            up = loss()
            a[i] = was - e
            assert abs((up - loss()) / (2 * e) - g[p][i]) < 1e-3
            a[i] = was
