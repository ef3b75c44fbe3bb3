"""Language identification with a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes.  Each byte is embedded; filters of several widths slide over the window,
each keeps its largest response (max pooling over the positions that lie within the text), and a softmax layer turns
these into language probabilities.  A text's probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 8
#: Training takes this many windows of each language's whole labelled texts at most, those with the smallest hashes, and
#: this many windows (of WINDOW bytes) in all, in equal parts; and this many updates at least.
SAMPLE, MOST_SAMPLE, UPDATES, SEED = 4000, 400_000, 550, 20240601
#: More distinct labels than this are an error: they are no languages.
MOST_LANGUAGES = 5000
_PAD = 3  # bytes read past a window by the widest filter
_STEP = 1024  # windows in one numpy step


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the windows that cut every row whole."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[row] + nth * WINDOW
    return at, np.minimum(WINDOW, offsets[row + 1] - at), row


class Network:
    """Parameters: byte embeddings [257, EMBED] (256 is padding), one bank of filters, a softmax layer."""

    def __init__(self, labels: list[str]):
        r = np.random.default_rng(SEED)
        self.labels = labels
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        total = FILTERS * len(WIDTHS)
        self.bank = np.zeros((max(WIDTHS) * EMBED, total), np.float32)
        self.mask = np.zeros_like(self.bank)
        for k, w in enumerate(WIDTHS):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            self.mask[: w * EMBED, at] = 1
            self.bank[: w * EMBED, at] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
        self.width = np.repeat(WIDTHS, FILTERS)
        self.bias = np.zeros(total, np.float32)
        self.out = r.normal(0, total**-0.5, (total, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _responses(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """[n, WINDOW, filters] of [n, WINDOW + _PAD] byte numbers; two gathers of two bytes each feed one product."""
        two = x[:, :-1].astype(np.int32) * 257 + x[:, 1:]
        seen = np.empty((len(x), WINDOW, 2, 2 * EMBED), np.float32)
        np.take(pairs, two[:, :WINDOW], axis=0, out=seen[:, :, 0], mode="clip")
        np.take(pairs, two[:, 2 : WINDOW + 2], axis=0, out=seen[:, :, 1], mode="clip")
        return (seen.reshape(-1, 4 * EMBED) @ self.bank).reshape(len(x), WINDOW, -1)

    def pairs(self) -> np.ndarray:
        e = self.embed
        return np.concatenate([np.repeat(e, 257, axis=0), np.tile(e, (257, 1))], axis=1)

    def _outside(self, lengths: np.ndarray) -> np.ndarray:
        """Positions at which a filter would leave the text; at least one position always counts."""
        last = np.maximum(lengths[:, None] - self.width[None, :], 0)
        return np.arange(WINDOW)[None, :, None] > last[:, None, :]

    def probabilities(self, x: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        h = self._responses(x, pairs)
        short = np.flatnonzero(lengths < WINDOW + _PAD)
        short = short[lengths[short] < WINDOW]
        if len(short):
            h[short] = np.where(self._outside(lengths[short]), -np.inf, h[short])
        top = h[:, : WINDOW - _PAD].max(axis=1)
        if len(short):
            top[short] = h[short].max(axis=1)
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy, with languages weighted to count alike."""
        r, params = np.random.default_rng(SEED), ("embed", "bank", "bias", "out", "out_bias")
        m, v, t = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(self.labels)).astype(np.float32)
        while t < UPDATES:  # passes over the sample, as many as its size needs
            order = r.permutation(len(y))
            for a in range(0, len(y), 128):
                i = order[a : a + 128]
                g, t = self._gradients(x[i], lengths[i], y[i], weight), t + 1
                for p in params:
                    m[p] = 0.9 * m[p] + 0.1 * g[p]
                    v[p] = 0.999 * v[p] + 0.001 * g[p] ** 2
                    step = 0.01 * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, p, (getattr(self, p) - step).astype(np.float32))

    def _gradients(self, x, lengths, y, weight) -> dict[str, np.ndarray]:
        n, total = len(x), self.bank.shape[1]
        h = np.where(self._outside(lengths), -np.inf, self._responses(x, self.pairs()))
        at = h.argmax(axis=1)
        a = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + self.bias
        relu = np.maximum(a, 0)
        z = relu @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        d = p * weight[y][:, None] / n
        back = (d @ self.out.T) * (a > 0)
        taken = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        seen = self.embed[taken].reshape(n, total, -1)
        bank = np.einsum("nf,nfk->kf", back, seen) * self.mask
        spread = (back[:, :, None] * self.bank.T[None]).reshape(n, total, max(WIDTHS), EMBED)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, taken.reshape(-1), spread.reshape(-1, EMBED))
        return {"out": relu.T @ d, "out_bias": d.sum(axis=0), "bias": back.sum(axis=0), "bank": bank, "embed": embed}


def _bytes_at(buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[n, WINDOW + _PAD] byte numbers; 256 past each window's end."""
    reach = np.arange(WINDOW + _PAD)
    x = np.concatenate([buf, np.zeros(WINDOW + _PAD, np.uint8)])[at[:, None] + reach].astype(np.int16)
    if (lengths < WINDOW + _PAD).any():
        x[reach[None, :] >= lengths[:, None]] = 256
    return x


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Network | None:
    """Learns from the rows given with non-null text and language; None if there are none.

    The sample is of windows of the whole texts: those with the smallest hashes of id, text and place, repeated rows taken
    once, so it does not depend on the order of rows.  Windows are counted by language first, and a hash over what a
    language's part of the sample needs (with six standard deviations to spare) is left out in the scan, so no language
    is one large group however many rows it has.  Raises if there are more than MOST_LANGUAGES labels, or if a label should be
    left without a window.
    """
    size = F.octet_length(text_col)
    rows = docs.where(F.col(text_col).isNotNull() & (size > 0) & F.col(lang_col).isNotNull())
    rows = rows.select(F.xxhash64(F.lit(SEED), key_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.ceil(size / WINDOW).cast("int").alias("n"))
    single = rows.select("lang", "h", "n").distinct()  # a hash stands for a row and its repeats
    counts = single.groupBy("lang").agg(F.sum("n").alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    most = min(SAMPLE, MOST_SAMPLE // len(counts))
    spare = most + 6 * most**0.5
    cut = {r["lang"]: (1 << 63) - 1 if r["count"] <= spare else int(spare / r["count"] * 2.0**64) - (1 << 63) for r in sorted(counts)}
    limit = F.try_element_at(F.create_map(*(x for name, h in cut.items() for x in (F.lit(name), F.lit(h).cast("long")))), F.col("lang"))
    found = rows.withColumn("limit", limit).select("lang", "h", "limit", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
    found = found.withColumn("by", F.xxhash64("h", "w")).where("by <= limit")
    found = found.select("lang", "by", "h", "w", F.substring(F.col("text").cast("binary"), F.col("w") * WINDOW + 1, F.lit(WINDOW)).alias("data"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("by", "h", "w"))
    found = found.distinct().withColumn("nth", nth).where(F.col("nth") <= most).orderBy("lang", "nth")
    sample = found.select("lang", "data").toArrow().to_pylist()
    labels = sorted({x["lang"] for x in sample})
    if len(labels) < len(counts):
        raise RuntimeError("a language is not in the sample")
    data = np.frombuffer(b"".join(x["data"].ljust(WINDOW, b"\0") for x in sample), np.uint8).reshape(-1, WINDOW)
    lengths = np.array([len(x["data"]) for x in sample])
    number = {name: k for k, name in enumerate(labels)}
    y = np.array([number[x["lang"]] for x in sample])
    x = np.full((len(data), WINDOW + _PAD), 256, np.int16)
    x[:, :WINDOW] = np.where(np.arange(WINDOW)[None] < lengths[:, None], data, 256)
    net = Network(labels)
    net.train(x, lengths, y)
    return net


def predict(docs: DataFrame, net: Network | None, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(*id_cols, lang_pred, score) of every row, from its whole text.

    score is the predicted language's mean probability, 0 to 1.  ``und`` with score 0: the text is null or has no letter
    (Unicode), or nothing was learned.  Ties go to the first label in order.  Repeated rows are predicted alike; null
    ids and other columns are carried or left alone.  An empty table gives no rows.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    carried = [*id_cols] if text_col in id_cols else [*id_cols, text_col]  # the text goes to Python once
    at_text = carried.index(text_col)
    rows = docs.select(*carried, letter)
    model = pickle.dumps(net)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols) + ", lang_pred string, score double"

    def run(batches):
        net = pickle.loads(model)
        pairs = net.pairs() if net else None
        for batch in batches:
            texts, n, letter = batch.column(at_text), batch.num_rows, batch.column(batch.num_columns - 1)
            if letter.false_count:
                texts = pc.if_else(letter, texts, None)
            pred, score = np.full(n, "und", object), np.zeros(n)
            if net and n:
                buf, offsets = K.flat(texts)
                total = np.zeros((n, len(net.labels)))
                for a, b in K.slices(offsets):
                    part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    starts, lengths, row = windows(at)
                    order = np.argsort(lengths < WINDOW, kind="stable")
                    for c in range(0, len(order), _STEP):
                        i = order[c : c + _STEP]
                        p = net.probabilities(_bytes_at(part, starts[i], lengths[i]), lengths[i], pairs)
                        np.add.at(total, a + row[i], p * lengths[i][:, None])
                full = np.flatnonzero(np.diff(offsets))
                mean = total[full] / total[full].sum(axis=1, keepdims=True)
                pred[full] = np.array(net.labels, object)[mean.argmax(axis=1)]
                score[full] = mean.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0))], names=[*id_cols, "lang_pred", "score"])

    return in_arrow(rows, run, schema)
