"""Language-model scoring by deleted interpolation.

    P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),    b: the bucket of the context's frequency c(v)

The weights of each bucket are learned by expectation-maximisation on counts of a deleted part of the training text,
with the estimates taken from the rest.

How it runs.  Documents are dealt into folds and groups by hashes of their id and text; how many groups there are
follows from the bytes of text and does not change a result.  A group asks for each n-gram once: it
sends its sorted 64-bit n-gram hashes with its own counts, cut into ranges; whoever holds a range adds up all groups'
counts and answers each group in the order in which it asked, so answers carry no keys.  A group then scores its
documents with numpy.  Traffic is one key per distinct n-gram and group, and a frequent n-gram is one key there too.
N-grams of one kind that share their 63 bits of hash are counted as one (a chance of n * n / 2 ** 64 for n of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_arrow, partitions, written

#: A document's hash gives it one of so many folds; the first is the deleted part.  A group has documents of one fold.
FOLDS = 7
#: Bytes of text of a group, about: what a worker holds as arrays at a time (some 20 bytes a byte of text).
GROUP_BYTES = 24 << 20
#: Context frequencies share a bucket by their binary logarithm.
BUCKETS = 40
#: Bins a decade for held-out estimates, and the lowest decade.
BINS, DECADES = 8, 15
ROUNDS = 60
_END = np.uint64(0xD1B54A32D192ED03)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, lowest first; planes above the highest that is used are left out."""
    most = int(x.max(initial=0))
    width = max(1, (most.bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Grams:
    """The n-gram keys of a group's documents: unigram keys are even, bigram keys odd."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list = []
        self.train: list[bool] = []
        self.held: list = []
        self.counts: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: pa.Array, train: pa.Array, held: pa.Array | None = None) -> None:
        buf, offsets = K.flat(texts)
        self.ids.append(ids)
        self.held.append(held)
        self.train.append(train.to_numpy(zero_copy_only=False).astype(bool))
        for a, b in K.slices(offsets):
            part = K.LOWER[buf[offsets[a] : offsets[b]]]
            starts, ends, first = K.tokens(part, offsets[a : b + 1] - offsets[a])
            words = K.xxh64(part, starts, ends, 1)
            n = np.diff(first) + 1  # the end is a token
            last = np.cumsum(n) - 1
            seq = np.full(int(n.sum()), _END)
            inner = np.ones(len(seq), bool)
            inner[last] = False
            seq[inner] = words
            before = np.empty_like(seq)
            before[1:] = seq[:-1]
            before[last - n + 1] = _END
            one = np.uint64(1)
            self.parts.append((seq & ~one, K.mix(K.mix(before, 3) ^ seq, 5) | one))
            self.counts.append(n)

    def arrays(self):
        """Unigram keys and bigram keys of all tokens in order, tokens of each document, training flags."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        return (*(np.concatenate(x) for x in zip(*self.parts, strict=True)), np.concatenate(self.counts), np.concatenate(self.train))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of an integer column of sorted batches; each comes with an iterator of its pieces."""
    now, held = None, []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if values[a] != now and held:
                yield now, held
                held = []
            now = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _ask(ranges: int):
    def run(batches):
        for group, pieces in _by_group(batches, "grp"):
            grams = Grams()
            for x in pieces:
                grams.add(x.column("id"), x.column("text"), x.column("train"))
            uni, bi, n, train = grams.arrays()
            del grams
            use = np.repeat(train, n)
            keys, _ = _distinct(np.concatenate([uni, bi]))
            mine, times = _distinct(np.concatenate([uni[use], bi[use]]))
            counts = np.zeros(len(keys), np.uint64)
            counts[np.searchsorted(keys, mine)] = times
            where = np.searchsorted(_part(keys, ranges), np.arange(ranges + 1))
            rows = [(r, a, b) for r, (a, b) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _, _ in rows], pa.int32()), pa.array([group] * len(rows), pa.int32()), pa.array([b - a for _, a, b in rows], pa.int32()),
                pa.array([int(keys[a]) - (1 << 63) for _, a, _ in rows], pa.int64()), pa.array([_pack(np.diff(keys[a:b])) for _, a, b in rows], pa.binary()), pa.array([_pack(counts[a:b]) for _, a, b in rows], pa.binary()),
            ], names=["part", "grp", "n", "least", "steps", "counts"])

    return run


_ASKED = "part int, grp int, n int, least long, steps binary, counts binary"
_ANSWERED = "grp int, part int, n int, counts binary, deleted binary, types long, tokens long, deleted_tokens long"


def _answer(batches):
    for part, pieces in _by_group(batches, "part"):
        asked = pa.Table.from_batches(pieces).to_pylist()
        keys = [np.concatenate([[np.uint64(x["least"] + (1 << 63))], _unpack(x["steps"], x["n"] - 1)]).cumsum(dtype=np.uint64) for x in asked]
        counts = [_unpack(x["counts"], x["n"]) for x in asked]
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts).astype(float)).astype(np.int64)
        fold = np.repeat([x["grp"] % FOLDS == 0 for x in asked], [x["n"] for x in asked])
        deleted = np.bincount(at[fold], np.concatenate(counts)[fold].astype(float), len(names)).astype(np.int64)
        uni, done, out = names % np.uint64(2) == 0, 0, []
        for x in asked:
            mine = at[done : done + x["n"]]
            done += x["n"]
            out.append((x["grp"], part, x["n"], _pack(total[mine]), _pack(deleted[mine]) if x["grp"] % FOLDS == 0 else None, 0, 0, 0))
        out.append((-1, part, 0, None, None, int((total[uni] > 0).sum()), int(total[uni].sum()), int(deleted[uni].sum())))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["grp", "part", "n", "counts", "deleted", "types", "tokens", "deleted_tokens"])


def _joined(batches, need_deleted: bool):
    """For each group of answers and documents: grams and the counts of each token's word, context and bigram."""
    for _, pieces in _by_group(batches, "grp"):
        grams, total, deleted = Grams(), [], []
        for x in pieces:
            is_doc = x.column("is_doc").to_numpy(zero_copy_only=False).astype(bool)
            split = int(np.searchsorted(is_doc, True))
            for row in x.slice(0, split).select(["n", "counts", "deleted"]).to_pylist():
                total.append(_unpack(row["counts"], row["n"]).astype(np.int64))
                if need_deleted:
                    deleted.append(_unpack(row["deleted"], row["n"]).astype(np.int64))
            if split < x.num_rows:
                docs = x.slice(split)
                grams.add(docs.column("id"), docs.column("text"), docs.column("train"), docs.column("held_out"))
        uni, bi, n, train = grams.arrays()
        if not len(n):
            continue
        keys, _ = _distinct(np.concatenate([uni, bi]))
        total = np.concatenate(total)
        if need_deleted:
            total = total - np.concatenate(deleted)
        word, pair = total[np.searchsorted(keys, uni)], total[np.searchsorted(keys, bi)]
        end = total[np.searchsorted(keys, _END & ~np.uint64(1))]
        context = np.concatenate([[0], word[:-1]])
        context[np.cumsum(n) - n] = end
        yield grams, n, train, word, context, pair


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 and up, BINS a decade."""
    return np.where(p > 0, np.clip(np.floor((np.log10(np.maximum(p, 1e-300)) + DECADES) * BINS), 0, DECADES * BINS) + 1, 0).astype(np.int64)


def learn(bins: np.ndarray, p0: float) -> np.ndarray:
    """Weights [BUCKETS, 3] for (bigram, unigram, uniform) from rows (bucket, count, sum of log10 p2, of log10 p1, p2 > 0,
    p1 > 0).  One pseudo-count for each part keeps every weight above zero; buckets without counts take the pooled
    weights."""
    shares = np.full((BUCKETS + 1, 3), 1 / 3)
    if not len(bins):
        return shares[:BUCKETS]
    count = bins[:, 1]
    p = np.stack([np.where(bins[:, 4 + k] > 0, 10 ** (bins[:, 2 + k] / count), 0) for k in range(2)] + [np.full(len(bins), p0)], axis=1)
    for bucket in (BUCKETS, *np.unique(bins[:, 0].astype(int))):
        mine = np.ones(len(bins), bool) if bucket == BUCKETS else bins[:, 0] == bucket
        share, q, c = shares[BUCKETS].copy(), p[mine], count[mine]
        for _ in range(ROUNDS):
            mixed = q * share
            got = (mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300) * c[:, None]).sum(axis=0) + 1
            share = got / got.sum()
        shares[bucket] = share
        if bucket == BUCKETS:
            shares[:BUCKETS] = share
    return shares[:BUCKETS]


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``train`` says which rows are learned from (null: not); ``held_out`` is carried (null: false), by default what is not
    learned from.  Tokens: A-Z lower-cased words without [\\x20\\x09-\\x0D], then one
    end.  base_score: add-one unigram log10 probability over the training tokens; score: log10 probability of the
    text under the interpolated bigram model.  Null texts count as empty (one token, the end).  Null ids and repeated
    rows are scored and counted like any others.  Without training rows every count is 0, base_score is 0 and only
    the uniform part of the model is left.  An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    named = F.coalesce(~F.coalesce(train, F.lit(False)) if held_out is None else held_out, F.lit(False)).alias("held_out")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    each = -(-max(partitions(spark), -(-size // GROUP_BYTES)) // FOLDS)
    groups = FOLDS * each
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), named)
    fold, nth = (F.pmod(F.xxhash64(F.lit(k), "id", "text"), F.lit(n)) for k, n in enumerate((FOLDS, each)))
    rows = rows.withColumn("grp", (fold + FOLDS * nth).cast("int"))
    asked = in_arrow(rows.drop("held_out").repartitionById(groups, F.col("grp")).sortWithinPartitions("grp"), _ask(groups), _ASKED)
    answers = in_arrow(asked.repartitionById(groups, F.col("part")).sortWithinPartitions("part", "grp"), _answer, _ANSWERED)
    answers = written(answers, "lm-counts")
    types, tokens, gone = (x or 0 for x in answers.where("grp = -1").agg(F.sum("types"), F.sum("tokens"), F.sum("deleted_tokens")).first())
    id_type = docs.schema[id_col].dataType.simpleString()

    def together(only: Column) -> DataFrame:
        a = answers.where("grp >= 0").where(only).select("grp", F.lit(False).alias("is_doc"), "part", "n", "counts", "deleted", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("train"), F.lit(False).alias("held_out"))
        d = rows.where(only).select("grp", F.lit(True).alias("is_doc"), F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("deleted"), "id", "text", "train", "held_out")
        return a.unionByName(d).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "is_doc", "part")

    main, p0 = tokens - gone, 1 / (types + 1)

    def held_out_bins(batches):
        for _, n, learned, word, context, pair in _joined(batches, True):
            use = np.repeat(learned, n)
            word, context, pair = word[use], context[use], pair[use]
            p2, p1 = pair / np.maximum(context, 1), word / max(main, 1)
            key = (_bucket(context) * 200 + _bin(p2)) * 200 + _bin(p1)
            names, at = np.unique(key, return_inverse=True)
            log = [np.bincount(at, np.log10(np.where(p > 0, p, 1)), len(names)) for p in (p2, p1)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, minlength=len(names)).astype(float)), *map(pa.array, log)], names=["k", "n", "s2", "s1"])

    bins = in_arrow(together(F.col("grp") % FOLDS == 0), held_out_bins, "k long, n double, s2 double, s1 double")
    # At most BUCKETS * (DECADES * BINS + 2) ** 2 rows, whatever the input.
    bins = bins.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "s2", "s1"))).orderBy("k").toPandas()
    k = bins["k"].to_numpy(np.int64)
    shares = learn(np.stack([k // 40000, bins["n"], bins["s2"], bins["s1"], k // 200 % 200, k % 200], axis=1), p0)

    def scores(batches):
        for grams, n, learned, word, context, pair in _joined(batches, False):
            share = shares[_bucket(context)]
            p = share[:, 0] * (pair / np.maximum(context, 1)) + share[:, 1] * (word / max(tokens, 1)) + share[:, 2] * p0
            base = np.log10((word + 1) / (tokens + types + 1))
            at = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([
                pa.chunked_array(grams.ids).combine_chunks(), pa.chunked_array(grams.held).combine_chunks(), pa.array(n), pa.array(np.add.reduceat((word > 0).astype(np.int64), at)),
                pa.array(np.full(len(n), tokens, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
            ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return in_arrow(together(F.lit(True)), scores, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
