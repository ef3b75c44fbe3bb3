"""Near-duplicates by the Jaccard similarity of distinct word shingles; no pair at the threshold is lost.

Candidates are filters only, the sets of shingles decide.  Close copies come first, through operator 6's pigeonring
(64-bit SimHash of the distinct shingles, 3 bits) and shared least hashes; what they link need not meet again.  The rest is
a search that is whole by the pigeonhole principle: two sets with a similarity of p / q share one of their first
n - ceil(n * p / q) + 1 shingles in any common order (here: those common in a sample last).  Where they first meet, their
sizes, places and the Hamming distance of 128 parity bits prune.  Rows that this leaves a partner meet again with parity bits
as many as shingles, and only what these leave is a pair.  A bit is the parity of the shingles that fall to it, so two sets
differ in no more bits than shingles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import checkpoint, in_arrow, written
from .components import components
from .hamming import SAMPLED, by_run, dealt, pairs
from .simhash import links

#: Least similarity that links, as a fraction.
LEAST = (4, 5)
#: Least hashes of a set, words of its parity bits, and the bits within which operator 6 looks for close copies.
HASHES, PARITY, CLOSE_BITS = 4, 2, 3
#: The order of shingles comes from about so many sets and at most so many shingles; it never decides what is found.
SAMPLE, COMMON = 20_000, 50_000
#: Tables of up to so many rows are broadcast (16 to 24 bytes a row); larger ones are joined by a shuffle.
BROADCAST = 500_000
#: A pair that has met under one of the last so many keys of both is left out.
BEFORE = 4
#: Shingles, pairs, and words of bits in one numpy step.
STEP = 1 << 17


def _sets(column: pa.Array, shingle: int):
    """For each slice of texts: its rows, all distinct shingles' hashes, their row, how many each row has and where they
    begin, and the number that stands for each row's set."""
    buf, offsets = K.flat(column)
    for a, b in K.slices(offsets):
        part = K.LOWER[buf[offsets[a] : offsets[b]]]
        starts, ends, first = K.tokens(part, offsets[a : b + 1] - offsets[a])
        words, at, to = K.squeeze(part, starts, ends)
        many = np.diff(first)
        count = np.where(many >= shingle, many - shingle + 1, np.minimum(many, 1))
        row_at = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(b - a), count)
        begin = np.arange(row_at[-1]) - row_at[row] + first[row]
        last = np.minimum(begin + shingle, first[row + 1]) - 1
        h = K.xxh64(words, at[begin], to[last], 42)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        n = np.bincount(row, minlength=b - a)
        row_at = np.concatenate([[0], np.cumsum(n)])
        with np.errstate(over="ignore"):
            node = K.mix(_per_row(np.add, K.mix(h, 21), row_at) ^ K.mix(n.astype(np.uint64), 22))
        yield a, b, h, row, n, row_at, node


def _per_row(f: np.ufunc, x: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row_at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(row_at))
    if len(full):
        out[full] = f.reduceat(x, row_at[:-1][full])
    return out


def _first(node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows whose set is not empty and did not come before in the slice."""
    out = np.zeros(len(node), bool)
    out[np.unique(node, return_index=True)[1]] = True
    return out & (n > 0)


def _parity(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity bits of each row, in bytes from the lowest."""
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = at[row] + (K.mix(h, 24) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(raw)])


def _apart(x: bytes, y: bytes) -> int:
    """How many parity bits differ; more bits are folded to as many as the other has."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = 8 * len(x), 8 * len(y)
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & ((1 << m) - 1))
    return (a ^ b).bit_count()


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_hash, node, n, f0, m0.., parity) of every row: ``node`` stands for the set of its n shingles.

    Words and shingles are those of ``simhash.fingerprints``, each counted once.  f0: SimHash, m: least hashes, parity:
    the parity bits, a power of two and n at least.
    """
    longs = ["text_hash", "node", "n", "f0", *(f"m{k}" for k in range(HASHES))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in longs), T.StructField("parity", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for a, b, h, row, n, row_at, node in _sets(batch.column(2), shingle):
                cols = [node, n.astype(np.uint64), K.pack_bits(2 * K.bit_counts(h, row_at) > n[:, None])]
                cols += [_per_row(np.minimum, K.mix(h, 31 + k), row_at) for k in range(HASHES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x.view(np.int64)) for x in cols), _parity(h, row, n)], names=schema.names)

    return in_arrow(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col), run, schema)


def lists(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the sets that are not empty; a set may come more than once.  Worked out from the texts wherever
    it is needed: kept as a table, eight bytes a word would be twice the input."""

    def run(batches):
        for batch in batches:
            for _, _, h, row, n, _, node in _sets(batch.column(0), shingle):
                shown = _first(node, n)
                ends = np.concatenate([[0], np.cumsum(n[shown])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[shown].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[shown[row]].view(np.int64)))], names=["node", "shingles"])

    return in_arrow(docs.select(text_col), run, "node long, shingles array<bigint>")


def verified(found: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Those of the candidates (a, b), distinct nodes, whose sets are similar enough; few rows may be joined twice."""
    found = checkpoint(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    p, q = LEAST

    def prune(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in range(6))
            keep = [(i + j) - 2 * (-(-(i + j) * p // (p + q))) >= _apart(s, t) for i, j, s, t in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bits = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    for x in "ab":
        found = found.join(bits.select(*(F.col(c).alias(f"{c}_{x}") for c in bits.columns)), F.col(x) == F.col(f"node_{x}"))
    found = checkpoint(in_arrow(found.select("a", "b", "n_a", "n_b", "parity_a", "parity_b"), prune, "a long, b long"))
    few = 2 * found.count() <= BROADCAST
    nodes = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    one = rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("h"))
    ends = found.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    some = lists(texts.join(_small(checkpoint(one.select("h").distinct())), "h", "left_semi"), "text", shingle)
    both = some.join(F.broadcast(ends) if few else ends, "node").groupBy("a", "b").agg(*(F.max(F.when(F.col("node") == F.col(x), F.col("shingles"))).alias(f"set_{x}") for x in "ab"))
    return checkpoint(both.where((p + q) * F.size(F.array_intersect("set_a", "set_b")) >= p * (F.size("set_a") + F.size("set_b"))).select("a", "b"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def close(rows: DataFrame) -> DataFrame:
    """Candidates (a, b) among close copies: near SimHashes, equal ones, and equal least hashes, each with the first."""
    nodes = rows.where("n > 0")
    prints = nodes.groupBy("f0").agg(F.min("node").alias("id"))
    out = links(checkpoint(prints.select("id", "f0")), 1, CLOSE_BITS)
    keys = F.explode(F.array("f0", *(F.xxhash64(F.lit(k), f"m{k}") for k in range(HASHES)))).alias("key")
    keyed = nodes.select("node", keys)
    first = keyed.groupBy("key").agg(F.min("node").alias("b"))
    return out.unionByName(keyed.join(first, "key").select(F.col("node").alias("a"), "b"))


def common(docs: DataFrame, text_col: str, shingle: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than a few sets of a sample, sorted, and their counts."""
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(F.col(text_col).alias("text"))
    some = lists(some, "text", shingle).select(F.explode("shingles").alias("x"))
    some = some.groupBy("x").count().where("count > 3").orderBy(F.desc("count"), "x").limit(COMMON).orderBy("x").toArrow()
    return some["x"].to_numpy(), some["count"].to_numpy()


def prefixes(docs: DataFrame, text_col: str, shingle: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, place, id, n, s0..) of the first shingles of each set; ``id`` is the node."""
    names = [f"s{k}" for k in range(PARITY)]
    p, q = LEAST
    order = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        often, counts = order.value
        for batch in batches:
            for a, b, h, row, n, row_at, node in _sets(batch.column(0), shingle):
                rank = np.zeros(len(h), np.int64)
                if len(often):
                    k = np.minimum(np.searchsorted(often, x := h.view(np.int64)), len(often) - 1)
                    rank = np.where(often[k] == x, counts[k], 0)
                by = np.lexsort((h, rank, row))
                place = np.arange(len(h)) - np.repeat(row_at[:-1], n)
                keep = (place < (n - -(-n * p // q) + 1)[row]) & _first(node, n)[row]
                at = K.mix(h, 23)
                bit, word = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(6)) % np.uint64(PARITY)
                bits = [_per_row(np.bitwise_xor, np.where(word == np.uint64(k), bit, np.uint64(0)), row_at) for k in range(PARITY)]
                mine = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h[by][keep].view(np.int64)), pa.array(place[keep].astype(np.int32)), pa.array(node[mine].view(np.int64)), pa.array(n[mine].astype(np.int32)), *(pa.array(x[mine].view(np.int64)) for x in bits)], names=["key", "place", "id", "n", *names])

    return in_arrow(docs.select(text_col), run, "key long, place int, id long, n int, " + ", ".join(f"{x} long" for x in names))


#: Runs of a key over this many rows are looked at for a part that most of their rows share.
LONG_RUN = 64


def _pairs_of_parts(bounds: np.ndarray, part: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Row numbers (i, j) of each run's pairs, some of one part among them, but never all those of a part that holds over
    half of a long run: there only the other rows meet the run's rows."""
    size, role = np.diff(bounds), np.zeros(len(part), np.int8)
    usual = np.ones(len(part), bool)
    for k in np.flatnonzero(size > LONG_RUN):
        a, b = int(bounds[k]), int(bounds[k + 1])
        most = np.sort(part[a:b])[(b - a) // 2]  # a part of over half of the rows is the median
        other = np.flatnonzero(part[a:b] != most) + a
        if 2 * len(other) >= b - a:
            continue
        usual[a:b] = False
        every = np.arange(a, b)
        for i in other:  # two of the others meet once
            j = every[(part[a:b] == most) | (every > i)]
            j = j[(lo[i] == hi[i]) | (own[i] != own[j])]
            yield np.full(len(j), i), j
    left = np.flatnonzero(usual)
    kept = usual[bounds[:-1]]
    if len(left):
        ends = np.append(0, np.cumsum(size[kept]))
        for i, j in pairs(ends, role[left], own[left], lo[left], hi[left]):
            yield left[i], left[j]


class _Wide:
    """Parity bits of rows, each as many as its column holds, as 64-bit words; more bits are folded to as many as the other
    row of a pair has."""

    def __init__(self, column: pa.ChunkedArray):
        sizes = pc.binary_length(column).to_numpy()
        self.width = sizes // 8
        self.start = np.append(0, np.cumsum(self.width))
        self.words = np.frombuffer(b"".join(column.to_pylist()), np.uint64)

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        at = self.start[rows][:, None] + np.arange(width)
        out = self.words[at]
        for k in range(1, int(self.width[rows].max()) // width):
            more = np.flatnonzero(self.width[rows] > k * width)
            out[more] ^= self.words[at[more] + k * width]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bits differ between the rows of each pair."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(least).tolist():
            at = np.flatnonzero(least == width)
            for some in np.array_split(at, -(-len(at) * width // STEP)):
                x = self._folded(i[some], width) ^ self._folded(j[some], width)
                out[some] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return out


def _mixed(whole: pa.Table, bounds: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The runs of more than one part: a key of one part, such as that of a large group of close copies, has nothing to find."""
    part = whole.column("part").to_numpy()
    mixed = np.minimum.reduceat(part, bounds[:-1]) != np.maximum.reduceat(part, bounds[:-1])
    size = np.diff(bounds)
    return whole.filter(pa.array(np.repeat(mixed, size))), np.append(0, np.cumsum(size[mixed]))


def _likely(col: dict[str, np.ndarray], bounds: np.ndarray, differ: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Row numbers (i, j) of the runs' pairs, of two parts each, that sizes, places and differing bits leave."""
    p, q = LEAST
    n, place, part = col["n"].astype(np.int64), col["place"].astype(np.int64), col["part"]
    for whole_i, whole_j in _pairs_of_parts(bounds, part, col["own"], col["lo"], col["hi"]):
        for at in range(0, len(whole_i), STEP):
            i, j = whole_i[at : at + STEP], whole_j[at : at + STEP]
            ok = part[i] != part[j]
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            need = -(-both * p // (p + q))
            apart = both - 2 * need
            ok = (np.minimum(n[i] - place[i], n[j] - place[j]) >= need) & (place[i] + place[j] <= apart)
            i, j, apart = i[ok], j[ok], apart[ok]
            ok = differ(i, j) <= apart
            yield i[ok], j[ok]


def met(first: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` with parts that are likely to have a partner under their key, by 64 * PARITY bits: one row at
    most for each that comes in, with the block pair where it meets.  ``some``: see ``hamming.dealt``."""
    names = ["key", "place", "id", "n", "part", "own", "lo", "hi"]

    def work(whole: pa.Table, bounds: np.ndarray):
        whole, bounds = _mixed(whole, bounds)
        if not whole.num_rows:
            return
        col = {x: whole.column(x).to_numpy() for x in whole.column_names}
        bits, seen = np.stack([col[f"s{k}"].view(np.uint64) for k in range(PARITY)]), np.zeros(whole.num_rows, bool)
        for i, j in _likely(col, bounds, lambda i, j: np.bitwise_count(bits[:, i] ^ bits[:, j]).sum(axis=0, dtype=np.int64)):
            seen[i] = seen[j] = True
        yield from whole.select(names).filter(pa.array(seen)).to_batches()

    return by_run(dealt(first, some=some), work, "key long, place int, id long, n int, part long, own int, lo int, hi int")


def partners(rows: DataFrame, parity: DataFrame) -> DataFrame:
    """Candidates (a, b) among the rows of ``met``, by all their parity bits (node, parity).

    Two sets that share many shingles meet under each of them.  Who passes under one has passed under all that come before
    in the common order, as sizes and bits are the same and places less; so a pair is left out where one of the last BEFORE keys
    of both is the same.
    """
    rows = rows.repartition("id").groupBy("id", "place", "key", "n", "part", "own").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    along = Window.partitionBy("id").orderBy("place")
    last = [f"b{k}" for k in range(BEFORE)]
    rows = rows.withColumns({x: F.coalesce(F.lag("key", k + 1).over(along), F.lit(0)) for k, x in enumerate(last)})
    rows = rows.join(parity.withColumnRenamed("node", "id"), "id").withColumn("at", F.explode("at"))

    def work(whole: pa.Table, bounds: np.ndarray):
        whole, bounds = _mixed(whole, bounds)
        if not whole.num_rows:
            return
        col = {x: whole.column(x).to_numpy() for x in whole.column_names if x != "parity"}
        before, out = np.stack([col[x] for x in last]), []
        for i, j in _likely(col, bounds, _Wide(whole.column("parity")).apart):
            known = ((before[:, None, i] == before[None, :, j]) & (before[:, None, i] != 0)).any(axis=(0, 1))
            x, y = col["id"][i[~known]], col["id"][j[~known]]
            out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
        if out:
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_run(rows.select("key", "place", "id", "n", "part", "own", "at.lo", "at.hi", *last, "parity"), work, "a long, b long")


def rest(rows: DataFrame, known: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Candidates (a, b) of all that may be similar enough, but for those already in one of the groups ``known`` (id, part)."""
    order = common(docs, text_col, shingle, max(1, rows.where("n > 0").count() // SAMPLE))
    first = prefixes(docs, text_col, shingle, order).join(known, "id", "left").withColumn("part", F.coalesce("part", "id"))
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLED)) == 0)
    some = prefixes(some, text_col, shingle, order)
    parity = rows.where("n > 0").groupBy("node").agg(F.first("parity").alias("parity"))
    return partners(met(first, some), parity)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per document: (id, text_hash, keep_id, keep_hash): the smallest (id, text hash) reachable through texts
    whose distinct shingles have a similarity of ``LEAST`` or more.

    Texts without words, null ones too, are equal to each other only.  Null ids are never kept in place of others; a group
    of null ids only has a null keep_id.  Repeated rows stay repeated.  An empty table gives no rows.
    """
    rows = written(sets(docs, id_col, text_col, shingle), "shingles")
    first = verified(close(rows), rows, docs, text_col, shingle)
    known = _small(checkpoint(components(first).select(F.col("node").alias("id"), F.col("component").alias("part"))))
    second = verified(rest(rows, known, docs, text_col, shingle), rows, docs, text_col, shingle)
    groups = components(known.select(F.col("id").alias("a"), F.col("part").alias("b")).unionByName(second))
    named = rows.select("id", "text_hash", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))).alias("best")
    named = named.join(named.groupBy("component").agg(best), "component")
    return named.select("id", "text_hash", F.col("best.id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"))
