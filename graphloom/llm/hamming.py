"""Self-joins of binary codes through multi-index tables, without emitting the pairs of a group.

Every code puts one row (role 0) under each of its keys, and rows of role 1 under keys that differ from its own in one
bit that is 0 in it: two codes whose keys differ in at most one bit then meet exactly once, under the key with the bit
set.  Rows are dealt by key and sorted, and a task walks through runs of equal keys with numpy.  A run of over ``most``
rows is dealt as pairs of blocks, so that no key is one task's group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_arrow, partitions

#: Rows of one key in a block.
BLOCK = 4096
#: Pairs looked at in one numpy step.
STEP = 1 << 20
#: Heavy keys are looked for among the rows of one id in so many; they decide how work is dealt, not what is found.
SAMPLED = 16
#: A table of heavy keys up to this many rows is broadcast (16 bytes a row); beyond it, it is joined by a shuffle.
HEAVY_BROADCAST = 100_000


def keyed(segment: Column, salt: Column, bits: int, number: int) -> Column:
    """array<struct<segment, key, role>> of segment ``number``: its own key and the keys with one zero bit set."""

    def row(x: Column, role: int) -> Column:
        return F.struct(F.lit(number).cast("byte").alias("segment"), F.xxhash64(salt, x).alias("key"), F.lit(role).cast("byte").alias("role"))

    one = [F.lit(1 << k).cast("long") for k in range(bits)]
    others = [F.when(segment.bitwiseAND(x) == 0, row(segment.bitwiseOR(x), 1)) for x in one]
    return F.concat(F.array(row(segment, 0)), F.filter(F.array(*others), lambda x: x.isNotNull()))


def dealt(rows: DataFrame, most: int | None = None, some: DataFrame | None = None) -> DataFrame:
    """Rows with ``key`` and ``id`` -> the same with (own, lo, hi): the row's block and the pair of blocks it is copied to.

    Keys of at most about ``most`` rows have the one block pair (0, 0).  The row's block comes from ``id``.  Keys are
    counted over the rows of one id in SAMPLED, or over ``some`` that hold as large a part.
    """
    most = most or BLOCK
    if some is None:
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    many = F.col("count") * SAMPLED
    heavy = checkpoint(some.groupBy("key").count().where(many > most).select("key", F.ceil(many / most).cast("int").alias("blocks")))
    n = heavy.count()
    if n == 0:
        zero = F.lit(0).cast("int")
        return rows.withColumns({"own": zero, "lo": zero, "hi": zero})
    rows = rows.join(F.broadcast(heavy) if n <= HEAVY_BROADCAST else heavy, "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")


def by_run(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deals rows with (key, own, lo, hi) by key and block pair, and gives ``work`` tables of whole runs, with the
    first row of each run (and the number of rows)."""
    keys = ["key", "lo", "hi"]
    sorted_rows = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts = _firsts(batch)
            if held and _same(held[-1], batch) and len(firsts) == 1:
                held.append(batch)
                continue
            cut = firsts[0 if held and not _same(held[-1], batch) else min(1, len(firsts) - 1)] if held else 0
            last = int(firsts[-1])
            if held:
                held.append(batch.slice(0, cut))
                whole = pa.Table.from_batches(held)
                yield from work(whole, _bounds(whole))
            if last > cut:
                whole = pa.Table.from_batches([batch.slice(cut, last - cut)])
                yield from work(whole, _bounds(whole))
            held = [batch.slice(last)]
        if held:
            whole = pa.Table.from_batches(held)
            yield from work(whole, _bounds(whole))

    return in_arrow(sorted_rows, run, schema)


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "lo", "hi")]


def _firsts(batch) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for x in _columns(batch):
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _bounds(whole: pa.Table) -> np.ndarray:
    return np.append(_firsts(whole), whole.num_rows) if whole.num_rows else np.zeros(1, np.int64)


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(n)[-1].as_py() == b.column(n)[0].as_py() for n in ("key", "lo", "hi"))


def pairs(bounds: np.ndarray, role: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within each run: not both of role 1, and one of each block if lo < hi."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    i = np.arange(len(role))
    for d in range(1, int(np.diff(bounds).max(initial=1))):
        i = i[i + d < end[i]]
        for part in np.array_split(i, max(1, -(-len(i) // STEP))):
            j = part + d
            good = ((role[part] == 0) | (role[j] == 0)) & ((lo[part] == hi[part]) | (own[part] != own[j]))
            if good.any():
                yield part[good], j[good]


class Forest:
    """Labels of a few rows; ``link`` returns the links that joined two trees, which span all links given."""

    def __init__(self, labels: np.ndarray):
        self.names, self.at = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(self.names))

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        a, b = self.at[i], self.at[j]
        self.root = self.root[self.root]
        new, out = np.flatnonzero(self.root[a] != self.root[b]), []
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                out.append((int(self.names[x]), int(self.names[y])))
        return out
