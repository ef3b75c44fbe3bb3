"""Ranked lexical search of a set of items, by a join that thresholds seed.

Documents become rows of term numbers and frequencies (an index of the items' vocabulary).  For each term the K-th best
impact in the corpus is stored: an item's K-th best score is at least the largest of its terms' K-th impacts.  An item's
terms, in the order of their best impacts, are cut where what is left cannot reach that threshold together; only terms
before the cut bring documents into the join.  A document that they bring stays a candidate if its sum so far and all
that the other terms could add reach the threshold; candidates then get these terms' exact part.  All sums are integers.

The join runs in blocks of documents with the items' terms held by every task, so nothing is shuffled by term; a task
passes on K documents of an item at most.  Its own K-th scores raise the thresholds as it goes.
"""

from __future__ import annotations

import math
import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, in_arrow, written

K = 20
#: Terms of items that one pass holds, about; more items are dealt to several passes by a hash.
TERMS = 200_000
#: Cells (documents by items) and products in one numpy step; rows kept of a task before they are cut to K an item.
CELLS, PRODUCTS, HELD = 4_000_000, 4_000_000, 200_000
#: Bytes of a text to what a term's bytes are: all but terms' own characters become spaces, A-Z lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, in order."""
    return text.translate(_FOLD).split() if text else []


def asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item_id, term, often): the terms of each item, with a number for each row of items."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for q, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                own: dict[bytes, int] = {}
                for t in terms(text):
                    own[t] = own.get(t, 0) + 1
                for column, values in zip(out, ([q] * len(own), [i] * len(own), own, own.values())):
                    column.extend(values)
            kinds = pa.int64(), batch.schema.field(1).type, pa.binary(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["q", "item_id", "term", "often"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return checkpoint(in_arrow(rows, run, f"q long, item_id {kind}, term binary, often long"))


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, often) of every document with a term: its terms with repeats, and the numbers (places in
    ``vocabulary``) of those of the vocabulary with their frequencies.  A table in the shared folder."""
    data = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})
    size = len(vocabulary)

    def run(batches):
        number = data.value.get
        for batch in batches:
            found = [terms(x.as_py()) for x in batch.column(1)]
            n = np.array([len(ts) for ts in found], np.int64)
            every = np.fromiter((k for ts in found for k in map(number, ts, repeat(-1))), np.int64, n.sum())
            row = np.repeat(np.arange(len(n)), n)[every >= 0]
            key, often = np.unique(row * size + every[every >= 0], return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (key % max(size, 1), often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["id", "n", "terms", "often"]).filter(pa.array(n > 0))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return written(in_arrow(rows, run, f"id {kind}, n long, terms array<int>, often array<int>"), "lexical")


class Weights:
    """Impacts of terms in documents; integers throughout but for the logarithm."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and impact of each posting of a batch of the index."""
        n, lists = batch.column("n").to_numpy(), batch.column("terms")
        size = np.diff(lists.offsets.to_numpy())
        row, term = np.repeat(np.arange(len(n)), size), lists.flatten().to_numpy().astype(np.int64)
        often = batch.column("often").flatten().to_numpy().astype(np.int64)
        m = 75 + 25 * n * self.n_docs // self.n_terms
        return row, term, self.weight[term] * (1_000_000_000 * often // (1000 * often + 12 * m[row]))


def _cut(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each group."""
    order = np.lexsort((-value, group))
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[nth < k]


def impacts(postings: DataFrame, weights: Weights, k: int = K) -> DataFrame:
    """(term, best, kth): the greatest impact of each term, and its k-th (0 where fewer documents hold the term)."""
    data = postings.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def run(batches):
        weights = pickle.loads(data.value)
        term, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, t, v = weights.of(batch)
            term, value = np.concatenate([term, t]), np.concatenate([value, v])
            at = _cut(term, value, k)
            term, value = term[at], value[at]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(value)], names=["term", "value"])

    each = in_arrow(postings.select("n", "terms", "often"), run, "term long, value long")
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("value")))
    top = each.withColumn("_nth", nth).where(F.col("_nth") <= k)
    return top.groupBy("term").agg(F.max("value").alias("best"), F.coalesce(F.max(F.when(F.col("_nth") == k, F.col("value"))), F.lit(0)).alias("kth"))


def seeded(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(q, term, often, threshold, rest, leads) of each item's terms (term: numbers).

    threshold: what the item's K-th score is at least.  Terms are in descending order of the most they can add; those
    that together with all after them stay below the threshold do not lead, and ``rest`` is the most that they can add.
    """
    rows = asked.join(stored, "term")
    most = F.col("often") * F.col("best")
    own = Window.partitionBy("q")
    after = own.orderBy(F.desc("most"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"most": most, "threshold": F.max(F.col("often") * F.col("kth")).over(own)})
    rows = rows.withColumn("leads", F.sum("most").over(after) >= F.col("threshold"))
    rest = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("most"))).over(own), F.lit(0))
    return rows.select("q", "term", "often", "threshold", rest.alias("rest"), "leads")


class Asked:
    """Items by term: for each term number the items (0, 1, ...) that hold it and how often."""

    def __init__(self, term: np.ndarray, item: np.ndarray, often: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.item, self.often = item[order], often[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def products(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and part of the score of each posting and item that share a term."""
        n = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(row, n), self.item[at], np.repeat(impact, n) * self.often[at]

    def sizes(self, term: np.ndarray) -> np.ndarray:
        return self.start[term + 1] - self.start[term]


def _best(postings: DataFrame, weights: Weights, seeds: list, n_terms: int, k: int) -> DataFrame:
    """(q, id, score): at most k documents of each item from each task, the best of the corpus among them."""
    q, term, often, threshold, rest = (np.array([r[c] for r in seeds], np.int64) for c in ("q", "term", "often", "threshold", "rest"))
    leads = np.array([r.leads for r in seeds], bool)
    names, first, item = np.unique(q, return_index=True, return_inverse=True)
    lead, other = (Asked(term[s], item[s], often[s], n_terms) for s in (leads, ~leads))
    data = postings.sparkSession.sparkContext.broadcast(pickle.dumps((weights, names, lead, other, threshold[first], rest[first])))

    def run(batches):
        weights, names, lead, other, least, rest = pickle.loads(data.value)
        n_items, held = len(names), []

        def cut() -> None:
            whole = pa.concat_tables(held)
            order = pc.sort_indices(whole, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
            whole = whole.take(order)
            own = whole.column("q").to_numpy()
            new = np.r_[True, own[1:] != own[:-1]][: len(own)]
            nth = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            score = whole.column("score").to_numpy()
            least[own[nth == k - 1]] = np.maximum(least[own[nth == k - 1]], score[nth == k - 1])
            held[:] = [whole.filter(pa.array(nth < k)).combine_chunks()]

        for batch in batches:
            row, term, impact = weights.of(batch)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            work = np.r_[0, np.cumsum(lead.sizes(term) + other.sizes(term))][bounds]
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(work, work[a] + PRODUCTS, "right")) - 1
                b = min(max(b, a + 1), a + max(1, CELLS // n_items), batch.num_rows)
                own = slice(bounds[a], bounds[b])
                r, i, v = lead.products(row[own] - a, term[own], impact[own])
                score = np.zeros((b - a) * n_items, np.int64)
                np.add.at(score, r * n_items + i, v)
                cell = np.flatnonzero(score)
                cell = cell[score[cell] + rest[cell % n_items] >= least[cell % n_items]]
                if len(cell):
                    open_ = np.zeros(len(score), bool)
                    open_[cell] = True
                    has = np.zeros(b - a, bool)
                    has[cell // n_items] = True
                    mine = has[row[own] - a]
                    r, i, v = other.products(row[own][mine] - a, term[own][mine], impact[own][mine])
                    at = r * n_items + i
                    np.add.at(score, at[open_[at]], v[open_[at]])
                    cell = cell[score[cell] >= least[cell % n_items]]
                    held.append(pa.table({"q": pa.array(cell % n_items), "id": batch.column("id").take(pa.array(cell // n_items + a)), "score": pa.array(score[cell])}))
                    if sum(t.num_rows for t in held) > HELD or len(held) > 64:
                        cut()
                a = b
        if held:
            cut()
            out = held[0]
            out = out.set_column(0, "q", pa.array(names[out.column("q").to_numpy()]))
            yield from out.to_batches()

    kind = postings.schema["id"].dataType.simpleString()
    return in_arrow(postings, run, f"q long, id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest score above 0.

    Equal scores are ranked by ascending doc_id (null ids last).  A null text has no terms; documents without terms count
    for nothing.  Each row of ``docs`` is a document and each row of ``items`` an item, so repeated rows are ranked one
    after another (in any order) or answered each.  Null item ids are carried.  Empty tables give no rows; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    every = asked(items, item_col, item_text)
    passes = max(1, -(-every.count() // TERMS))
    found = None
    for p in range(passes):
        own = every.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)
        part = _search(docs, own, k, id_col, text_col)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((items, item_col), (docs, id_col))]
    if found is None:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    top = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return top.join(every.select("q", "item_id").distinct(), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _search(docs: DataFrame, own: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    vocabulary = sorted(r.term for r in own.select("term").distinct().collect())  # about TERMS at most
    if not vocabulary:
        return None
    postings = index(docs, [bytes(t) for t in vocabulary], id_col, text_col)
    total = postings.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = Weights(total.n, total.l, df)
    number = numbered(own, vocabulary)
    seeds = seeded(number, written(impacts(postings, weights, k), "impacts")).collect()  # a row for each of these terms
    return _best(postings, weights, seeds, len(vocabulary), k) if seeds else None


def numbered(own: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Items' terms with the terms' numbers in their place."""
    known = own.sparkSession.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.binary()), "number": pa.array(range(len(vocabulary)), pa.int64())}))
    return own.join(known, "term").select("q", F.col("number").alias("term"), "often")
