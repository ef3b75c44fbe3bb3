"""Property graphs as DataFrames: one per node label, one per relationship type (src, dst, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from .scan import scanned


@dataclass(frozen=True)
class Graph:
    """Named tables; every change gives a new graph."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def with_nodes(self, **tables: DataFrame) -> Graph:
        return replace(self, nodes=self.nodes | tables)

    def with_edges(self, **tables: DataFrame) -> Graph:
        return replace(self, edges=self.edges | tables)

    def of_types(self, *types: str) -> DataFrame:
        """Edges of any of the types, with their type."""
        parts = [self.edges[t].select("src", "dst").withColumn("type", F.lit(t)) for t in types]
        return reduce(DataFrame.unionByName, parts)

    def catalogue(self) -> list[tuple[str, str, str]]:
        """(kind, name, schema) of every table."""
        kinds = (("node", self.nodes), ("edge", self.edges))
        return [(k, n, t.schema.simpleString()) for k, tables in kinds for n, t in sorted(tables.items())]


def expand(left: DataFrame, edges: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """One hop: left -[edges]-> right.  ``how='left'`` keeps left rows without a partner."""
    hop = edges.select(F.col("src").alias(left_key), F.col("dst").alias(right_key)).join(right, right_key)
    return left.join(hop, left_key, how)


def linked(nodes: DataFrame, edges: DataFrame, key: str, end: str = "src", negate: bool = False) -> DataFrame:
    """Nodes that are (or, negated, are not) at an end of some edge."""
    return nodes.join(edges.select(F.col(end).alias(key)), key, "left_anti" if negate else "left_semi")


def unlinked_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) rows that no edge joins: both ends are given."""
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select(key)
    return edges.join(ids.withColumnRenamed(key, "src"), "src", "left_semi").join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi")


def lookup(ids: DataFrame, *tables: DataFrame, key: str = "id") -> DataFrame:
    """Ids found in any of the tables; ids in none vanish."""
    return ids.join(reduce(DataFrame.unionByName, [t.select(key) for t in tables]).distinct(), key)


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth): what is reached in one hop or more (``depth`` at most, if given), at its least depth.

    Each round follows the edges from what the round before has reached first, so cycles end it.
    """
    hop = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()
    step = roots.select(F.col("id").alias("root"), "id").distinct()
    found, k = None, 0
    while depth is None or k < depth:
        k += 1
        step = step.join(hop, "id").select("root", F.col("to").alias("id")).distinct()
        step = checkpoint(step if found is None else step.join(found.select("root", "id"), ["root", "id"], "left_anti"))
        if step.isEmpty() and found is not None:
            break
        level = step.withColumn("depth", F.lit(k))
        found = level if found is None else found.unionByName(level)
    return found if found is not None else step.withColumn("depth", F.lit(0)).limit(0)


def chain(nodes: DataFrame, parent: list[str], order: list[str], key: str = "id") -> DataFrame:
    """(src, dst) of neighbours within each parent."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return nodes.select(*parent, F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst is not null")


def long_chain(nodes: DataFrame, parent: list[str], order: list[str], key: str = "id") -> DataFrame:
    """As ``chain``, for parents with so many nodes that no task should hold one; (*parent, src, number, dst)."""
    rows = nodes.select(*dict.fromkeys([*parent, *order, key]))
    found = scanned(rows, parent, order, follower=key).where("next is not null")
    return found.select(*parent, F.col(key).alias("src"), "number", F.col("next").alias("dst"))


def walk(nodes: DataFrame, edges: DataFrame, depth: int | None = None, key: str = "id") -> DataFrame:
    """(id, head, position) along NEXT edges from each node without an inbound one; ids in cycles are orphans at -1.

    Chains of any length: each round doubles the hops that a node looks back, so rounds grow with the logarithm of the
    longest chain.  A node is settled when it sees a head; the walk ends when a round settles no more.  A node that is
    reached in several ways has a row for each head, with the least position.  Nodes beyond ``depth``, if given, are orphans.
    """
    ids = nodes.select(F.col(key).alias("id")).distinct()
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("up"))
    heads = ids.join(back.select("id"), "id", "left_anti")
    found = checkpoint(heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("position")))
    jumps = checkpoint(back.distinct().withColumn("hops", F.lit(1).cast("long")))
    settled = found.count()
    while True:
        # whoever jumps to a settled node is settled; jumps then double
        ahead = jumps.join(found.withColumnRenamed("id", "up"), "up").select("id", "head", (F.col("hops") + F.col("position")).alias("position"))
        found = checkpoint(found.unionByName(ahead).groupBy("id", "head").agg(F.min("position").alias("position")))
        count = found.count()
        if count == settled:
            break
        settled = count
        then = jumps.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("hops").alias("more"))
        jumps = checkpoint(jumps.join(then, "up").groupBy("id", F.col("top").alias("up")).agg(F.min(F.col("hops") + F.col("more")).alias("hops")))
    if depth is not None:
        found = found.where(F.col("position") <= depth)
    out = nodes.select(F.col(key).alias("id")).join(found, "id", "left")
    return out.select("id", F.coalesce("head", "id").alias("head"), F.coalesce(F.col("position").cast("int"), F.lit(-1)).alias("position"))


def numbered(rows: DataFrame, parent: list[str], order: list[str], prefix: Column, infix: str, width: int = 4) -> DataFrame:
    """Adds idx from 0 within each parent and id: prefix, infix and the padded number (longer numbers stay whole)."""
    idx = F.row_number().over(Window.partitionBy(*parent).orderBy(*order)) - 1
    return rows.withColumn("idx", idx).withColumn("id", F.concat(prefix, F.lit(infix), F.format_string(f"%0{width}d", "idx")))


def broken(nodes: DataFrame, edges: DataFrame, parent: str, number: str, key: str = "id") -> DataFrame:
    """Nodes without a NEXT edge that are not the last of their parent."""
    last = F.max(number).over(Window.partitionBy(parent))
    return linked(nodes.withColumn("_last", last), edges, key, negate=True).where(F.col(number) < F.col("_last")).drop("_last")


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def counted(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows of each child table, each aggregated before the join: no fan-out."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.na.fill(0, list(children))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Violations of a uniqueness constraint: keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def has_label(label: str, column: str = "labels") -> Column:
    return F.array_contains(column, label)
