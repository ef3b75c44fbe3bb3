"""Running through ordered groups with a small state, where rows depend on all before them.

Groups are hashed to partitions and sorted there, so a partition begins and ends at the border of a group, and rows come
to Python as a stream of Arrow batches.  What is held is the state of one group and one batch, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an outgoing batch.
BATCH = 4096


class Automaton(Protocol):
    """The state of one group."""

    def row(self, *values: object) -> Iterable[tuple]:
        """Takes the next row; gives rows of the result."""

    def end(self) -> Iterable[tuple]:
        """Gives what is left when the group ends."""


def streamed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Automaton], schema: str, tasks: int | None = None) -> DataFrame:
    """(*keys, *schema): the rows that each group's automaton gives, fed with ``columns`` in the order of ``order``; groups are
    dealt to ``tasks``, if given."""
    data = rows.select(*keys, *order, *(c for c in columns if c not in keys + order))
    at = [data.columns.index(c) for c in columns]
    n, kinds = len(keys), ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys)
    whole = f"{kinds}, {schema}"
    arrow = to_arrow_schema(data.sparkSession.createDataFrame([], whole).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[tuple] = []
        key = state = None

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held.clear()
            return out

        for rows in batches:
            for values in zip(*(c.to_pylist() for c in rows.columns)):
                if state is None or values[:n] != key:
                    if state is not None:
                        held += [(*key, *x) for x in state.end()]
                    key, state = values[:n], start()
                held += [(*key, *x) for x in state.row(*(values[i] for i in at))]
                if len(held) >= BATCH:
                    yield batch()
        if state is not None:
            held += [(*key, *x) for x in state.end()]
        if held:
            yield batch()

    return data.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)
