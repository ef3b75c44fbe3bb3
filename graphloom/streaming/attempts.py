"""Extraction over a landing folder that comes back to chunks which yielded nothing.

Two streams meet by chunk: what has landed and what has been extracted.  A chunk's state is how often it was tried; a
timer brings it back after a while, until something was extracted from it or it was tried often enough.  The state is a
number, not a text; texts are read from the folder when a chunk's turn comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: The stores of state that timers and expiry need.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: In the place of a number of attempts: something was extracted.
DONE = -1


class _Attempts(StatefulProcessor):
    def __init__(self, most: int, wait: int, forget: int | None):
        self.most, self.wait, self.forget = most, wait, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "tried int", self.forget)

    def _try(self, key, number: int, now: int) -> Iterator[pd.DataFrame]:
        self.tried.update((number,))
        self.handle.registerTimer(now + self.wait)
        yield pd.DataFrame({"id": [key[0]], "attempt": pd.Series([number], dtype="int32")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds = {k for frame in rows for k in frame["kind"]}
        if "done" in kinds:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.tried.update((DONE,))
        elif not self.tried.exists():
            yield from self._try(key, 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = self.tried.get()[0] if self.tried.exists() else DONE
        if DONE < number < self.most:
            yield from self._try(key, number + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def attempts(landed: DataFrame, done: DataFrame, most: int = 3, wait: float = 60.0, forget: float | None = None) -> DataFrame:
    """(id, attempt): the chunks to try now, from two streams with id.

    A chunk comes when it lands and again every ``wait`` seconds until its id is in ``done`` or it came ``most`` times.  Of
    a chunk that lands twice only the first landing counts, and one that is done before it lands does not come.  The state
    of a chunk that nothing happens to for ``forget`` seconds expires; without it, state stays.  Sets the session's store of
    state to RocksDB, which timers need.
    """
    both = landed.select("id", F.lit("landed").alias("kind")).unionByName(done.select("id", F.lit("done").alias("kind")))
    landed.sparkSession.conf.set(*_PROVIDER)
    kind = landed.schema["id"].dataType.simpleString()
    how = _Attempts(most, int(wait * 1000), None if forget is None else int(forget * 1000))
    return both.groupBy("id").transformWithStateInPandas(how, f"id {kind}, attempt int", "Append", "ProcessingTime")


def extracting(spark: SparkSession, folder: str, schema: str, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most: int = 3, wait: float = 60.0, forget: float | None = None, every: str = "10 seconds") -> StreamingQuery:
    """Runs ``extract`` (chunks with id to rows with chunk_id) over what has landed in ``folder`` and is due, until stopped.

    What is due is written before it is worked on, and results are Parquet under ``out``/results/batch=N, so a batch that
    is run again after a failure replaces its own results.  Started again with the same checkpoint, it goes on.
    """
    landed = spark.readStream.schema(schema).parquet(folder)
    spark.createDataFrame([], "chunk_id string, batch long").write.mode("ignore").parquet(f"{out}/done")
    done = spark.readStream.schema("chunk_id string, batch long").parquet(f"{out}/done").select(F.col("chunk_id").alias("id"))
    turns = attempts(landed.select(F.col("id").cast("string").alias("id")), done, most, wait, forget)

    def batch(rows: DataFrame, number: int) -> None:
        due, path = f"{out}/due/batch={number}", f"{out}/results/batch={number}"
        rows.write.mode("overwrite").parquet(due)  # the one action on the stream: it moves the state
        rows = spark.read.schema("id string, attempt int").parquet(due)
        if rows.isEmpty():
            return
        chunks = spark.read.schema(schema).parquet(folder).withColumn("id", F.col("id").cast("string"))
        extract(chunks.join(rows, "id").dropDuplicates(["id"])).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path).select(F.col("chunk_id").cast("string").alias("chunk_id")).distinct()
        found.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{out}/done")

    return turns.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/results").drop("batch")
