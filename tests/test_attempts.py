"""Retries over a landing folder, with restarts, against the batch anti-join."""

import time

from pyspark.sql import functions as F

from graphloom.operators.extract import pending
from graphloom.streaming import attempts

SCHEMA = "id string, text string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_chunks_without_result_come_again_and_restarts_lose_nothing(spark, tmp_path):
    folder, out, place = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen = []

    def extract(chunks):
        rows = chunks.select("id", "text", "attempt")
        seen.append(sorted((r.id, r.attempt) for r in rows.collect()))
        # A text names the attempt at which it yields something.
        return rows.where(F.col("text").cast("int") <= F.col("attempt")).select(F.col("id").alias("chunk_id"), F.col("text").alias("value"))

    def run(until):
        """Starts the stream, waits until that has been tried, and stops it."""
        query = attempts.extracting(spark, folder, SCHEMA, extract, out, place, most=3, wait=0.5, every="200 milliseconds")
        end = time.time() + 90
        while query.isActive and time.time() < end and not until <= {x for batch in seen for x in batch}:
            time.sleep(0.2)
        time.sleep(4)  # time in which too many attempts would show
        query.stop()
        assert query.exception() is None
        return sorted({x for batch in seen for x in batch})  # a batch that was stopped runs again

    land(spark, folder, [("a", "1"), ("b", "2"), ("c", "9"), ("b", "2")])
    run({("c", 1)})
    land(spark, folder, [("d", "1"), ("a", "1")])
    tried = run({("c", 3), ("b", 2), ("d", 1)})  # goes on where it was stopped
    assert tried == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", 1)]
    every, found = spark.read.schema(SCHEMA).parquet(folder), attempts.results(spark, out)
    assert sorted(r.chunk_id for r in found.collect()) == ["a", "b", "d"]
    assert sorted({r.id for r in pending(every, found).collect()}) == ["c"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
