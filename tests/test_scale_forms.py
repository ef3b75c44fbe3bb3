"""Operators whose plan must hold for one very large group: equal to the plain definition, and spread over tasks."""

import os
import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import analytics, chunk, graph, layout, store, upsert
from graphloom.operators.scan import scanned


def test_scan_equals_windows(spark):
    r = random.Random(4)
    keys = ["hot"] * 3000 + [None] * 500 + [f"k{r.randrange(900)}" for _ in range(4000)] + ["z"]
    rows = [(k, n % 3 if k == "k1" else None, n) for n, k in enumerate(keys)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, other int, n int").repartition(5)
    w = Window.partitionBy("key", "other").orderBy("n")
    want = df.withColumns({"number": F.row_number().over(w), "next": F.lead("n").over(w)}).withColumn("last", F.col("next").isNull())
    for parts in (1, 7, 60):
        got = scanned(df, ["key", "other"], ["n"], follower="n", partitions=parts)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert scanned(df.limit(0), ["key"], ["n"]).count() == 0
    ties = scanned(df.withColumn("n", F.lit(1)), ["key"], ["n"], partitions=9)
    assert ties.where("key = 'hot'").agg(F.countDistinct("number"), F.max("number"), F.count_if("last")).first()[:] == (3000, 3000, 1)


def test_no_task_holds_a_hot_group(spark):
    """What is sorted in one task is a range of rows, not a group."""
    df = spark.range(20_000).select(F.lit("one").alias("key"), F.col("id").alias("n"))
    got = scanned(df, ["key"], ["n"], follower="n", partitions=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # On the side of the rows, every window is of a range's part.
    assert "windowspecdefinition(_part" in plan
    spread = df.repartitionByRange(16, "key", "n").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread < 20_000 / 4 and got.agg(F.max("number"), F.count_if("last")).first()[:] == (20_000, 1)
    assert graph.long_chain(df, ["key"], ["n"], "n").where("dst = src + 1 AND number = src + 1").count() == 19_999


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_the_buckets_it_hits(spark, tmp_path):
    path = str(tmp_path / "entities")
    kept = store.Store(spark, path, buckets=16)
    assert kept.rows().count() == 0
    row = "label string, key string, props map<string, string>, seq long"
    first = spark.createDataFrame([("A", f"k{n}", {"x": str(n), "y": None}, n) for n in range(200)] + [("A", "k3", {"x": "later"}, 900)], row)
    done = kept.merged(first)
    assert (done.rows, done.entities, len(done.buckets)) == (201, 200, 16)
    before = files(path)
    second = spark.createDataFrame([("A", "k5", {"y": "new", "x": None}, 1), ("B", "k5", {}, 2)], row)
    done = kept.merged(second)
    after = files(path)
    hit = {f"bucket={b}" for b in done.buckets}
    same = {f for f in before if os.path.basename(os.path.dirname(f)) not in hit}
    assert len(hit) <= 2 and same and all(after[f] == before[f] for f in same) and set(after) != set(before)
    one = upsert.upserted(first.limit(0), first.withColumn("seq", F.col("seq")).unionByName(second.withColumn("seq", F.col("seq") + 10_000)))
    tidy = lambda df: sorted((r.label, r.key, sorted(r.props.items())) for r in df.collect())
    assert tidy(kept.rows()) == tidy(one)
    kept.merged(second)  # again
    assert tidy(kept.rows()) == tidy(one)
    kept.merged(first.limit(0))
    assert tidy(store.Store(spark, path, buckets=16).rows()) == tidy(one)


def test_a_batch_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch):
    kept = store.Store(spark, str(tmp_path / "entities"), buckets=4)
    row = "label string, key string, props map<string, string>, seq long"
    kept.merged(spark.createDataFrame([("A", "a", {"x": "1"}, 1)], row))
    batch = spark.createDataFrame([("A", "a", {"x": "2"}, 1), ("A", "b", {}, 2)], row)
    with monkeypatch.context() as m:
        m.setattr(store, "upserted", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.merged(batch)
    assert [r.props for r in kept.rows().collect()] == [{"x": "1"}]
    kept.merged(batch)
    assert {r.key: r.props for r in kept.rows().collect()} == {"a": {"x": "2"}, "b": {}}


def test_deep_levels_equal_nearest_smaller_values(spark):
    r = random.Random(9)
    rows = [(d, n, r.choice([None, *range(-3, 40)]), r.choice(["t", "", None, "u"])) for d in (1, 2, None) for n in range(150)]
    df = spark.createDataFrame(rows, "document_id int, ordinal int, level int, title string").repartition(4)
    got = {(x.document_id, x.ordinal): (x.parent_ordinal, x.path) for x in layout.heading_paths(df).collect()}
    for d in (1, 2, None):
        own, path = [x[1:] for x in rows if x[0] == d], {}
        for n, level, title in own:
            up = max((m for m, other, _ in own if m < n and other is not None and level is not None and other < level), default=None)
            path[n] = (path[up] + " > " if up is not None else "") + (title or "(untitled)")
            assert got[d, n] == (up, path[n])


def test_boxes_equal_all_pairs(spark):
    r = random.Random(3)
    box = lambda m: (lambda x, y, w, h: (x, y, x + w, y + h))(r.randint(0, m), r.randint(0, m), r.choice([0, 1, 5, 30, 200]), r.choice([0, 2, 5, 90]))
    blocks = [(p, n, tuple(map(float, box(120)))) for p in range(3) for n in range(120)] + [(0, 900, (1.0, 2.0, None, 3.0))]
    tables = [(p, n, tuple(map(float, box(120)))) for p in range(2) for n in range(60)] + [(0, 60, (-50.0, -50.0, 400.0, 400.0))]
    shape = "struct<x0: double, y0: double, x1: double, y1: double>"
    b = spark.createDataFrame(blocks, f"page int, block_id int, box {shape}")
    t = spark.createDataFrame(tables, f"page int, table_idx int, table_box {shape}")
    pairs = [(x, y) for x in blocks for y in tables if x[0] == y[0] and None not in x[2]]
    for least in (0.5, 0.3, 0.8):
        best = {}
        for (p, n, (a0, b0, a1, b1)), (_, k, (c0, d0, c1, d1)) in pairs:
            if size := (a1 - a0) * (b1 - b0):
                part = max(0, min(a1, c1) - max(a0, c0)) * max(0, min(b1, d1) - max(b0, d0)) / size
                if part > least:
                    best[p, n] = max(best.get((p, n), (0, 0)), (part, -k))
        got = {(x.page, x.block_id): (x.overlap, -x.table_idx) for x in layout.best_overlap(b, t, ["page"], least).collect()}
        assert got == best and best
    within = {(p, n) for (p, n, (a0, b0, a1, b1)), (_, _, (c0, d0, c1, d1)) in pairs if c0 <= (a0 + a1) / 2 <= c1 and d0 <= (b0 + b1) / 2 <= d1}
    out = {(x.page, x.block_id) for x in layout.outside_tables(b, t, ["page"]).collect()}
    assert out == {(p, n) for p, n, _ in blocks} - within
    with pytest.raises(ValueError):
        layout.best_overlap(b, t, ["page"], 0.01)


def test_a_page_of_100_000_boxes_ends(spark):
    at = lambda c, w, h: F.struct((F.col("id") % 300 * 10).cast("double").alias("x0"), (F.floor(F.col("id") / 300) * 10).cast("double").alias("y0"), (F.col("id") % 300 * 10 + w).cast("double").alias("x1"), (F.floor(F.col("id") / 300) * 10 + h).cast("double").alias("y1")).alias(c)
    began = time.time()
    blocks = spark.range(100_000).select(F.lit(1).alias("page"), F.col("id").alias("block_id"), at("box", 4, 4))
    tables = spark.range(100_000).where("id % 3 = 0").select(F.lit(1).alias("page"), F.col("id").alias("table_idx"), at("table_box", 8, 8))
    assert layout.best_overlap(blocks, tables, ["page"]).count() == 33_334
    assert layout.outside_tables(blocks, tables, ["page"]).count() == 66_666
    assert time.time() - began < 120


def test_images_in_a_long_chain(spark):
    """Each image is near the next one only: every other one stays, in one pass."""
    box = lambda k: (3.0 * k, 3.0 * k, 0.0, 0.0)
    rows = [(p, k, box(k)) for p in (1, 2) for k in range(400)] + [(1, 999, (None, None, None, None))]
    df = spark.createDataFrame(rows, "page int, image_idx int, box struct<x0: double, y0: double, x1: double, y1: double>")
    got = sorted((x.page, x.image_idx) for x in layout.distinct_boxes(df, ["page"]).collect())
    assert got == sorted([(p, k) for p in (1, 2) for k in range(0, 400, 2)] + [(1, 999)])


def test_a_document_of_very_many_elements_is_chunked_as_a_stream(spark):
    kind = F.when(F.col("id") % 50 == 0, "heading").otherwise("paragraph")
    rows = spark.range(300_000).select(F.lit(1).alias("document_id"), F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), kind.alias("type"), F.lit("one two three four").alias("text"))
    found = chunk.structured(rows, size=100)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    total = found.agg(F.sum("token_count"), F.max("token_count"), F.sum(F.size("element_ids"))).first()
    assert total[0] == 1_200_000 and total[1] <= 100 and total[2] == 300_000


def test_median_of_counted_values(spark):
    r = random.Random(1)
    rows = [(d, float(r.choice([0, 8, 8, 10, 12, 30]))) for d in range(20) for _ in range(r.randint(1, 9))] + [(99, None), (None, 5.0)]
    df = spark.createDataFrame(rows, "document_id int, font_size_max double")
    found = layout.headings_by_font(df)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    for x in found.collect():
        own = sorted(s for d, s in rows if d == x.document_id and s and s > 0)
        if x.document_id is not None:
            assert x.median_font == (own[len(own) // 2] if own else None)
            assert x.is_heading == bool(own and x.font_size_max is not None and x.font_size_max > 1.2 * own[len(own) // 2])
    assert found.count() == len(rows)


def test_shared_pairs_are_dealt_by_their_number(spark, monkeypatch):
    r = random.Random(5)
    edges = [(r.randrange(30), r.randrange(12)) for _ in range(400)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(edges, "src int, dst int")
    to = {s: {d for x, d in edges if x == s and d is not None} for s in range(30)}
    want = sorted(((a, b, len(to[a] & to[b])) for a in to for b in to if a < b), key=lambda x: (-x[2], x[:2]))[:25]
    assert [tuple(x) for x in analytics.shared_pairs(df, 25).collect()] == want
    monkeypatch.setattr(analytics, "PAIRS", 100)
    monkeypatch.setattr(analytics, "ROWS", 50)
    found = analytics.shared_pairs(df, 25)
    assert [tuple(x) for x in found.collect()] == want
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(a#\d+, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
    assert tasks and min(tasks) >= 20


def test_upserts_are_dealt_once_by_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "ROWS", 40)
    monkeypatch.setattr(store, "ROWS", 5)
    kinds = "type string, src_label string, src string, dst_label string, dst string, props map<string, string>, seq long"
    rows = [("T", "A", f"a{n % 7}", "B", f'b"{n % 11}', {"x": str(n), "y": None if n % 2 else "even"}, n) for n in range(300)]
    ends = spark.createDataFrame([("A", f"a{n}") for n in range(5)] + [("B", f'b"{n}') for n in range(9)], "label string, key string")
    df = spark.createDataFrame(rows, kinds)
    want = {}
    for _, _, a, _, b, props, _ in rows:
        if int(a[1:]) < 5 and int(b[2:]) < 9:
            want.setdefault((a, b), {}).update({k: v for k, v in props.items() if v is not None})
    found = upsert.upserted_edges(df.limit(0), df, ends, 300)
    assert {(x.src, x.dst): x.props for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 8" in plan
    kept = store.Store(spark, str(tmp_path / "edges"), buckets=3)
    for _ in range(2):
        kept.merged_edges(df, ends)
    assert {(x.src, x.dst): x.props for x in kept.edges().collect()} == want
    assert len(files(kept.path)) > 3  # a bucket of many rows is several tasks' work
