import datetime
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.ontology import loaded, tables, validated
from graphloom.plans.jobs import Jobs, duration
from graphloom.sources import files
from graphloom.sources.ports import TextOnlyParser
from graphloom.streaming import incremental


def test_csv_to_nodes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,Ann,1.5\n2,,NaN\n")
    df = files.csv(spark, str(tmp_path / "a.csv"))
    nodes = files.nodes_from(df, "Person", "id").collect()
    assert {n.key: n.props for n in nodes} == {"1": {"id": "1", "name": "Ann", "x": "1.5"}, "2": {"id": "2"}}
    with pytest.raises(ValueError):
        files.csv(spark, "")


def test_pdfs(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"%PDF /Type /Page x /Type/Pages /Type /Page")
    (tmp_path / "a.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no")
    got = files.page_counts(files.pdfs(spark, str(tmp_path))).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.n_pages) for r in got) == [("a.pdf", 0), ("b.PDF", 2)]
    with pytest.raises(FileNotFoundError):
        files.pdfs(spark, str(tmp_path.joinpath("none").mkdir() or tmp_path / "none"))


def test_model_json_and_hierarchy(spark):
    text = '{"nodes": [{"label": "A", "key_property": {"name": "id", "type": "INTEGER"}, "properties": [{"name": "v", "type": "odd"}]}], "relationships": [{"type": "R", "start_node_label": "A", "end_node_label": "A", "properties": [{"name": "w", "type": "FLOAT"}]}]}'
    t = tables(spark, **files.model_tables(text, "m"))
    assert validated(t, "m").count() == 0
    schema = loaded(t, "m")
    assert schema.relationships == {"R": ("A", "A")} and [(f.name, f.type, f.is_key) for f in schema.nodes["A"]] == [("id", "INTEGER", True), ("v", "STRING", False)]
    df = spark.createDataFrame([('[{"id": "s1", "level": 2}]',)], "j string")
    assert [tuple(r) for r in files.hierarchy(df, "j").collect()] == [("s1", 2)]


def test_graph_round_trip(spark, tmp_path):
    g = Graph().with_nodes(page=spark.createDataFrame([("p", "d")], "id string, document_id string")).with_edges(NEXT=spark.createDataFrame([("a", "b")], "src string, dst string"))
    files.saved(g, str(tmp_path), "document_id")
    back = files.opened(spark, str(tmp_path), ["page"], ["NEXT"])
    assert back.nodes["page"].first().document_id == "d" and back.of_types("NEXT").first().type == "NEXT"
    assert [x[:2] for x in back.catalogue()] == [("node", "page"), ("edge", "NEXT")]
    files.reports(spark.createDataFrame([("d", "# T\n\nx")], "document_id string, text string"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "document_id=d").is_dir()


def test_text_parser(spark):
    got = TextOnlyParser().parse(spark.createDataFrame([("d", 0, "x"), ("d", 1, "")], "document_id string, page_number int, text string"))
    assert [r.id for r in got["element"].collect()] == ["d_elem_0"] and got["page"].count() == 2


def test_stream_extracts_each_chunk_once(spark, tmp_path):
    schema = "chunk_id string, ts timestamp, text string"
    at = datetime.datetime(2024, 1, 1)
    land, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([("a", at, "x"), ("b", at, "y")], [("a", at, "x"), ("c", at, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        query = incremental.run(incremental.landed(spark, land, schema, keys=["chunk_id"]), lambda d: d.withColumn("n", F.length("text")), out, check)
        query.awaitTermination(120)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_jobs(spark):
    jobs, undone = Jobs(spark), []
    job = jobs.create([lambda: spark.range(10).count(), lambda: 7], undo=lambda: undone.append(1))
    import time

    for _ in range(300):
        if jobs.check(job.id).state in ("complete", "failed"):
            break
        time.sleep(0.1)
    assert (job.state, job.result, job.done) == ("complete", 7, 2)
    bad = jobs.create([lambda: 1 / 0])
    for _ in range(100):
        if bad.state == "failed":
            break
        time.sleep(0.05)
    assert bad.state == "failed" and "division" in bad.error
    slow = jobs.create([lambda: time.sleep(3), lambda: 1], undo=lambda: undone.append(2))
    assert jobs.cancel(slow.id, clean=True).state == "cancelled" and undone == [2]
    jobs.forget(-1)
    assert not jobs.jobs and duration(3725) == "1h 2m"


def test_a_cancelled_job_shows_the_rows_done_and_is_undone(spark, tmp_path):
    jobs, path = Jobs(spark), str(tmp_path / "part")
    undone = []

    def store(job):
        job.watch(spark.range(500), "stored").write.parquet(path)

    def wait(job):
        slow = spark.range(0, 40, 1, 40).select(F.udf(lambda x: time.sleep(0.5) or x, "long")("id").alias("x"))
        job.watch(slow, "waited").write.format("noop").mode("overwrite").save()

    job = jobs.create([store, wait, store], undo=lambda: undone.append(True))
    until = time.time() + 60
    while time.time() < until and (jobs.check(job.id).done < 1 or jobs.check(job.id).tasks[1] < 40):
        time.sleep(0.1)
    seen = jobs.check(job.id)
    assert seen.rows == {"stored": 500} and seen.done == 1 and seen.tasks[0] < seen.tasks[1]
    jobs.cancel(job.id, clean=True)
    time.sleep(0.5)
    assert jobs.check(job.id).state == "cancelled" and undone == [True] and jobs.check(job.id).rows == {"stored": 500}
