import pytest
from pyspark.sql import functions as F

from graphloom.functions import naming
from graphloom.operators import document_graph as D
from graphloom.operators import ontology
from graphloom.plans.documents import elements


@pytest.fixture(scope="module")
def parsed(spark, sf):
    e = elements(spark, sf).where("document_id < 12").withColumn("document_id", F.concat(F.lit("d"), F.col("document_id").cast("string"))).cache()
    page = e.select("document_id", "page_number").distinct().withColumn("id", F.concat_ws("_page_", "document_id", "page_number"))
    doc = e.select(F.col("document_id").alias("id")).distinct().withColumn("name", F.upper("id"))
    return D.built(doc, page, e)


def test_every_edge_joins_nodes_that_exist(parsed):
    ids = {n: {r.id for r in t.select("id").collect()} for n, t in parsed.nodes.items()}
    ends = {"HAS_PAGE": ("document", "page"), "NEXT_PAGE": ("page", "page"), "NEXT_ELEMENT": ("element", "element"), "CAPTION_OF": ("element", "element"), "HAS_SECTION": ("document", "section"), "HAS_SUBSECTION": ("section", "section"), "NEXT_SECTION": ("section", "section")}
    for name, (a, b) in ends.items():
        assert all(r.src in ids[a] and r.dst in ids[b] for r in parsed.edges[name].collect()), name
    assert all(r.src in ids["page"] | ids["section"] and r.dst in ids["element"] for r in parsed.edges["HAS_ELEMENT"].collect())
    assert D.summary(parsed)["element"] == len(ids["element"])
    assert parsed.edges["HAS_SECTION"].count() + parsed.edges["HAS_SUBSECTION"].count() == len(ids["section"])


def test_chunk_sets_and_hierarchy(parsed):
    one = D.with_chunks(parsed, "by_page")
    two = D.with_chunks(one, "token_window")
    rows = two.nodes["chunk"].groupBy("chunk_set_version", "active").count().collect()
    assert {(r.chunk_set_version, r.active) for r in rows} == {(1, False), (2, True)}
    assert two.nodes["chunk"].groupBy("id").count().where("count > 1").count() == 0
    assert D.with_chunks(one, "by_section", clear=True).nodes["chunk"].where("chunk_set_version <> 1").count() == 0
    flat = parsed.nodes["section"].select("id", F.lit(1).alias("level"))
    h = D.with_hierarchy(one, flat)
    assert h.edges["HAS_SUBSECTION"].count() == 0 and h.nodes["chunk"].where("section_context is not null").count() > 0
    assert D.merged(one, one).nodes["page"].count() == 2 * one.nodes["page"].count()


def test_guarded_reads(parsed):
    n = D.read(parsed, "SELECT count(*) AS n FROM {page} p JOIN {has_page} h ON h.dst = p.id").first().n
    assert n == parsed.nodes["page"].count()
    with pytest.raises(PermissionError):
        D.read(parsed, "INSERT INTO {page} VALUES (1)")


def test_layout_labels_and_placeholders(spark):
    items = spark.createDataFrame([("Title",), ("page_header",), ("odd",), ("picture",)], "label string")
    assert [r.type for r in D.relabelled(items).collect()] == ["heading", "paragraph", "image"]
    box = "document_id string, page_number int, box struct<x0: double, y0: double, x1: double, y1: double>"
    blocks = spark.createDataFrame([("d", 0, (0.0, 9.0, 1.0, 9.0), "below"), ("d", 0, (0.0, 1.0, 1.0, 2.0), "above")], f"{box}, text string")
    visuals = spark.createDataFrame([("d", 0, (0.0, 5.0, 1.0, 6.0), "f1", "image")], f"{box}, id string, kind string")
    assert D.interleaved(blocks, visuals).first().text == "above\n\n[IMAGE: f1]\n\nbelow"
    assert [r[0] for r in spark.createDataFrame([("d", "s"), ("", "s"), ("d", None)], "a string, b string").select(D.context(F.col("a"), F.col("b"))).collect()] == ["d > s", "s", "d"]


def test_names_and_prompt(spark):
    assert (naming.snake("HTTPServer nameX"), naming.pascal("party_to"), naming.plural("party"), naming.plural("box")) == ("http_server_name_x", "PartyTo", "parties", "boxes")
    assert naming.endpoint_fields("Party", "Party", "name", "name") == ("source_party_name", "target_party_name")
    text = naming.prompt(ontology.loaded(ontology.legal_sample(spark), "legal_demo"))
    assert "- Party: name string (key)" in text and "- Party PARTY_TO Contract: role" in text


def test_tasks_of_a_graph_follow_from_its_elements(spark, sf, monkeypatch):
    from graphloom.plans import upkeep

    monkeypatch.setattr(D, "ROWS", 100, raising=False)
    g = upkeep._graph(spark, sf)
    least = g.nodes["element"].count() // 100
    for name in ("HAS_ELEMENT", "NEXT_ELEMENT", "NEXT_PAGE", "HAS_SUBSECTION"):
        assert g.edges[name].rdd.getNumPartitions() >= least > 4
