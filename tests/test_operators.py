import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunk, extract, graph, layout, ontology, retrieval, upsert, verify, versioning, visuals
from graphloom.plans.documents import documents, elements, sections, windows
from graphloom.plans.entities import broken_ontology


def test_window_starts(spark):
    def starts(n, size=500, overlap=50):
        return spark.range(1).select(chunk.window_starts(F.lit(n), size, overlap).alias("s")).first().s

    assert [starts(n) for n in (0, 450, 451, 500, 1000)] == [[], [0], [0, 450], [0, 450], [0, 450, 900]]
    assert starts(1000, 50, 50) == [0]


def test_windows_cover_every_token_and_chains_have_one_head(spark, sf):
    w = windows(spark, sf)
    ends = w.groupBy("document_id").agg(F.max(F.col("idx") * 450 + F.col("token_count")).alias("end"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\r\n\f]+)"), 1)).alias("n"))
    assert ends.join(docs, "document_id").where("end <> n").count() == 0
    chunks = w.withColumn("id", F.concat_ws("_", "document_id", "idx"))
    heads = graph.linked(chunks, chunk.next_chunks(chunks), "id", "dst", negate=True)
    assert heads.groupBy("document_id").count().where("count <> 1").count() == 0


def plain_chunks(rows, size):
    out, special, acc, heading, start = [], [], [], "", ""

    def flush():
        if acc:
            out.append(("\n\n".join(t for t, _ in acc), start))
            acc.clear()

    count = lambda t: len(t.split())
    for kind, text in rows:
        if kind == "table":
            special.append(text)
            continue
        if kind == "heading":
            heading = text
            if acc and sum(count(t) for t, _ in acc) >= size // 2:
                flush()
        if not acc:
            start = heading
        if count(text) > size:
            flush()
            out.append((text, heading))
            continue
        if acc and sum(count(t) for t, _ in acc) + count(text) > size:
            if len(acc) > 1 and acc[-1][1] == "heading":
                last = acc.pop()
                flush()
                start = heading = last[0]
                acc.append(last)
            else:
                flush()
                start = heading
        acc.append((text, kind))
    flush()
    return out, special


def test_structured_equals_a_plain_loop():
    import random

    r = random.Random(5)
    for _ in range(200):
        rows = [(r.choice(["heading", "paragraph", "paragraph", "table"]), " ".join("w" * r.randint(1, 3) for _ in range(r.choice([1, 2, 5, 9, 25])))) for _ in range(r.randint(1, 20))]
        state = chunk.Gather(20)
        got = [x for k, (a, b) in enumerate(rows) for x in state.row(str(k), a, b, None)] + state.end()
        text, special = plain_chunks(rows, 20)
        assert [(x[2], x[4]) for x in got if x[1] == "text"] == text
        assert [x[2] for x in got if x[1] != "text"] == special


def test_dispatch(spark, sf):
    e, s = elements(spark, sf).where("document_id < 20"), sections(spark, sf)
    assert chunk.chunked("by_page", e).count() and chunk.chunked("token_window", e).count() and chunk.chunked("structured", e, size=50).count()
    with pytest.raises(ValueError):
        chunk.chunked("other", e, s)


def test_versions_go_on_and_one_is_active(spark):
    known = spark.createDataFrame([("a", 2)], "source_id string, version int")
    got = versioning.versioned(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source string, n int"), "source", "n", known)
    assert sorted((r.id, r.active) for r in got.collect()) == [("a_v3", False), ("a_v4", True), ("b_v1", True)]


def test_delete_leaves_no_dangling_edge_and_prefixes_apart(spark, sf):
    docs = spark.createDataFrame([(f"x_v{k}", "x", k, k == 11) for k in range(1, 12)], "id string, source_id string, version int, active boolean")
    chunks = spark.createDataFrame([(f"{d}_c{k}", f"x_v{n}", k == 0) for n in (1, 10, 11) for k in range(3) for d in [f"x_v{n}"]], "id string, document_id string, active boolean")
    left, counts = versioning.deleted({"document": docs, "chunk": chunks}, spark.createDataFrame([("x_v1",)], "id string"))
    assert {r.label: r.n for r in counts.collect()} == {"document": 1, "chunk": 3} and left["chunk"].count() == 6
    edges = graph.chain(chunks, ["document_id"], ["id"], "id")
    kept, cut = versioning.without_chunks(chunks, edges, only_inactive=True)
    ids = {r.id for r in kept.collect()}
    assert all(r.src in ids and r.dst in ids for r in cut.collect()) and len(ids) == 3
    assert versioning.effective_active(chunks, docs).count() == 1
    now, n = versioning.deactivated(docs, F.col("source_id") == "x")
    assert n.first().deactivated == 1 and now.where("active").count() == 0
    assert versioning.next_chunk_set(spark.createDataFrame([("d", 3)], "document_id string, chunk_set_version int"), "d").first()[0] == 4
    assert documents(spark, sf).where("active").groupBy("source_id").count().where("count <> 1").count() == 0


def test_upsert_is_idempotent_and_keeps_the_last_value(spark):
    schema = "label string, key string, props map<string, string>, seq long"
    a = spark.createDataFrame([("P", "1", {"x": "a", "y": "b"}, 1), ("P", "1", {"x": None, "y": "c"}, 2), ("P", "2", {}, 3)], schema)
    once = upsert.upserted(a.limit(0), a)
    twice = upsert.upserted(once, a)
    want = [("P", "1", {"x": "a", "y": "c"}), ("P", "2", {})]
    assert [sorted((r.label, r.key, r.props) for r in t.collect()) for t in (once, twice)] == [want, want]


def test_every_check_of_the_ontology_and_the_sample(spark):
    t = ontology.legal_sample(spark)
    assert ontology.validated(t, "legal_demo").count() == 0
    assert [r.check for r in ontology.validated(t, "legal_demo", strict=True).collect()] == ["invalid_normalizer_tag"]
    assert len({r.check for n in ("bad", "empty", "absent") for r in ontology.validated(broken_ontology(spark), n).collect()}) == 19
    with pytest.raises(LookupError):
        ontology.loaded(t, "absent")
    with pytest.raises(ValueError):
        ontology.loaded(broken_ontology(spark), "bad")
    assert all(x.count() == 0 for x in ontology.deleted(t, "legal_demo").values())
    again = ontology.upserted(t, t)
    assert all(again[n].count() == t[n].count() for n in t)


def test_extraction_drops_items_not_chunks(spark):
    schema = ontology.loaded(ontology.legal_sample(spark), "legal_demo")
    items = {"entities": [{"label": "Contract", "properties": {"title": "T", "contractType": "weird"}}, {"label": "Party", "properties": {"name": "A"}}, {"label": "Party", "properties": {}}], "relationships": [{"type": "PARTY_TO", "source_key": " A ", "target_key": "T", "properties": {"role": "X"}}]}
    rows = spark.createDataFrame([("c", 0, json.dumps(items)), ("d", 1, "not json")], "chunk_id string, idx int, response string")
    entities, edges = extract.parsed(rows, schema)
    assert [(r.label, r.key) for r in entities.collect()] == [("Party", "A")]
    assert [(r.src, r.dst, r.props) for r in edges.collect()] == [("A", "T", {"role": "x"})]


def test_dictionary_extractor_end_to_end(spark):
    schema = ontology.loaded(ontology.legal_sample(spark), "legal_demo")
    chunks = spark.createDataFrame([("c1", 0, "Acme meets Bolt"), ("c2", 1, "Acme alone"), ("c3", 2, "none")], "id string, idx int, text string")
    terms = spark.createDataFrame([("Party", "name", "Acme"), ("Party", "name", "Bolt")], "label string, key_name string, term string")
    entities, _ = extract.parsed(extract.by_dictionary(chunks, terms), schema)
    assert sorted((r.key, r.chunk_id) for r in entities.collect()) == [("Acme", "c1"), ("Acme", "c2"), ("Bolt", "c1")]
    done = entities.select("chunk_id")
    assert [r.id for r in extract.pending(chunks, done).collect()] == ["c3"] and extract.pending(chunks, done, force=True).count() == 3


def test_chunk_sections_and_paths(spark):
    chunks = spark.createDataFrame([("c1", "d", ["e9", "e1"], ""), ("c2", "d", [], "Two"), ("c3", "d", [], "None")], "id string, document_id string, element_ids array<string>, section_heading string")
    member = spark.createDataFrame([("e1", "s1")], "element_id string, section_id string")
    paths = spark.createDataFrame([("d", "s1", 0, "One"), ("d", "s2", 1, "One > Two")], "document_id string, section_id string, ordinal int, path string")
    assert {r.id: r.section_path for r in layout.chunk_sections(chunks, member, paths).collect()} == {"c1": "One", "c2": "One > Two", "c3": None}


def test_walk_guards_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcxy"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    got = {r.id: (r.head, r.position) for r in graph.walk(nodes, edges, 5).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", -1), "y": ("y", -1)}


def test_numbers_are_padded_but_never_cut(spark):
    got = graph.numbered(spark.range(10002).withColumn("p", F.lit("d")), ["p"], ["id"], F.col("p"), "_chunk_").agg(F.min("id"), F.max(F.length("id"))).first()
    assert got[0] == "d_chunk_0000" and got[1] == len("d_chunk_10001")


def test_embedding_batches_survive_failures(spark):
    rows = spark.createDataFrame([(str(k), "bad" if k == 3 else "ok", None, True, "d") for k in range(6)], "id string, text string, text_embedding array<float>, active boolean, document_name string")

    def embed(texts):
        if (texts == "bad").any():
            raise RuntimeError("provider")
        return pd.Series([[1.0, 2.0]] * len(texts))

    asked = retrieval.to_embed(rows, ["text"])
    assert asked.count() == 6 and retrieval.to_embed(rows, ["text"], document="e").count() == 0
    got = retrieval.embedded(asked.repartition(1), embed, batch=1, retries=2)
    assert sorted(r.id for r in got.collect()) == ["0", "1", "2", "4", "5"]


def test_descriptions(spark):
    schema = "id string, kind string, image binary, text string, text_description string, labels array<string>"
    a = spark.createDataFrame([("1", "image", b"x", None, None, ["Image"]), ("2", "table", None, "t", None, ["Table"])], schema)
    b = spark.createDataFrame([("1", "page", b"y", None, None, ["Page"]), ("3", "page", b"z", None, "old", ["Page"])], schema)
    asked = visuals.to_describe(a, b)
    assert [(r.id, r.kind) for r in asked.collect()] == [("1", "image")]
    found = visuals.described(asked, lambda f: f["kind"] + " " + f["id"])
    assert {r.id: (r.text_description, r.labels) for r in visuals.written_back(a, found).collect()} == {"1": ("image 1", ["Image", "Chunk"]), "2": (None, ["Table"])}
    assert visuals.report(found).first().mean_length == 7.0


def test_orphans_and_statistics(spark, sf):
    e = elements(spark, sf)
    assert verify.orphans(e, chunk.by_page(e)).count() == 0
    assert graph.repeated_keys(e, "id").count() == 0


def test_walk_follows_chains_of_any_length(spark, tmp_path):
    from graphloom.plans import documents

    rows = [(c, t) for c, n in ((1, 300), (2, 9), (3, 1), (4, 10)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, documents.chain_walk(spark, str(tmp_path)).collect()))
    assert got == sorted((c * 1000 + t, c * 1000, t) for c, t in rows)
    nodes = spark.createDataFrame([(k,) for k in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (5, 6), (6, 5)], "src long, dst long")
    got = sorted(map(tuple, graph.walk(nodes, edges).collect()))
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 3, 0), (4, 4, 0), (5, 5, -1), (6, 6, -1), (7, 7, 0)]


def test_images_are_dropped_only_for_earlier_ones_that_stay(spark):
    from pyspark.sql import functions as F

    at = [(1, k, 4.0 * k, 0.0) for k in range(1, 8)] + [(2, 1, 0.0, 0.0), (2, 2, 4.9, -4.9), (2, 3, 5.0, 0.0), (2, 4, -0.1, 0.1)]
    df = spark.createDataFrame(at, "page int, image_idx int, x0 double, y0 double")
    rows = df.select("page", "image_idx", F.struct("x0", "y0").alias("box"))
    kept = []
    for p, i, x, y in at:
        if not any(q == p and abs(a - x) < 5 and abs(b - y) < 5 for q, _, a, b in kept):
            kept.append((p, i, x, y))
    got = sorted((r.page, r.image_idx) for r in layout.distinct_boxes(rows, ["page"]).collect())
    assert got == [(p, i) for p, i, _, _ in kept] and (1, 3) in got
    assert layout.distinct_boxes(rows.limit(0), ["page"]).count() == 0


def test_reachable_ends_in_cycles_and_at_the_depth(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(20, 0)], "src int, dst int")
    roots = spark.createDataFrame([(0,)], "id int")
    got = {r.id: r.depth for r in graph.reachable(edges, roots).collect()}
    assert got == {k: k for k in range(1, 21)} | {0: 21}
    assert graph.reachable(edges, roots, 2).count() == 2 and graph.reachable(edges, roots.where("id > 50")).count() == 0


def test_search_of_many_queries_with_ties_and_empty_vectors(spark):
    import numpy as np

    from graphloom.operators import retrieval

    r = np.random.default_rng(2)
    v = [[float(x) for x in r.integers(-2, 3, 6)] for _ in range(200)] + [None, [0.0] * 6]
    rows = spark.createDataFrame(list(enumerate(v)), "id int, vector array<double>").repartition(7)
    asked = spark.createDataFrame([(q, v[q]) for q in range(9)] + [(50, [0.0] * 6)], "query_id int, query array<double>")
    got = sorted((x.query_id, x.rank, x.id) for x in retrieval.nearest_many(rows, asked, 5).collect())
    want = []
    for q in range(9):
        if any(v[q]):
            score = [(-round(float(np.dot(v[q], x) / np.linalg.norm(v[q]) / np.linalg.norm(x)), 9), i) for i, x in enumerate(v) if x and any(x)]
            want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(score)[:5])]
    assert got == sorted(want)


def test_small_filters(spark):
    from graphloom.functions.text import data_uri
    from graphloom.operators import document_graph as D

    docs = spark.createDataFrame([("a", True, "docling"), ("b", True, "pymupdf"), ("c", False, "docling"), ("d", None, None)], "id string, active boolean, parse_mode string")
    chunks = spark.createDataFrame([("a",)], "document_id string")
    assert [r.id for r in D.needs_chunking(docs, chunks).collect()] == ["d"]
    t = spark.createDataFrame([(1, 1), (2, 1), (1, 3)], "n_rows int, n_columns int")
    assert layout.real_tables(t).count() == 2
    u = spark.createDataFrame([("data:image/png;base64,aGk=",), ("http://x",), (None,)], "u string")
    got = [r.d for r in u.select(data_uri(u.u).alias("d")).collect()]
    assert (got[0].mime, bytes(got[0].data), got[1:]) == ("image/png", b"hi", [None, None])


def test_extraction_reads_its_responses_once(spark):
    """All results of a batch read what was kept: the source is asked once, whatever the number of labels and results."""
    field = lambda owner: ("o", owner, "name", "STRING", True, True, "lowercase", None, None, None, None, None, None, None)
    schema = ontology.loaded(ontology.tables(spark, ontology=[("o", "1")], node_type=[("o", n, None) for n in "AB"], property=[field("A"), field("B")]), "o")
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    said = [(f"c{n}", 0, '{"entities": [{"label": "%s", "properties": {"name": "X%d"}}]}' % ("AB"[n % 2], n % 3)) for n in range(6)]
    rows = spark.createDataFrame(said, "chunk_id string, idx int, response string")
    none = spark.createDataFrame([], "label string, key string, props map<string, string>, seq long")
    no_edge = spark.createDataFrame([], "type string, src_label string, src string, dst_label string, dst string, props map<string, string>, seq long")
    entities, edges, source = extract.extracted(rows.mapInArrow(seen, rows.schema), schema, none, no_edge, "m")
    want = {("AB"[n % 2], f"x{n % 3}") for n in range(6)}
    assert {(x.label, x.key) for x in entities.collect()} == want and source.count() == 6 and edges.count() == 0
    assert asked.value == 6
