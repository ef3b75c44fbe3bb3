"""Queries over tables as graphs: joins, aggregates, normalizers, upserts, ontology."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..functions import normalize as N
from ..functions.text import clean_key
from ..operators import analytics, graph, ontology, store, upsert
from ..operators.extract import by_dictionary, extracted
from ..sources.files import nodes_from
from .registry import query, table


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def optional_expand(spark, sf_dir):
    """Two optional hops; orders are summed by customer before they meet the customers."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(orders, "c_custkey", "left")
    by = customers.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.sum("v").alias("value"))
    out = table(spark, sf_dir, "nation").join(by, "n_nationkey", "left").na.fill(0, ["customers", "orders", "value"])
    return out.select("n_name", "customers", "orders", "value")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)")
def unlinked_customers(spark, sf_dir):
    """Customers without an order whose number is a multiple of seven."""
    edges = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return graph.linked(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), edges, "c_custkey", negate=True)


@query("SELECT 'customer' AS label, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'part', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'order', o_orderstatus, count(*) FROM orders GROUP BY 2")
def label_histogram(spark, sf_dir):
    parts = [("customer", "customer", "c_mktsegment"), ("part", "part", "p_brand"), ("order", "orders", "o_orderstatus")]
    rows = [table(spark, sf_dir, t).select(F.lit(label).alias("label"), F.col(c).alias("kind")) for label, t, c in parts]
    return graph.histogram(reduce(DataFrame.unionByName, rows), "label", "kind")


@query("SELECT o_custkey AS a, count(DISTINCT l_partkey) AS n_c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def multi_hop_reach(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    holds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return analytics.reach(placed, holds)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20")
def top_shared_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return analytics.shared_pairs(e, 20)


@query("SELECT 'nation' || n_nationkey AS id, 2 AS depth FROM nation UNION ALL SELECT 'region' || r_regionkey, 1 FROM region")
def variable_length(spark, sf_dir):
    """From a root over regions to nations, up to four hops."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst"))
    edges = edges.unionByName(region.select(F.lit("world").alias("src"), node("region", "r_regionkey").alias("dst")))
    return graph.reachable(edges, spark.createDataFrame([("world",)], "id string"), 4).select("id", "depth")


@query("SELECT 'Customer' AS label, o_custkey::VARCHAR AS key, 'priority' AS name, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey UNION ALL SELECT 'Customer', o_custkey::VARCHAR, 'open', arg_max('yes', o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey UNION ALL SELECT 'Customer', c_custkey::VARCHAR, 'name', c_name FROM customer WHERE c_custkey % 3 = 0")
def entity_upsert(spark, sf_dir):
    """A third of the customers are known; every order writes to its customer, the last value of a property wins."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    known = nodes_from(known.select("c_custkey", F.col("c_name").alias("name")), "Customer", "c_custkey").withColumn("props", F.map_filter("props", lambda k, v: k == "name"))
    orders = table(spark, sf_dir, "orders")
    props = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("open"), F.when(F.col("o_orderstatus") == "O", "yes"))
    incoming = orders.select(F.lit("Customer").alias("label"), F.col("o_custkey").cast("string").alias("key"), props.alias("props"), F.col("o_orderkey").alias("seq"))
    return upsert.upserted(known, incoming).select("label", "key", F.explode("props").alias("name", "value"))


@query("SELECT 'SUPPLIES' AS type, l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 20 JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 2, 3")
def edge_upsert(spark, sf_dir):
    """Relationships whose ends do not exist vanish."""
    part = table(spark, sf_dir, "part").where("p_size > 20").select(F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("key"))
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("Supplier").alias("label"), F.col("s_suppkey").cast("string").alias("key"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("SUPPLIES").alias("type"), F.lit("Supplier").alias("src_label"), F.col("l_suppkey").cast("string").alias("src"), F.lit("Part").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("props"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    out = upsert.upserted_edges(rows.limit(0), rows, part.unionByName(supplier), rows.count())
    return out.select("type", "src", "dst", F.col("props")["flag"].alias("flag"))


_BATCHES = "CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END"


@query(f"""WITH o AS (SELECT *, {_BATCHES} * 1000000000000 + o_orderkey AS nth FROM orders)
SELECT o_custkey::VARCHAR AS key, 'priority' AS name, arg_max(o_orderpriority, nth) AS value FROM o GROUP BY o_custkey
UNION ALL SELECT o_custkey::VARCHAR, 'open', arg_max('order ' || o_orderkey, nth) FROM o WHERE o_orderstatus = 'O' GROUP BY o_custkey""")  # fmt: skip
def incremental_upsert(spark, sf_dir):
    """Two batches of orders merged into files bucketed by key, the second one twice, as after a failure."""
    orders = table(spark, sf_dir, "orders")
    props = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("open"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))
    rows = orders.select(F.lit("Customer").alias("label"), F.col("o_custkey").cast("string").alias("key"), props.alias("props"), F.col("o_orderkey").alias("seq"))
    kept = store.Store(spark, f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}", buckets=16)
    kept.merged(rows.where("seq % 3 <> 0"))
    for _ in range(2):
        kept.merged(rows.where("seq % 3 = 0"))
    return kept.rows().select("key", F.explode("props").alias("name", "value"))


@query("SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, arg_max(l_returnflag, (CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) * 1000000000000 + l_orderkey * 10 + l_linenumber) AS flag FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 20 JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1, 2")
def incremental_edges(spark, sf_dir):
    """The same for relationships, whose ends must be entities."""
    part = table(spark, sf_dir, "part").where("p_size > 20").select(F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("key"))
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("Supplier").alias("label"), F.col("s_suppkey").cast("string").alias("key"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.lit("SUPPLIES").alias("type"), F.lit("Supplier").alias("src_label"), F.col("l_suppkey").cast("string").alias("src"), F.lit("Part").alias("dst_label"), F.col("l_partkey").cast("string").alias("dst"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("props"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    kept = store.Store(spark, f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}", buckets=16)
    for batch in ("l_linenumber <= 2", "l_linenumber > 2"):
        kept.merged_edges(rows.where(batch), part.unionByName(supplier))
    return kept.edges().select("src", "dst", F.col("props")["flag"].alias("flag"))


@query("SELECT c_custkey, coalesce(o.status, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def update_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("none").alias("status"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return upsert.updated(rows, changes, "c_custkey", ["status"])


@query("SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\\s+', ' ', 'g')) AS ws, upper(p_name) AS up, lower(p_type) AS low, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') AS title FROM part")
def norm_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    messy = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))
    return p.select("p_partkey", N.whitespace(messy).alias("ws"), N.uppercase(F.col("p_name")).alias("up"), N.lowercase(F.col("p_type")).alias("low"), N.titlecase(F.lower("p_name")).alias("title"))


@query("SELECT p_partkey, round(round(p_retailprice, 2) * 1e6, 2) AS amount, p_size::DOUBLE AS pct, p_size::BIGINT * 1000 AS whole, '+49' || p_partkey AS phone, 'https://ex.com/P' || p_partkey AS url, 'a' || p_partkey || '@b.com' AS email, CASE p_partkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'CHF' END AS currency FROM part")
def norm_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 3
    cell = {
        "amount": F.round(N.monetary_amount(F.concat(F.lit("$"), F.format_number("p_retailprice", 2), F.lit(" million"))), 2),
        "pct": N.percentage(F.concat(F.col("p_size").cast("string"), F.lit(" %"))),
        "whole": N.integer(F.concat(F.col("p_size").cast("string"), F.lit(",000"))),
        "phone": N.phone(F.concat(F.lit(" +49 ("), key, F.lit(")"))),
        "url": N.url(F.concat(F.lit("HTTPS://Ex.COM/P"), key, F.lit("//"))),
        "email": N.email(F.concat(F.lit(" A"), key, F.lit("@B.com "))),
        "currency": N.currency(F.when(k == 0, "€").when(k == 1, "Dollars").otherwise(" chf ")),
    }
    return p.select("p_partkey", *(c.alias(n) for n, c in cell.items()))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def norm_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "d MMMM yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select("o_orderkey", N.date(text).alias("d"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'AUTOMOBILE' THEN 'Cars' ELSE c_mktsegment END AS segment, c_mktsegment IN ('FURNITURE') AS blocked, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS not_listed, regexp_replace(c_name, '[#_\\-\\s]+', '.', 'g') AS dotted FROM customer")
def alias_blocklist_enum(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), F.col("c_mktsegment")
    steps = {
        "segment": N.chain(s, [("alias_map", {"aliases": {"BUILDING": "Construction", "AUTOMOBILE": "Cars"}})])[0],
        "blocked": N.chain(s, [("whitespace", None), ("blocklist", {"terms": ["FURNITURE"]})])[1],
        "not_listed": N.chain(s, [("enum_validate", {"values": ["BUILDING", "MACHINERY"]})])[1],
        "dotted": N.chain(F.col("c_name"), [("regex_normalize", {"pattern": r"[#_\-\s]+", "replacement": "."})])[0],
    }
    return c.select("c_custkey", *(x.alias(n) for n, x in steps.items()))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'USD ' || s_suppkey || '.0 penalty' END AS name FROM supplier")
def compose_name(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = N.compose_name(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), "{currency} {amount} penalty", {"currency": F.lit("USD"), "amount": N.number_text(F.col("s_suppkey").cast("double"))})
    return s.select("s_suppkey", name.alias("name"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, replace(replace('key of-' || event_type, ' ', '_'), '-', '_') AS name FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), clean_key(F.concat(F.lit("key of-"), "event_type")).alias("name"))


#: Ontologies of the regions: suppliers are their node types, customers their relationship types.  Faults follow from keys.
_ONTOLOGY = """WITH supp AS (
  SELECT r_name AS ontology, s_name AS name, s_suppkey AS k, r_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
), nt AS (SELECT ontology, name, k FROM supp WHERE r_regionkey <> 4
), prop AS (
  SELECT ontology, name AS owner, 'p' || i AS name, name || '.p' || i AS spelled, CASE WHEN (k + i) % 11 = 0 THEN 'DATE' WHEN i % 3 = 1 THEN 'FLOAT' ELSE 'STRING' END AS type, i < k % 3 AS is_key,
         CASE (k * 7 + i * 3) % 13 WHEN 0 THEN 'alias_map' WHEN 1 THEN 'blocklist' WHEN 2 THEN 'regex_normalize' WHEN 3 THEN 'regex_skip' WHEN 4 THEN 'enum_validate' WHEN 5 THEN 'compose_name_from_fields' WHEN 6 THEN 'unheard_of' WHEN 7 THEN 'whitespace' END AS tag,
         k % 2 = 0 AS linked, k % 3 <> 0 AS pattern, k % 3 = 1 AS replacement, k % 3 = 2 AS listed
  FROM nt, unnest(range(0, k % 4 + 1)) AS t(i)
), rel AS (
  SELECT r_name AS ontology, c_name AS name, c_custkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
), ends AS (
  SELECT ontology, name, k, e, i, 'Supplier#' || lpad(((k * 7 + i) % 50)::VARCHAR, 9, '0') AS node_type
  FROM rel, (VALUES ('from'), ('to')) AS x(e), unnest(range(0, CASE WHEN e = 'from' THEN k % 4 ELSE (k + 1) % 3 END)) AS t(i)
), dict AS (
  SELECT r_name AS ontology, r_regionkey AS r, kind, kind || i AS name, i FROM region, (VALUES ('alias_map'), ('blocklist')) AS x(kind), unnest(range(0, 6)) AS t(i)
), counts AS (SELECT ontology, name, count(*) FILTER (e = 'from') AS f, count(*) FILTER (e = 'to') AS t FROM ends GROUP BY 1, 2
), keys AS (SELECT nt.ontology, nt.name, count(prop.owner) FILTER (is_key) AS n FROM nt LEFT JOIN prop ON prop.ontology = nt.ontology AND prop.owner = nt.name GROUP BY 1, 2
), found AS (
  SELECT ontology, 'missing_key_property' AS c, name AS entity FROM keys WHERE n = 0 UNION ALL SELECT ontology, 'multiple_key_properties', name FROM keys WHERE n > 1
  UNION ALL SELECT ontology, 'missing_from_endpoint', name FROM rel LEFT JOIN counts USING (ontology, name) WHERE coalesce(f, 0) = 0
  UNION ALL SELECT ontology, 'missing_to_endpoint', name FROM rel LEFT JOIN counts USING (ontology, name) WHERE coalesce(t, 0) = 0
  UNION ALL SELECT ontology, 'multiple_from_endpoints', name FROM counts WHERE f > 1 UNION ALL SELECT ontology, 'multiple_to_endpoints', name FROM counts WHERE t > 1
  UNION ALL SELECT ontology, 'endpoint_outside_ontology', name FROM ends WHERE NOT EXISTS (SELECT 1 FROM nt WHERE nt.ontology = ends.ontology AND nt.name = ends.node_type)
  UNION ALL SELECT ontology, 'invalid_property_type', spelled FROM prop WHERE type = 'DATE' UNION ALL SELECT ontology, 'invalid_normalizer_tag', spelled FROM prop WHERE tag = 'unheard_of'
  UNION ALL SELECT ontology, 'alias_map_missing_link', spelled FROM prop WHERE tag = 'alias_map' AND NOT linked UNION ALL SELECT ontology, 'blocklist_missing_link', spelled FROM prop WHERE tag = 'blocklist' AND NOT linked
  UNION ALL SELECT ontology, 'regex_normalize_missing_config', spelled FROM prop WHERE tag = 'regex_normalize' AND NOT (pattern AND replacement) UNION ALL SELECT ontology, 'regex_skip_missing_config', spelled FROM prop WHERE tag = 'regex_skip' AND NOT pattern
  UNION ALL SELECT ontology, 'enum_validate_missing_values', spelled FROM prop WHERE tag = 'enum_validate' AND NOT listed UNION ALL SELECT ontology, 'compose_name_missing_template', spelled FROM prop WHERE tag = 'compose_name_from_fields' AND NOT linked
  UNION ALL SELECT ontology, kind || '_empty', name FROM dict WHERE (i + r) % 3 = 0
  UNION ALL SELECT r_name, 'ontology_no_node_types', r_name FROM region WHERE r_name NOT IN (SELECT ontology FROM nt) UNION ALL SELECT 'ATLANTIS', 'ontology_not_found', 'ATLANTIS'
) SELECT ontology, c AS "check", entity FROM found"""  # fmt: skip


def region_ontologies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Ontologies from the given tables, see ``_ONTOLOGY``; their faults follow from the keys."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", F.col("r_name").alias("ontology"))
    of = lambda rows, key: rows.join(place, F.col(key) == F.col("n_nationkey"))
    nodes = of(table(spark, sf_dir, "supplier"), "s_nationkey").where("r_regionkey <> 4").select("ontology", F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    relations = of(table(spark, sf_dir, "customer"), "c_nationkey").select("ontology", F.col("c_name").alias("name"), F.col("c_custkey").alias("k"))
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("i")
    k, i = F.col("k"), F.col("i")
    tag = F.get(F.array(*map(F.lit, ("alias_map", "blocklist", "regex_normalize", "regex_skip", "enum_validate", "compose_name_from_fields", "unheard_of", "whitespace"))), ((k * 7 + i * 3) % 13).cast("int"))
    text = lambda test, value: F.when(test, F.lit(value))
    props = nodes.select("ontology", F.col("name").alias("owner"), "k", upto((k % 4).cast("int") + 1)).select(
        "ontology", "owner", F.concat(F.lit("p"), i.cast("string")).alias("name"), F.when((k + i) % 11 == 0, "DATE").when(i % 3 == 1, "FLOAT").otherwise("STRING").alias("type"), F.lit(False).alias("required"), (i < k % 3).alias("is_key"),
        tag.alias("normalizer"), F.lit(None).cast("array<string>").alias("normalizers"), text(k % 3 != 0, "x").alias("regex_pattern"), text(k % 3 == 1, "y").alias("regex_replacement"),
        F.when(k % 3 == 2, F.array(F.lit("a"))).when(k % 3 == 1, F.array().cast("array<string>")).alias("enum_values"), text(k % 2 == 0, "{p0}").alias("name_template"), text(k % 2 == 0, "alias_map0").alias("alias_map"), text(k % 2 == 0, "blocklist0").alias("blocklist"),
    )
    end = lambda name, n: relations.select("ontology", F.col("name").alias("relationship"), F.lit(name).alias("end"), "k", upto(n.cast("int"))).select("ontology", "relationship", "end", F.format_string("Supplier#%09d", (k * 7 + i) % 50).alias("node_type"))
    words = region.select(F.col("r_name").alias("ontology"), F.col("r_regionkey").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    full = words.where((i + F.col("r")) % 3 != 0)
    name = lambda kind: F.concat(F.lit(kind), i.cast("string"))
    return {
        "ontology": region.select(F.col("r_name").alias("name"), F.lit("1").alias("version")),
        "node_type": nodes.select("ontology", "name", F.lit(None).cast("string").alias("description")),
        "relationship_type": relations.select("ontology", "name"),
        "endpoint": end("from", k % 4).unionByName(end("to", (k + 1) % 3)),
        "property": props,
        "alias": full.select("ontology", name("alias_map").alias("alias_map"), F.lit("a").alias("alias"), F.lit("b").alias("canonical")),
        "blocked": full.select("ontology", name("blocklist").alias("blocklist"), F.lit("t").alias("term")),
        "dictionary": words.select("ontology", F.lit("alias_map").alias("kind"), name("alias_map").alias("name")).unionByName(words.select("ontology", F.lit("blocklist").alias("kind"), name("blocklist").alias("name"))),
    }


@query(_ONTOLOGY)
def ontology_validate(spark, sf_dir):
    """All nineteen checks over ontologies made of the given tables, and one that is not there."""
    t = region_ontologies(spark, sf_dir)
    names = [r.r_name for r in table(spark, sf_dir, "region").collect()]
    return ontology.validated(t, *names, "ATLANTIS").select("ontology", "check", "entity")


_WORDS = r"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\d]+')) AS term FROM benchmark
), blocked AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\d]+')) AS term FROM benchmark WHERE item_id < 5
), hit AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\d]+')) AS term FROM documents) JOIN terms USING (term)
), typed AS (
  SELECT doc_id, CASE WHEN length(term) <= 3 THEN 'Short' WHEN length(term) <= 7 THEN 'Middle' ELSE 'Long' END AS label,
         CASE WHEN length(term) <= 3 THEN lower(term) ELSE term END AS key FROM hit
  WHERE length(term) <= 7 OR term NOT IN (SELECT term FROM blocked)
)"""  # fmt: skip


def word_ontology(spark: SparkSession, sf_dir: str):
    """Words of the benchmark as things of three types, each with a normalizer of its own, and what a dictionary finds."""
    words = lambda rows: rows.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\d]+)"), 1)).alias("term")).distinct()
    items = table(spark, sf_dir, "benchmark")
    terms = words(items).select(F.when(F.length("term") <= 3, "Short").when(F.length("term") <= 7, "Middle").otherwise("Long").alias("label"), F.lit("name").alias("key_name"), "term")
    field = lambda owner, tag, blocked=None: ("words", owner, "name", "STRING", True, True, tag, None, None, None, None, None, None, blocked)
    t = ontology.tables(
        spark,
        ontology=[("words", "1")],
        node_type=[("words", n, None) for n in ("Short", "Middle", "Long")],
        property=[field("Short", "lowercase"), field("Middle", "whitespace"), field("Long", "blocklist", "USUAL")],
        blocked=[("words", "USUAL", r.term) for r in words(items.where("item_id < 5")).collect()],
        dictionary=[("words", "blocklist", "USUAL")],
    )
    return ontology.loaded(t, "words"), terms


@query(_WORDS + " SELECT label, key, count(DISTINCT doc_id) AS n_documents FROM typed GROUP BY 1, 2")
def ontology_extract(spark, sf_dir):
    """Every document through the dictionary extractor, the ontology's normalizers, the upsert and the provenance."""
    schema, terms = word_ontology(spark, sf_dir)
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("idx"), "text")
    none = spark.createDataFrame([], "label string, key string, props map<string, string>, seq long")
    no_edge = spark.createDataFrame([], "type string, src_label string, src string, dst_label string, dst string, props map<string, string>, seq long")
    entities, _, source = extracted(by_dictionary(chunks, terms), schema, none, no_edge, "dictionary")
    return source.join(entities.select("label", "key"), ["label", "key"], "left_semi").groupBy("label", "key").agg(F.count_distinct("chunk_id").alias("n_documents"))


def broken_ontology(spark: SparkSession) -> dict[str, DataFrame]:
    """One fault for each check of a present ontology."""
    p = lambda owner, name, kind="STRING", key=False, tag=None, **kw: ("bad", owner, name, kind, False, key, tag, None, kw.get("pattern"), None, kw.get("values"), None, None, None)
    return ontology.tables(
        spark,
        ontology=[("bad", "1"), ("empty", "1")],
        node_type=[("bad", n, None) for n in ("NoKey", "TwoKeys", "Odd")],
        relationship_type=[("bad", r) for r in ("NONE", "MANY", "OUT")],
        endpoint=[("bad", "MANY", e, n) for e in ("from", "to") for n in ("Odd", "TwoKeys")] + [("bad", "OUT", "from", "Elsewhere"), ("bad", "OUT", "to", "Odd")],
        property=[p("TwoKeys", "a", key=True), p("TwoKeys", "b", key=True), p("Odd", "k", "DATE", True), p("Odd", "t", tag="unheard_of"), p("Odd", "am", tag="alias_map"), p("Odd", "bl", tag="blocklist"), p("Odd", "rn", tag="regex_normalize", pattern="x"), p("Odd", "rs", tag="regex_skip"), p("Odd", "ev", tag="enum_validate", values=[]), p("Odd", "cn", tag="compose_name_from_fields")],
        dictionary=[("bad", "alias_map", "AM"), ("bad", "blocklist", "BL")],
    )
