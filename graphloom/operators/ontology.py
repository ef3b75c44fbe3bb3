"""Ontologies as tables: loading, building, deleting, validating, compiling to normalizer chains."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N

TABLES = {
    "ontology": "name string, version string",
    "node_type": "ontology string, name string, description string",
    "relationship_type": "ontology string, name string",
    "endpoint": "ontology string, relationship string, end string, node_type string",
    "property": "ontology string, owner string, name string, type string, required boolean, is_key boolean, normalizer string, normalizers array<string>, regex_pattern string, regex_replacement string, enum_values array<string>, name_template string, alias_map string, blocklist string",
    "alias": "ontology string, alias_map string, alias string, canonical string",
    "blocked": "ontology string, blocklist string, term string",
    "dictionary": "ontology string, kind string, name string",
}
TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN")
CASTS = {"STRING": "string", "INTEGER": "bigint", "FLOAT": "double", "BOOLEAN": "boolean"}
PARAMETERISED = ("alias_map", "blocklist", "regex_normalize", "regex_skip", "enum_validate", "compose_name_from_fields")
NORMALIZERS = (*N.REGISTRY, *PARAMETERISED)


def tables(spark: SparkSession, **rows: list) -> dict[str, DataFrame]:
    """The ontology tables from literal rows; tables not given are empty."""
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}


def legal_sample(spark: SparkSession, name: str = "legal_demo") -> dict[str, DataFrame]:
    """A small ontology of parties, contracts and penalties."""

    def prop(owner, prop_name, kind="STRING", key=False, normalizer=None, pattern=None, replacement=None, values=None, template=None, aliases=None, blocked=None):
        return (name, owner, prop_name, kind, key, key, normalizer, None, pattern, replacement, values, template, aliases, blocked)

    return tables(
        spark,
        ontology=[(name, "1")],
        node_type=[(name, n, None) for n in ("Party", "Contract", "Penalty")],
        relationship_type=[(name, "PARTY_TO"), (name, "RESULTS_IN")],
        endpoint=[(name, "PARTY_TO", "from", "Party"), (name, "PARTY_TO", "to", "Contract"), (name, "RESULTS_IN", "from", "Contract"), (name, "RESULTS_IN", "to", "Penalty")],
        property=[
            prop("Party", "name", key=True, normalizer="blocklist", blocked="NOT_A_PARTY"),
            prop("Contract", "title", key=True, normalizer="whitespace"),
            prop("Contract", "jurisdiction", normalizer="alias_map", aliases="JURISDICTION_ALIASES"),
            prop("Contract", "signedDate", normalizer="date"),
            prop("Contract", "amount", "FLOAT", normalizer="monetary_amount"),
            prop("Contract", "caseNumber", normalizer="regex_normalize", pattern=r"[_\-\s]+", replacement="."),
            prop("Contract", "contractType", normalizer="enum_validate", values=["service", "supply", "employment", "licensing", "settlement"]),
            prop("Penalty", "name", key=True, normalizer="compose_name_from_fields", template="{currency} {amount} penalty"),
            prop("Penalty", "amount", "FLOAT", normalizer="monetary_amount"),
            prop("Penalty", "currency", normalizer="currency"),
            prop("PARTY_TO", "role", normalizer="lowercase"),
        ],
        alias=[(name, "JURISDICTION_ALIASES", a, c) for a, c in (("NY", "New York"), ("N.Y.", "New York"), ("CA", "California"), ("Cal.", "California"), ("DE", "Delaware"), ("Del.", "Delaware"))],
        blocked=[(name, "NOT_A_PARTY", t) for t in ("the parties", "all parties", "third parties", "anyone")],
        dictionary=[(name, "alias_map", "JURISDICTION_ALIASES"), (name, "blocklist", "NOT_A_PARTY")],
    )


def upserted(now: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds rows; rows of the same key (all name columns) replace the old."""
    keys = {"ontology": ["name"], "node_type": ["ontology", "name"], "relationship_type": ["ontology", "name"], "endpoint": ["ontology", "relationship", "end", "node_type"], "property": ["ontology", "owner", "name"], "alias": ["ontology", "alias_map", "alias"], "blocked": ["ontology", "blocklist", "term"], "dictionary": ["ontology", "kind", "name"]}
    return {n: t.join(new[n].select(*keys[n]), keys[n], "left_anti").unionByName(new[n]) for n, t in now.items()}


def deleted(now: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Removes an ontology and all it owns."""
    return {n: t.where(F.col("name" if n == "ontology" else "ontology") != name) for n, t in now.items()}


def tags(properties: DataFrame) -> DataFrame:
    """Adds tags: the list of normalizers, which wins over the single one."""
    single = F.when(F.col("normalizer").isNotNull(), F.array("normalizer")).otherwise(F.array().cast("array<string>"))
    return properties.withColumn("tags", F.coalesce("normalizers", single))


def validated(t: dict[str, DataFrame], *names: str, strict: bool = False) -> DataFrame:
    """(ontology, check, severity, entity, message): nineteen checks of the ontologies named, or of all; none found means
    that they are sound.  All are checked together: what the checks join and count carries the ontology's name.

    ``strict`` does not accept the ``currency`` normalizer.
    """
    own = lambda n: F.col("name" if n == "ontology" else "ontology")
    mine = {n: x.where(own(n).isin(*names)) if names else x for n, x in t.items()}
    nodes, relations, ends = mine["node_type"], mine["relationship_type"], mine["endpoint"]
    owners = nodes.select("ontology", "name").unionByName(relations.select("ontology", "name")).withColumnRenamed("name", "owner")
    props = tags(mine["property"]).join(owners, ["ontology", "owner"], "left_semi")
    spelled = F.concat_ws(".", "owner", "name")
    uses = lambda tag: F.array_contains("tags", tag)
    rel = relations.select("ontology", F.col("name").alias("relationship"))
    known = [x for x in NORMALIZERS if not (strict and x == "currency")]

    def row(found: DataFrame, check: str, entity: Column, message: str, severity: str = "error") -> DataFrame:
        return found.select("ontology", F.lit(check).alias("check"), F.lit(severity).alias("severity"), entity.alias("entity"), F.concat(entity, F.lit(f": {message}")).alias("message"))

    # One pass over each kind of thing; the faults of a row are listed and taken apart.
    def faults(rows: DataFrame, entity: Column, *tests: tuple[Column, str, str]) -> DataFrame:
        found = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(message).alias("message"))) for test, check, message in tests))
        rows = rows.select("ontology", entity.alias("entity"), F.explode(F.array_compact(found)).alias("f"))
        return rows.select("ontology", "f.check", F.lit("error").alias("severity"), "entity", F.concat("entity", F.lit(": "), "f.message").alias("message"))

    keys = props.where("is_key").groupBy("ontology", "owner").agg(F.count("*").alias("n"))
    keyed = nodes.select("ontology", F.col("name").alias("owner")).join(keys, ["ontology", "owner"], "left")
    counts = ends.groupBy("ontology", "relationship").agg(F.count_if(F.col("end") == "from").alias("n_from"), F.count_if(F.col("end") == "to").alias("n_to"))
    counts = rel.join(counts, ["ontology", "relationship"], "left").na.fill(0, ["n_from", "n_to"])
    outside = ends.join(rel, ["ontology", "relationship"], "left_semi").join(nodes.select("ontology", F.col("name").alias("node_type")), ["ontology", "node_type"], "left_anti")
    unknown = props.withColumn("tag", F.explode("tags")).where(~F.col("tag").isin(*known))
    kind = lambda name, terms, key: mine["dictionary"].where(F.col("kind") == name).join(terms.select("ontology", F.col(key).alias("name")), ["ontology", "name"], "left_anti")
    named = mine["ontology"].select(F.col("name").alias("ontology"))
    asked = t["ontology"].sparkSession.createDataFrame([(n,) for n in names], "ontology string")
    checks = [
        faults(keyed, F.col("owner"), (F.col("n").isNull(), "missing_key_property", "no key property"), (F.col("n") > 1, "multiple_key_properties", "more than one key property")),
        faults(counts, F.col("relationship"), (F.col("n_from") == 0, "missing_from_endpoint", "no source type"), (F.col("n_to") == 0, "missing_to_endpoint", "no target type"),
               (F.col("n_from") > 1, "multiple_from_endpoints", "more than one source type"), (F.col("n_to") > 1, "multiple_to_endpoints", "more than one target type")),
        row(outside, "endpoint_outside_ontology", F.col("relationship"), "an endpoint is not a type of this ontology"),
        faults(props, spelled,
               (F.col("type").isNull() | ~F.col("type").isin(*TYPES), "invalid_property_type", "unknown type"),
               (uses("alias_map") & F.col("alias_map").isNull(), "alias_map_missing_link", "uses no alias map"),
               (uses("blocklist") & F.col("blocklist").isNull(), "blocklist_missing_link", "uses no blocklist"),
               (uses("regex_normalize") & (F.col("regex_pattern").isNull() | F.col("regex_replacement").isNull()), "regex_normalize_missing_config", "no pattern or replacement"),
               (uses("regex_skip") & F.col("regex_pattern").isNull(), "regex_skip_missing_config", "no pattern"),
               (uses("enum_validate") & (F.coalesce(F.size("enum_values"), F.lit(0)) <= 0), "enum_validate_missing_values", "no values"),
               (uses("compose_name_from_fields") & F.col("name_template").isNull(), "compose_name_missing_template", "no template")),
        row(unknown, "invalid_normalizer_tag", spelled, "unknown normalizer"),
        row(kind("alias_map", mine["alias"], "alias_map"), "alias_map_empty", F.col("name"), "has no aliases", "warning"),
        row(kind("blocklist", mine["blocked"], "blocklist"), "blocklist_empty", F.col("name"), "has no terms", "warning"),
        row(named.join(nodes.select("ontology"), "ontology", "left_anti"), "ontology_no_node_types", F.col("ontology"), "has no node types", "warning"),
        row(asked.join(named, "ontology", "left_anti"), "ontology_not_found", F.col("ontology"), "no such ontology"),
    ]
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    is_key: bool
    steps: list[tuple[str, dict]]
    template: str | None


@dataclass(frozen=True)
class Schema:
    """An ontology ready for extraction: fields of each node and relationship type, and the relationships' ends."""

    nodes: dict[str, list[Field]]
    relationships: dict[str, tuple[str, str]]
    edge_fields: dict[str, list[Field]]

    def key(self, label: str) -> Field:
        return next(f for f in self.nodes[label] if f.is_key)


def loaded(t: dict[str, DataFrame], name: str) -> Schema:
    """Reads one ontology (a schema's few rows) to the driver; raises if it is absent or a node type has no key."""
    if t["ontology"].where(F.col("name") == name).isEmpty():
        raise LookupError(f"no ontology {name!r}")
    rows = {n: [r.asDict() for r in (tags(x) if n == "property" else x).where(F.col("ontology") == name).collect()] for n, x in t.items() if n != "ontology"}

    def field(p: dict) -> Field:
        config = {
            "aliases": {a["alias"]: a["canonical"] for a in rows["alias"] if a["alias_map"] == p["alias_map"]},
            "terms": [b["term"] for b in rows["blocked"] if b["blocklist"] == p["blocklist"]],
            "pattern": p["regex_pattern"], "replacement": p["regex_replacement"], "values": p["enum_values"],
        }
        return Field(p["name"], p["type"], bool(p["is_key"]), [(tag, config) for tag in p["tags"]], p["name_template"])

    of = lambda owner: [field(p) for p in rows["property"] if p["owner"] == owner]
    nodes = {n["name"]: of(n["name"]) for n in rows["node_type"]}
    for label, fields in nodes.items():
        if not any(f.is_key for f in fields):
            raise ValueError(f"node type {label!r} has no key property")
    ends = {(e["relationship"], e["end"]): e["node_type"] for e in rows["endpoint"]}
    relations = {r["name"]: (ends[r["name"], "from"], ends[r["name"], "to"]) for r in rows["relationship_type"]}
    return Schema(nodes, relations, {r: of(r) for r in relations})


def normalized(props: Column, fields: list[Field]) -> tuple[dict[str, Column], Column]:
    """Typed property columns from map<string, string>, and whether the whole is skipped."""
    out, skip = {}, F.lit(False)
    for f in fields:
        value, gone = N.chain(F.try_element_at(props, F.lit(f.name)), f.steps)
        out[f.name], skip = value.try_cast(CASTS.get(f.type, "string")), skip | gone
    for f in fields:
        if f.template and any(tag == "compose_name_from_fields" for tag, _ in f.steps):
            text = {n: N.number_text(c) if next(x.type for x in fields if x.name == n) == "FLOAT" else c for n, c in out.items()}
            out[f.name] = N.compose_name(out[f.name], f.template, text)
    return out, skip
