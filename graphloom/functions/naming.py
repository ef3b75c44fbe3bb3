"""Names and prompts that follow from an ontology; schema-sized, on the driver."""

from __future__ import annotations

import re

from ..operators.ontology import Schema


def snake(name: str) -> str:
    return re.sub(r"[\W_]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)).strip("_").lower()


def pascal(name: str) -> str:
    return "".join(part.capitalize() for part in snake(name).split("_"))


def plural(name: str) -> str:
    if re.search(r"(s|x|z|ch|sh)$", name):
        return name + "es"
    return name[:-1] + "ies" if re.search(r"[^aeiou]y$", name) else name + "s"


def endpoint_fields(source: str, target: str, source_key: str, target_key: str) -> tuple[str, str]:
    """Names of a relationship's key fields; a loop tells its ends apart."""
    a, b = f"{snake(source)}_{source_key}", f"{snake(target)}_{target_key}"
    return (f"source_{a}", f"target_{b}") if source == target else (a, b)


def prompt(schema: Schema) -> str:
    """What an extractor is told: types with their properties (the key marked), then relationships."""
    lines = ["Node types:"]
    for label, fields in schema.nodes.items():
        lines.append(f"- {label}: " + ", ".join(f"{f.name} {f.type.lower()}{' (key)' if f.is_key else ''}" for f in fields))
    lines.append("Relationships:")
    for name, (a, b) in schema.relationships.items():
        props = ", ".join(f.name for f in schema.edge_fields[name])
        lines.append(f"- {a} {name} {b}" + (f": {props}" if props else ""))
    return "\n".join(lines)
