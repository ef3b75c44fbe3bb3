"""Value normalizers: Column to Column, JVM-side, null in and null out.

A normalizer either rewrites a value or skips it.  A skip drops the whole entity, so chains keep it apart from null: they
carry a value column and a skip flag.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and symbols of currencies, and their codes.
CURRENCIES = {
    "euro": "EUR", "euros": "EUR", "€": "EUR",
    "dollar": "USD", "dollars": "USD", "$": "USD",
    "pound": "GBP", "pounds": "GBP", "£": "GBP",
    "yuan": "CNY", "renminbi": "CNY", "yen": "JPY", "ruble": "RUB", "rubles": "RUB",
}
#: Scale words after an amount, as regular expressions, largest first.
# Scale words of amounts, first match wins, and the order in which date patterns are tried.
SCALES = [(r"\btrillion\b", 1e12), (r"\b(billion|bn)\b", 1e9), (r"\b(million|mn|mln|m)\b", 1e6), (r"\b(thousand|k)\b", 1e3)]
#: Date patterns in the order in which they are tried: day first before month first.
DATES = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/M/d"]


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; keeps the generated code of long chains small."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_the(c: Column) -> Column:
    return strip(F.regexp_replace(whitespace(c), r"^[Tt]he\s+", ""))


def strip_acronym_suffix(c: Column) -> Column:
    return strip(F.regexp_replace(whitespace(c), r"\s*\([A-Z][A-Z0-9\- ]{1,9}\)\s*$", ""))


def lowercase(c: Column) -> Column:
    return F.lower(whitespace(c))


def uppercase(c: Column) -> Column:
    return F.upper(whitespace(c))


def titlecase(c: Column) -> Column:
    """Capitalises after anything that is no letter, not only after spaces."""
    runs = F.regexp_extract_all(whitespace(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def email(c: Column) -> Column:
    low = lowercase(c)
    return F.when(low.contains("@"), low)


def url(c: Column) -> Column:
    """Lower-cases scheme and host, drops slashes at the end; the path keeps its case."""
    s = F.regexp_replace(whitespace(c), r"/+$", "")
    parts = [F.regexp_extract(s, r"(?i)^(https?://)([^/]+)(.*)$", k) for k in (1, 2, 3)]
    whole = F.concat(F.lower(parts[0]), F.lower(parts[1]), parts[2])
    return F.when(s == "", None).when(parts[0] != "", whole).otherwise(s)


def phone(c: Column) -> Column:
    s = whitespace(c)
    digits = F.regexp_replace(s, r"\D", "")
    return F.when(digits == "", None).when(s.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def percentage(c: Column) -> Column:
    """The number before %, not divided."""
    s = F.replace(strip(F.regexp_replace(strip(c), r"%+$", "")), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def integer(c: Column) -> Column:
    s = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("bigint"))


def date(c: Column) -> Column:
    """ISO-looking strings as they are; else the first pattern that fits; else a bare year; else null."""

    def body(s: Column) -> Column:
        tried = [F.try_to_timestamp(s, F.lit(p)).cast("date").cast("string") for p in DATES]
        return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).otherwise(F.coalesce(*tried, F.when(s.rlike(r"^\d{4}$"), s)))

    return let(whitespace(c), body)


def currency(c: Column) -> Column:
    s = strip(c)
    known = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))
    return F.when(s == "", None).otherwise(F.coalesce(F.try_element_at(known, F.lower(s)), F.upper(s)))


def monetary_amount(c: Column) -> Column:
    """The first number (the lower end of a range) times the scale word that follows; null unless positive."""
    s = F.regexp_replace(strip(c), r"[€$£¥]", "")
    s = strip(F.regexp_replace(s, r"(?i)\b(EUR|USD|GBP|JPY|CNY|RUB)\b", ""))
    s = F.regexp_replace(s, r"^([\d,.]+)\s*[-–]\s*[\d,.]+", "$1 ")

    def scaled(parts: Column) -> Column:
        tail = F.lower(parts["tail"])
        scale = reduce(lambda rest, x: F.when(tail.rlike(x[0]), F.lit(x[1])).otherwise(rest), reversed(SCALES), F.lit(1.0))
        return let(F.replace(parts["number"], F.lit(","), F.lit("")).try_cast("double") * scale, lambda v: F.when(v > 0, v))

    number = r"(?s)(\d[,\d]*\.?\d*)(.*)$"
    return let(let(s, lambda x: F.struct(F.regexp_extract(x, number, 1).alias("number"), F.regexp_extract(x, number, 2).alias("tail"))), scaled)


def alias_map(aliases: dict[str, str]) -> Callable[[Column], Column]:
    def apply(c: Column) -> Column:
        s = whitespace(c)
        if not aliases:
            return s
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), s), s)

    return apply


def regex_normalize(pattern: str, replacement: str) -> Callable[[Column], Column]:
    """A replacement's \\1 is Java's $1."""
    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    return lambda c: F.regexp_replace(c, pattern, java)


REGISTRY: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (whitespace, strip_the, strip_acronym_suffix, lowercase, uppercase, titlecase, email, url, phone, percentage, integer, date, currency, monetary_amount)
}

#: (value, whether it is skipped)
Step = Callable[[Column, Column], tuple[Column, Column]]


def _skips(test: Callable[[Column], Column], tidy: Callable[[Column], Column]) -> Step:
    return lambda c, skip: (tidy(c), skip | F.coalesce(test(tidy(c)), F.lit(False)))


def step(tag: str, config: dict | None = None) -> Step:
    """A normalizer as a step of a chain; ``config`` has its aliases, terms, pattern, replacement or values."""
    config = config or {}
    if tag in REGISTRY:
        return lambda c, skip: (REGISTRY[tag](c), skip)
    if tag == "alias_map":
        return lambda c, skip: (alias_map(config.get("aliases") or {})(c), skip)
    if tag == "regex_normalize":
        return lambda c, skip: (regex_normalize(config["pattern"], config["replacement"])(c), skip)
    if tag == "blocklist":
        return _skips(lambda s: s.isin(*(config.get("terms") or [""])) if config.get("terms") else F.lit(False), whitespace)
    if tag == "regex_skip":
        return _skips(lambda s: s.rlike(config["pattern"]), lambda c: c)
    if tag == "enum_validate":
        return _skips(lambda s: ~s.isin(*config["values"]), whitespace)
    if tag == "compose_name_from_fields":
        return lambda c, skip: (c, skip)  # see compose_name; it needs the other fields
    raise ValueError(f"unknown normalizer: {tag}")


def chain(c: Column, steps: list[tuple[str, dict | None]]) -> tuple[Column, Column]:
    """Applies normalizers from left to right: (value, skipped)."""
    return reduce(lambda now, s: step(*s)(*now), steps, (c, F.lit(False)))


def number_text(c: Column) -> Column:
    """A double as 15000000.0 and not as 1.5E7."""
    return let(c, lambda x: F.when(x == F.floor(x), F.format_string("%.1f", x)).otherwise(x.cast("string")))


def compose_name(key: Column, template: str, fields: dict[str, Column]) -> Column:
    """Where the key is empty and any field of the template is not, the filled template; else the key."""
    parts, used = [], []
    for plain, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if plain:
            parts.append(F.lit(plain))
        if name:
            text = F.coalesce(fields.get(name, F.lit(None)).cast("string"), F.lit(""))
            parts.append(text)
            used.append(text != "")
    empty = key.isNull() | (key == "")
    return F.when(empty & reduce(lambda a, b: a | b, used, F.lit(False)), strip(F.concat(*parts))).otherwise(key)
