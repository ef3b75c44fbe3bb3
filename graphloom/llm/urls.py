"""URL filters by hashed expressions, with DataFrame functions only.

Each distinct url is expanded into host suffixes joined with path prefixes.  The expressions meet the rules in an
equi-join on a short hash prefix, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the SHA-256 that are joined on (4 bytes).
PREFIX = 8
#: A rule table of up to this many rows (about 150 bytes each) is broadcast; beyond it, it is joined by a shuffle.
RULES_BROADCAST = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row (columns of these names are replaced).

    ``rules``: (host, path, verdict).  A rule fits its host and all subdomains if the url's path starts with the rule's;
    the longest wins (of equal length the verdict and host that sort last).  No rule: ``rule`` is null and ``default`` holds.  Null urls, and urls without ://, have an empty host and path.
    Repeated rows are kept and judged alike.  An empty table gives no rows; without rules all rows get the default.
    """
    spell = F.concat("rule_host", "rule_path")
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("_verdict")).distinct()
    n, labels, lengths = known.agg(F.count("*"), F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    digest = F.sha2(spell.cast("binary"), 256)
    known = known.select(spell.alias("_rule"), "_verdict", digest.alias("_digest"), F.substring(digest, 1, PREFIX).alias("_prefix"))
    known = F.broadcast(known) if n <= RULES_BROADCAST else known

    key = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(key.alias("_url")).distinct()
    # The label counts and path lengths that rules have; their number is bounded by the forms of urls, not by the rules.
    parts = F.split(host(F.col("_url")), r"\.")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, sorted(labels))).cast("array<int>"), lambda m: m <= F.size("_parts")), lambda m: F.array_join(F.slice("_parts", F.size("_parts") - m + 1, m), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda k: k <= F.length("_path")), lambda k: F.substring("_path", F.lit(1), k))
    asked = urls.select("_url", parts.alias("_parts"), path(F.col("_url")).alias("_path"))
    asked = asked.select("_url", F.explode(suffixes).alias("_host"), prefixes.alias("_prefixes"))
    asked = asked.select("_url", "_host", F.explode("_prefixes").alias("_start"))
    asked = asked.select("_url", F.sha2(F.concat("_host", "_start").cast("binary"), 256).alias("_asked"))
    met = asked.withColumn("_prefix", F.substring("_asked", 1, PREFIX)).join(known, "_prefix").where("_asked = _digest")
    best = met.groupBy("_url").agg(F.max(F.struct(F.length("_rule").alias("n"), "_verdict", "_rule")).alias("_best"))
    out = pages.drop("host", "path", "rule", "verdict").withColumn("_url", key).join(best, "_url", "left")
    return out.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col)), "rule": F.col("_best._rule"), "verdict": F.coalesce("_best._verdict", F.lit(default))}).drop("_url", "_best")
