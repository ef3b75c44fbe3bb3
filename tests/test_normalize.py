import pytest
from pyspark.sql import functions as F

from graphloom.functions import normalize as N
from graphloom.functions import text as X

GOLDEN = [
    ("whitespace", "  My \t Contract  ", "My Contract"), ("whitespace", None, None), ("strip_the", "The  European Commission", "European Commission"),
    ("strip_acronym_suffix", "Foo Bar (FB)", "Foo Bar"), ("titlecase", "o'neil mc-donald abc3def", "O'Neil Mc-Donald Abc3Def"),
    ("email", " A@B.Com ", "a@b.com"), ("email", "nope", None), ("phone", "+1 (555) 010-9999", "+15550109999"), ("phone", "n/a", None),
    ("url", "HTTPS://Ex.COM/Path/", "https://ex.com/Path"), ("url", "ftp://X/", "ftp://X"), ("percentage", "15%", 15.0), ("percentage", "1,250.5", 1250.5), ("percentage", "x", None),
    ("integer", "1,234", 1234), ("integer", "12a", None), ("integer", "-7", -7), ("date", "March 15, 2025", "2025-03-15"), ("date", "03/04/2024", "2024-04-03"),
    ("date", "04/13/2024", "2024-04-13"), ("date", "2024-13-45", "2024-13-45"), ("date", "2024", "2024"), ("date", "May 2024", None), ("date", "15 March 2025", "2025-03-15"),
    ("currency", "€", "EUR"), ("currency", "chf", "CHF"), ("currency", " ", None), ("monetary_amount", "€1.5 billion", 1500000000.0), ("monetary_amount", "23-30 million EUR", 23000000.0),
    ("monetary_amount", "$1,300,000", 1300000.0), ("monetary_amount", "-5", 5.0), ("monetary_amount", "free", None), ("monetary_amount", "$500K", 500000.0), ("monetary_amount", "0", None),
    ("lowercase", " A  B", "a b"), ("uppercase", "a b", "A B"),
]


def test_golden_vectors(spark):
    row = spark.createDataFrame([(1, *(v for _, v, _ in GOLDEN))], "i int, " + ", ".join(f"c{k} string" for k in range(len(GOLDEN))))
    got = {}
    for a in range(0, len(GOLDEN), 8):
        part = row.select(*(N.REGISTRY[n](F.col(f"c{k}")).alias(str(k)) for k, (n, _, _) in enumerate(GOLDEN) if a <= k < a + 8)).first()
        got |= part.asDict()
    assert {k: (n, v, got[str(k)]) for k, (n, v, _) in enumerate(GOLDEN)} == dict(enumerate(GOLDEN))


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_parameterised_and_chains(spark):
    v = F.lit
    chain = lambda x, *steps: N.chain(v(x), list(steps))
    assert one(spark, *chain(" NY ", ("alias_map", {"aliases": {"NY": "New York"}}))) == ("New York", False)
    assert one(spark, *chain("the parties", ("blocklist", {"terms": ["the parties"]}))) == ("the parties", True)
    assert one(spark, *chain("Acme", ("blocklist", {"terms": []}))) == ("Acme", False)
    assert one(spark, *chain("2024-CV-001", ("regex_normalize", {"pattern": r"[_\-\s]+", "replacement": "."}))) == ("2024.CV.001", False)
    assert one(spark, *chain("ab", ("regex_normalize", {"pattern": "(a)(b)", "replacement": r"\2\1"}))) == ("ba", False)
    assert one(spark, *chain("draft 1", ("regex_skip", {"pattern": "^draft"}))) == ("draft 1", True)
    assert one(spark, *chain("weird", ("enum_validate", {"values": ["a"]}))) == ("weird", True)
    assert one(spark, *chain("The  X", ("strip_the", None), ("uppercase", None))) == ("X", False)
    with pytest.raises(ValueError):
        N.step("unheard_of")


def test_compose_name(spark):
    fields = {"currency": N.currency(F.lit("dollar")), "amount": N.number_text(N.monetary_amount(F.lit("$500K")))}
    template = "{currency} {amount} penalty"
    assert one(spark, N.compose_name(F.lit(None).cast("string"), template, fields), N.compose_name(F.lit("Custom"), template, fields)) == ("USD 500000.0 penalty", "Custom")
    nothing = {k: F.lit(None).cast("string") for k in fields}
    assert one(spark, N.compose_name(F.lit(""), template, nothing)) == ("",)


def test_text_functions(spark):
    assert one(spark, X.strip_images(F.lit("a ![x](data:image/png;base64,AA) b")), X.placeholders(F.lit("[IMAGE: i_1] [TABLE: t]")), X.suffix_number(F.lit("d_sec_12"), "_sec_")) == ("a  b", ["i_1", "t"], 12)
    assert one(spark, X.embedding_text(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), X.clean_key(F.lit("a-b c")), X.clamp_level(F.lit(9))) == ("a  b", "a_b_c", 6)
    assert one(spark, X.is_read_only(F.lit("match n set x")), X.is_read_only(F.lit("offset")), X.settings(F.lit("A=1 B=x=y"))) == (False, True, {"A": "1", "B": "x=y"})
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), X.cosine(F.array(F.lit(3.0)), F.array(F.lit(2.0)))) == (None, 1.0)
