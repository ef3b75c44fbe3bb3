from graphloom.llm import queries, urls

CASES = [
    (1, "http://www.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://m.example.com/en/25#top", "m.example.com", "/en/25", "example.com/en/", "block"),
    (3, "https://example.com/de/", "example.com", "/de/", "com/", "allow"),
    (4, "x://a.net/fr/1://b.com/", "a.net", "/fr/1://b.com/", "net/fr/", "block"),
    (5, "http://a.net?x=/es/", "a.net", "", None, "allow"),
    (6, None, "", "", None, "allow"),
    (7, "example.com/en/", "", "", None, "allow"),
    (8, "http://com", "com", "", None, "allow"),
    (9, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (10, "http://", "", "", None, "allow"),
    (11, "http://É.COM/a\nb", "É.com", "/a\nb", "com/", "allow"),
    (11, "http://É.COM/a\nb", "É.com", "/a\nb", "com/", "allow"),
    (None, "http://" + "a." * 3000 + "net/es/" + "z" * 5000, "a." * 3000 + "net", "/es/" + "z" * 5000, "net/es/", "block"),
]


def test_cases(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in CASES], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = urls.judged(pages, rules).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, CASES))
    assert urls.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(urls, "RULES_BROADCAST", 0)
    test_cases(spark)
