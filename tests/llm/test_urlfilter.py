from scholium.llm import urlfilter

PAGES = "page_id long, url string, html string, host string, verdict int"


def test_rules_and_cascade(spark):
    urls = [
        "https://a.example.org/es/1", "https://example.org/en/12?x", "https://EXAMPLE.org/fr/", "http://x.com/fr/1", "http://x.com/de/1#t", "http://x.com", "http://m.adult-x.example.com/en/1",
        "https://free-bets.example.net?x=/fr/", "nothing", None, "", "ftp://h", "http://notorg/", "http://b.net/org/", "://", "http://spam-farm.example.org/x",
    ]
    pages = spark.createDataFrame([(i, u, "h", "host", 3) for i, u in enumerate(urls)] + [(0, urls[0], "h", "", 1)], PAGES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(pages).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/fr/", "org/", "allow"), ("x.com", "/fr/1", "com/fr/", "allow"),
        ("x.com", "/de/1", "com/de/", "block"), ("x.com", "", None, "allow"), ("m.adult-x.example.com", "/en/1", None, "block"), ("free-bets.example.net", "", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("h", "", None, "allow"), ("notorg", "/", None, "allow"), ("b.net", "/org/", None, "allow"), ("", "", None, "allow"), ("spam-farm.example.org", "/x", "org/", "allow"),
    ]
    assert urlfilter.url_filter(pages).count() == len(urls) + 1
    assert urlfilter.url_filter(pages.limit(0)).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(4000).selectExpr("concat('k', id, '.net') as key", "id % 7 = 0 as listed")
    cascade = urlfilter.build_cascade(keys)
    assert len(cascade.levels) > 2
    assert keys.select("listed", cascade.member(keys.key).alias("m")).where("listed <> m").count() == 0
    for only in ("listed", "not listed"):
        part = keys.where(only)
        one = urlfilter.build_cascade(part)
        assert part.select("listed", one.member(part.key).alias("m")).where("listed <> m").count() == 0


def test_a_cascade_of_several_tables(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "TABLE", 4)
    keys = spark.range(4000).selectExpr("concat('k', id, '.net') as key", "id % 7 = 0 as listed")
    cascade = urlfilter.build_cascade(keys)
    assert max(len(level.tables) for level in cascade.levels) >= 10
    assert keys.select("listed", cascade.member(keys.key).alias("m")).where("listed <> m").count() == 0


def test_a_table_of_listed_hosts_long_urls_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://M.Bad.example/x", "", "", 1), (2, "http://fine.example/" + "p" * 100_000, "", "", 1), (3, None, "", "", 1), (4, "http://bad.example.org/a", "", "", 1)], PAGES)
    listed = spark.createDataFrame([(" Bad.Example ", 1), ("bad.example", 2), (None, 3), ("", 4)], "host string, verdict int")
    rows = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_filter(pages, listed, rules=[("block", "org", "/a"), ("allow", "org", "/a")]).collect()}
    assert rows == {1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/a", "block")}
    assert {r.verdict for r in urlfilter.url_filter(pages, listed.limit(0), rules=()).collect()} == {"allow"}


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "", "", 1)], PAGES)
    plan = urlfilter.url_filter(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
