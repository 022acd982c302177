from fadewatch.llm import url_filter
from fadewatch.llm.queries import URL_RULES


def judged(spark, urls, **extra):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    return {r.page_id: r for r in url_filter.judge(df, URL_RULES, **extra).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/2?x#y", "https://a.www.example.com/en/", "http://example.com", "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/",
            None, "no scheme", "", "a://h?q=/en/", "a://b://c/d", "http://É.Com/a"]
    r = judged(spark, urls)
    assert [(r[i].host, r[i].path, r[i].rule, r[i].verdict) for i in range(len(urls))] == [
        ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "", None, "allow"), ("x.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("notexample.com", "/en/", "com/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("É.com", "/a", "com/", "allow"),
    ]


def test_terms_need_borders_and_weights_add_up(spark):
    r = judged(spark, ["http://a.org/casino", "http://a.org/casino/win", "http://a.org/casinos/winner", "http://casino.org/casino", "http://Porn.org/", "http://a.org/pornx", "http://a.org/free-bets"])
    assert [r[i].verdict for i in range(7)] == ["allow", "block", "allow", "allow", "block", "allow", "block"]
    assert list(r[6].hit_terms) == ["bets", "free"] and r[4].hit_weight == 2


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.org/")] * 2, "page_id long, url string")
    assert url_filter.judge(df, URL_RULES).count() == 2
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
