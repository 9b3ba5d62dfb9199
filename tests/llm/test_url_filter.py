from recallforge.llm import queries, url_filter

PAGES = "page_id bigint, url string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    "http://a.example.org/en/12", "http://example.org/es/x?q#f", "https://EXAMPLE.org/en/2", "http://org/", "http://org", "http://notexample.org/es/", "http://x.com/de/1", "http://x.com/fr/#t",
    "http://x.com?/de/", "mailto:a@b", "no scheme", "", None, "://com/de/", "http://a://b.org/c", "ftp://x.org/en/1\n2", "http://com/de", "http://x.net/", "http://.org/", "http://ÄB.com/fr/é",
]


def test_rules_equal_a_loop(spark):
    rules = [*queries.URL_RULES, ("block", "b.org", "/c"), ("allow", "net", "/")]
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], PAGES)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, rules)).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *plain(u, rules))) for i, u in [*enumerate(URLS), (0, URLS[0])])


def test_precedence_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/cd")], PAGES)
    rules = url_filter.rules_table(spark, [("allow", "b", "/cd"), ("block", "b", "/cd"), ("allow", "a.b", "/"), (None, "b", "/"), ("block", None, "/c")])
    assert url_filter.judge_urls(pages, rules).first().verdict == "allow"  # the longest is a.b/ (4), as long as b/cd; its host is longer
    none = url_filter.rules_table(spark, [])
    assert tuple(url_filter.judge_urls(pages, none, "block").first()) == (1, "a.b", "/cd", None, "block")
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES), rules).count() == 0


def test_extra_columns_and_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/", "a", "b", "c")], PAGES + ", host string, digest string, rule string")
    df = url_filter.judge_urls(pages, url_filter.rules_table(spark, queries.URL_RULES))
    assert df.first().rule == "com/de/"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_long_addresses(spark):
    urls = ["http://" + "a." * 100_000 + "example.org/en/1" + "x" * 200_000, "http://" + "." * 50_000, "http://com/de/" + "/" * 300_000, "x" * 500_000]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, queries.URL_RULES)).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [(x[2], x[3]) for x in (plain(u, queries.URL_RULES) for u in urls)]
