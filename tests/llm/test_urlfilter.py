"""The URL filter's listing does not come from the pages it judges."""

from quillon.llm import urlfilter


def test_listed_hosts(spark):
    urls = ["http://bad.org/p/?q", "http://bad.org", "HTTPS://BAD.ORG/x", "http://www.bad.org/", "http://good.org/bad.org", "http://u.org/x", None, "http://bad.org.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    listed, hosts = spark.createDataFrame([("u.org/x",)], "url string"), spark.createDataFrame([("bad.org",), (None,)], "host string")
    got = {r.page_id: (r.verdict, r.listed) for r in urlfilter.filter_urls(pages, rules, listed, hosts=hosts).collect()}
    assert {i for i, x in got.items() if x == ("block", True)} == {0, 1, 2, 3, 5}
    assert got[4] == got[6] == ("allow", False) and got[7] == ("block", False)


def test_query_reads_its_list_not_the_pages(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(urlfilter, "filter_urls", lambda pages, rules, listed, **more: seen.update(more, listed=listed))
    urlfilter.op2_url_filter(spark, "/root/testdata/sf0.001")
    assert seen["listed"].count() == urlfilter.LISTED_URLS and [r.host for r in seen["hosts"].collect()] == urlfilter.LISTED_HOSTS


def test_near_misses_long_urls_and_clashing_columns(spark):
    """Listed URLs with ports, dots and slashes; near misses; a URL of many labels; a repeated id; columns named like ours."""
    urls = ["http://list-3.example.org:80/page/3/", "http://list-3.example.org./page/3", "http://list-3.example.org/page/33", "http://list-4.example.org/page/3", "http://" + "a." * 20_000 + "example.com/en/", "http://xspam-farm.example.org/", "http://list-3.example.org:8080/page/3"]
    pages = spark.createDataFrame([(1 if i == 2 else i, u, "h", "k", True) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, listed boolean")
    rules = spark.createDataFrame([("example.com/en/", "block"), ("example.com/en/", "allow"), (None, "block")], "rule string, verdict string")
    listed = spark.createDataFrame([("list-3.example.org/page/3",), ("list-3.example.org/page/3",), (None,)], "url string")
    hosts = spark.createDataFrame([("spam-farm.example.org",)], "host string")
    got = [(r.page_id, r.rule, r.verdict, r.listed) for r in urlfilter.filter_urls(pages, rules, listed, hosts=hosts).collect()]
    want = [(0, None, "block", True), (1, None, "block", True), (1, None, "allow", False), (3, None, "allow", False), (4, "example.com/en/", "allow", False), (5, None, "allow", False), (6, None, "allow", False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ties_of_rules(spark):
    """Of equally long rules the one with the longer host wins, whatever the order of the rules."""
    pages = spark.createDataFrame([(1, "http://x.y/ab"), (1, "http://x.y/ab"), (None, "http://x.y/ac"), (2, "http://q.x.y/b/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    rules = [("x.y/", "block"), ("y/ab", "allow"), ("y/ac", "block"), ("y/b/", "allow"), ("x.y/b/", "allow"), ("x.y/b/", "block")]
    for order in (rules, rules[::-1]):
        got = urlfilter.filter_urls(pages, spark.createDataFrame(order, "rule string, verdict string"), none).collect()
        assert sorted(((r.page_id, r.rule, r.verdict) for r in got), key=str) == sorted([(1, "x.y/", "block"), (1, "x.y/", "block"), (None, "x.y/", "block"), (2, "x.y/b/", "allow")], key=str)
