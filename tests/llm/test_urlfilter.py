from millrace.llm import queries, urlfilter
from tests.llm.conftest import bag


def plain(url, rules=urlfilter.RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


URLS = [
    None, "", "nothing", "http://", "http://COM/", "http://com", "http://www.Example.com/en/x?y#z", "http://example.com/en", "http://a.b.example.com/en/",
    "https://x.net/es/1", "https://x.net/fr/", "https://xnet/fr/", "https://x.net?/fr/", "ftp://x.net#a/fr/", "a://b.com/c://d.net/es/", "http://..com//", "http://Ü.com/é/",
]


def test_each_url_as_by_hand(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = bag(urlfilter.judge(pages))
    assert got == sorted([(i, *plain(u)) for i, u, *_ in rows], key=str)


def test_other_rules(spark):
    rules = [("b.com", "/ab", "block"), ("b.com", "/abc/", "allow"), ("com", "", "block"), ("b.com", "/ab", "allow")]
    urls = ["http://b.com/abz", "http://b.com/abc/d", "http://x.b.com/ab", "http://b.com/a", "http://com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted([(i, *plain(u, rules[1:])) for i, u in enumerate(urls)], key=str)
    assert bag(urlfilter.judge(pages, rules)) == want


def test_whole_table_and_empty(spark, sf_dir):
    pages = {p.page_id: p.url for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert bag(queries.op6_url_filter(spark, sf_dir)) == sorted([(i, *plain(u)) for i, u in pages.items()], key=str)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op6_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_long_urls_are_expanded_no_further_than_rules_reach(spark):
    urls = ["http://" + "l." * 20_000 + "net/es/" + "s/" * 20_000, "http://example.com/en/" + "x" * 300_000, "http://" + "a" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert bag(urlfilter.judge(pages)) == sorted([(i, *plain(u)) for i, u in enumerate(urls)], key=str)
