import random

from rostra.llm import url_rules as U

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), v, h + p) for h, p, v in rules if host and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, key string")
    got = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    assert {r.page_id: tuple(r)[3:] for r in got.collect()} == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_contract_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://?x", "HTTP://A.Example.COM/en/7x?y#z", "http://example.com/en/6", "http://xexample.com/en/7", "http://b.example.net/de/8/9", "http://q.net/de/8", "http://q.net/fr", "a://b://c.org/es/1", "http://ü.org/es/#", "http://com/en/", "http://x.com/en/\nq", "http://x.com#/en/"]
    check(spark, urls + urls, RULES)


def test_nested_and_hot(spark):
    rng = random.Random(1)
    hosts = ["a.b.c.d", "b.c.d", "c.d", "d", "x.d", "hot.d"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in [*hosts, ""] for p in ["", "/", "/a", "/a/b", "/a/b/c", "/b", "/a\x01"] if rng.random() < 0.6}.values())
    urls = [f"http://{rng.choice([*hosts, 'z.' + rng.choice(hosts), 'e.f'])}{rng.choice(['', '/', '/a', '/a/', '/a/b/c/d', '/ab', '/b/b', '/c', '/a' + 'b' * 400])}" for _ in range(500)]
    check(spark, urls + ["http://hot.d/a/b"] * 300 + [f"http://h{k}.hot.d/a/b" for k in range(300)], rules)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
    check(spark, ["http://a.b/c", None], [])
