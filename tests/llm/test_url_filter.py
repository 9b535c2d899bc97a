"""URL rules against a plain loop."""

import random

from millrace.llm import url_filter as uf


def slow(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path, cut = "", "", False
    for n, c in enumerate(rest):
        if c in "/?#":
            host, path = rest[:n], rest[n:]
            cut = True
            break
    if not cut:
        host = rest
    for stop in "?#":
        path = path.split(stop)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for i, (verdict, rule) in enumerate(rules):
        rhost, slash, rpath = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost) or rhost == "") and path.startswith(slash + rpath):
            best = max(best or (), (len(rhost), len(slash + rpath), i, rule, verdict))
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def urls():
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "com", "notexample.com", "x.net", "net", "example.com.", "example.com:80", "xn--a.net", "", "a..com", "b-c.com"]
    paths = ["", "/", "/en/", "/en", "/en/x?q=/fr/", "/fr/#a", "?a", "#/en/", "/es/a/b", "//en/", "/\n/x"]
    return [None, "", "example.com/en/", "http:/x", "a://b://c/en/", "http://é.com/en/"] + [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]


def run(spark, rows, rules, **args):
    df = spark.createDataFrame([(i, u, "x", 0) for i, u in rows], "page_id long, url string, rule string, h int").repartition(3)
    return sorted(map(tuple, uf.judge(df, rules, **args).collect()), key=str)


def test_registered_rules(spark):
    rows = list(enumerate(urls())) + [(None, "http://example.com/en/"), (3, "http://x.net/es/")]
    assert run(spark, rows, uf.RULES) == sorted(((i, *slow(u, uf.RULES, "allow")) for i, u in rows), key=str)


def test_many_nested_rules_in_chunks(spark):
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "net", "a.b.c.net", "c.net", "x.net"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(["", "/", "/en/", "/e", "/fr/", "/es/a"])) for _ in range(60)]
    rows = list(enumerate(urls()))
    want = sorted(((i, *slow(u, rules, "block")) for i, u in rows), key=str)
    assert run(spark, rows, rules, default="block") == want
    assert run(spark, rows, rules, default="block", chunk_rules=7) == want


def test_no_rules_and_no_rows(spark):
    assert run(spark, [(1, "http://a.com/")], []) == [(1, "a.com", "/", None, "allow")]
    assert spark.createDataFrame([], "page_id long, url string").transform(uf.judge).collect() == []


def test_long_urls(spark):
    long = "http://" + "a." * 50_000 + "Example.com/en/" + "x" * 500_000 + "?q"
    got = uf.judge(spark.createDataFrame([(1, long, "k", 2)], "page_id long, url string, key string, rule int")).first()
    assert got["host"].endswith("a.example.com") and len(got["path"]) == 500_004 and (got["rule"], got["verdict"]) == ("example.com/en/", "block")
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
