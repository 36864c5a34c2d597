import random

from textloom.llm import url_filter as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "a.net", "Example.NET", "www.example.net", "xexample.net", "example.com", "deep." * 40 + "org", "org", "",
             "a..org", "b.c.d.example.com"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/english", "/de/a/b/c", "//", "/fr/", "/a/b/c/d/" * 30, "/en/é?x#y"]
    rules = U.RULES + [("example.com", "/de/a/", "allow"), ("example.com", "/en", "block"), ("c.d.example.com", "", "block"),
                       ("org", "/fr/", "block"), ("", "/x", "block"), ("a.net", "/a/b/c/d/a", "block")]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':'])}{rng.choice(hosts)}{rng.choice(paths)}"
            f"{rng.choice(['', '?q=1', '#f', '?a://b'])}" for _ in range(400)] + [None, "", "://", "http://", "x" * 100_000]
    rows = [(i if i % 50 else None, u, "x") for i, u in enumerate(urls)] + [(1, urls[1], "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = U.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    want = sorted(repr((i, u, *brute(u, rules))) for i, u, _ in rows)
    assert sorted(repr((r.page_id, r.url, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_empty_tables(spark):
    schema = "host string, path string, verdict string"
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.filter_urls(pages.limit(0), spark.createDataFrame(U.RULES, schema)).count() == 0
    only = U.filter_urls(pages, spark.createDataFrame([], schema)).collect()
    assert [(r.rule, r.verdict) for r in only] == [(None, "allow")]


def test_no_python_in_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = U.filter_urls(pages, spark.createDataFrame(U.RULES, "host string, path string, verdict string"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_short_hashes_that_collide_are_confirmed_by_the_digest(spark, monkeypatch):
    """With one hex digit most expressions collide; the verdicts stay the same, and the join has the short hash alone."""
    from textloom.llm import url_filter as U
    want = sorted(map(repr, U.op1_url_filter(spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(U, "PREFIX_HEX", 1)
    got = U.op1_url_filter(spark, "/root/testdata/sf0.01")
    assert sorted(map(repr, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "short" in join and "digest" not in join and "ExistingRDD" not in plan
