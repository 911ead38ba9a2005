from itertools import product

from sparkgrams.llm.oracles import OP5
from sparkgrams.llm.queries import URL_RULES, op5_url_filter
from sparkgrams.llm.url_filter import filter_urls


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_against_sql(spark, sf_dir, duck, same_rows):
    same_rows(op5_url_filter(spark, sf_dir).toPandas(), duck.execute(OP5).df())


def test_nested_rules(spark):
    rules = [("org", "/", "a"), ("b.org", "/", "block"), ("b.org", "/x", "allow"), ("b.org", "/x/y", "block"), ("b.org", "/x/z", "allow"), ("c.b.org", "/x/y/", "allow"), ("org", "/x/y/z/w", "block"), ("a/b", "", "never")]
    hosts = ["org", "b.org", "c.b.org", "B.ORG", "ab.org", "d.c.b.org", "b.org:80", "b.org.", ""]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/y/", "/x/y/z/w", "/x/zz?q=/y", "/x#/y", "?/x/y"]
    urls = [f"http://{h}{p}" for h, p in product(hosts, paths)] + [None, "", "nothing", "://", "x://b.org/x://c", "A\n://b.org/x\ny"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as g", "'x' as host", "2 as k0")
    for block in (2, 1000):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules, rule_block=block).collect()}
        assert got == {n: brute(u, rules) for n, u in enumerate(urls)}


def test_edges(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert filter_urls(df, []).filter("rule is null and verdict = 'allow'").count() == 3
    assert filter_urls(df, URL_RULES, default="block").filter("verdict = 'allow'").count() == 2
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = op5_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and "Window" in plan and "html" not in plan
