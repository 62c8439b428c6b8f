import random

from parchment.llm import url_filter as U
from parchment.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        path = slash + tail
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.action if best else default


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def test_rules_against_brute_force(spark):
    urls = ["http://example.com/en/1", "https://WWW.Example.com/en/", "http://example.com", "http://example.com/en?x=/en/", "http://a.net/es/x#y", "http://net/fr/", "http://a.net?q=/fr/", "http://x.org/en/", "ftp://é.com/É", "no scheme", "", None, "http://", "http:///en/", "http://com/", "http://.com/", "x://y://z.com/a", "http://example.com/EN/", "http://notexample.com/en/", "http://a.net#/fr/", "http://u@a.net:80/es/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(frame(spark, urls), URL_RULES).collect()}
    assert got == {k: brute(u, URL_RULES) for k, u in enumerate(urls)}


def test_cascade_is_exact_over_many_levels(spark):
    rng = random.Random(3)
    urls = [f"http://h{rng.randrange(400)}.site{rng.randrange(40)}.com/{'abcdef'[rng.randrange(6)]}/{k}" for k in range(1500)]
    rules = [U.Rule(rng.choice(["block", "allow"]), f"h{k}.site{k % 40}.com", f"/{'abcdef'[k % 6]}/") for k in range(400)] + [U.Rule("block", "site3.com", "/")]
    df = frame(spark, urls)
    filters, lengths = U.build_filters(df, rules, rate=0.4)  # a poor first level: later ones have work
    assert max(len(c.levels) for c in filters.values()) >= 3
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, filters, lengths).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_no_rules_no_rows(spark):
    assert [r.verdict for r in U.filter_urls(frame(spark, ["http://a.com/"]), []).collect()] == ["allow"]
    assert U.filter_urls(frame(spark, []), URL_RULES).count() == 0
