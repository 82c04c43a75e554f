import re

from knotwork.llm.common import Scratch
from knotwork.llm.urls import RULES, build_cascade, url_verdicts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(page, url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda x: (x[0], x[1]))
    return (page, host, path, best[1] if best else None, best[2] if best else "allow")


def key(r):
    return tuple((x is None, x or "") if not isinstance(x, int) else (False, x) for x in r)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Example.NET/en/x?q#f", "http://net", "http://net/", "http://a.net?x=/", "http://xnet/", "http://example.com/de", "http://example.com/de/1", "http://b.org/fr/", "http://fr.org/fr", "x://y://example.net/en/", "http://a.ÉXAMPLE.net/", "http://" + "a." * 20_000 + "net/" + "p" * 50_000, "http://example.net:80/en/", "http://net./", "http://.net/"]
    rows = [(i, u, "html", "h", "r") for i, u in enumerate(urls)] + [(3, "http://q.net/", None, None, None), (None, "http://q.net/", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    assert sorted((tuple(r) for r in url_verdicts(df).collect()), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert url_verdicts(df.limit(0)).collect() == []
    assert {r["verdict"] for r in url_verdicts(df, ()).collect()} == {"allow"}


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(tuple(r) for r in url_verdicts(df).collect()) == sorted(brute(r["page_id"], r["url"]) for r in df.collect())


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 5000, 7).selectExpr("cast(id as string) as key")
    universe = spark.range(5000).selectExpr("cast(id as string) as key")
    cascade = build_cascade(listed, universe, Scratch(spark, "t"), "t")
    assert len(cascade.levels) > 1
    got = universe.where(cascade.lists(universe["key"])).count()
    assert got == listed.count() and listed.where(cascade.lists(listed["key"])).count() == got
