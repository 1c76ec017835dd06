import harness
import pytest
from pyspark.sql import functions as F

from sparkpoison.llm import url_filter as U


def brute(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    under = lambda h: host == h or host.endswith("." + h)
    fits = []
    for kind, rule in rules:
        h, _, p = rule.partition("/")
        if under(h) and path.startswith("/" + p):
            fits.append((len(rule), kind, rule))
    if fits:
        _, kind, rule = max(fits)
        return host, path, rule, kind
    return host, path, None, "block" if any(under(h) for h in listed) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.COM/en/1", "http://www.example.com/en/1", "http://a.example.com/en", "http://a.example.com/en/?q#f",
    "https://x.net/es/1", "https://x.net/fr/1", "https://x.net/de/1", "https://net/es/", "https://notnet/es/", "ftp://user@Example.com:80/en/", "http://example.com?x=://y/z",
    "http://com", "http://com/", "http://ÄXAMPLE.com/en/", "http://bad.org/a", "http://sub.bad.org", "http://verybad.org/", "http://a..com/x", "http://" + "a." * 3000 + "net/es/" + "x" * 100_000,
    "://com/", "http://x.org/://com/", "http://com#/", "http://bad.org.", "http://x.net/es/1",
]


def frame(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS key", "2 AS rule")


def test_equals_brute_force(spark):
    listed = ["bad.org", "nobody.example", "a.b.c.d.e.f"]
    df = spark.createDataFrame([(h,) for h in [*listed, "bad.org", None]], "key string")
    rows = frame(spark, URLS + URLS[:5])
    got = U.filter_urls(rows, U.RULES, df).collect()
    assert len(got) == len(URLS) + 5
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute((URLS + URLS[:5])[r["page_id"]], U.RULES, listed), URLS[r["page_id"] % len(URLS)][:60]
    assert U.filter_urls(rows.limit(0), U.RULES, df).count() == 0
    for r in U.filter_urls(rows, [], df.limit(0)).collect():
        assert r["rule"] is None and r["verdict"] == "allow"


@pytest.mark.parametrize("max_bytes", [U.MAX_FILTER_BYTES, 300])
def test_cascade_is_exact(spark, max_bytes):
    universe = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 60_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = U.build_cascade(listed, universe, max_bytes)
    assert (len(cascade.shards) > 1) == (max_bytes < 1000)
    if max_bytes > 1000:
        assert all(len(level.bits) <= max_bytes for levels in cascade.shards for level in levels) and len(cascade.shards[0]) > 2
        shown = universe.select("key", cascade.contains(F.col("key")).alias("got"))
        assert shown.where("got <> (cast(substring(key, 2) as int) % 7 = 0)").count() == 0


def test_shards_are_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 11).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = U.build_cascade(listed, universe, 60)
    assert 1 < len(cascade.shards) < 20
    shown = universe.select("key", cascade.contains(F.col("key")).alias("got"))
    assert shown.where("got <> (cast(substring(key, 2) as int) % 11 = 0)").count() == 0


def test_query(spark, sf_dir):
    assert harness.compare(spark, harness.connect(sf_dir), U.op1_url_filter, U.ORACLE_SQL["op1_url_filter"], sf_dir)[0] is None


def test_clashing_columns(spark):
    pages = spark.createDataFrame([("http://a.net/fr/x", 1, 2, 3, "old")], "url string, _best int, best int, c0 int, verdict string")
    got = U.filter_urls(pages, U.RULES, spark.createDataFrame([], "key string"))
    assert got.columns == ["url", "_best", "best", "c0", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == ("http://a.net/fr/x", 1, 2, 3, "a.net", "/fr/x", "net/fr/", "block")
