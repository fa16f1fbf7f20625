import pytest
from pyspark.sql import functions as F

from webloom.functions import urls

GOOD = {
    "shop.example": "https://shop.example",
    "  HTTP://Shop.Example:80/A/b/?x=1#top ": "http://shop.example/A/b?x=1",
    "https://shop.example:8443/": "https://shop.example:8443",
    "shop.example:8080/x": "https://shop.example:8080/x",
    "//shop.example/y//": "https://shop.example/y",
    "https://8.8.8.8/dns": "https://8.8.8.8/dns",
}
BAD = {
    "": "URL is empty.", "   ": "URL is empty.", None: "URL is empty.", "ftp://shop.example": "Unsupported URL scheme", "javascript:alert(1)": "Unsupported URL scheme", "https://me:pw@shop.example": "embedded credentials",
    "https://": "missing a host", "https://shop.example:99999": "invalid port", "https://shop.example:x": "invalid port", "http://localhost": "cannot be scanned", "http://127.0.0.1": "private", "http://192.168.1.9/x": "private",
    "http://10.1.2.3": "private", "http://[::1]/": "private", "https://word": "top-level", "https://-a.example": "invalid characters", "https://a_b.example": "invalid characters", "https://" + "a" * 2050 + ".example": "exceeds",
}


def test_normalize(spark):
    rows = [(u,) for u in [*GOOD, *BAD]]
    found = {r["u"]: r["n"] for r in spark.createDataFrame(rows, "u string").select("u", urls.normalize(F.col("u"), ipv6=True).alias("n")).collect()}
    for raw, url in GOOD.items():
        assert found[raw]["url"] == url and found[raw]["is_valid"] and found[raw]["error_reason"] is None and found[raw]["original_url"] == raw
    for raw, reason in BAD.items():
        assert not found[raw]["is_valid"] and reason in found[raw]["error_reason"], (raw, found[raw])
        assert found[raw]["url"] is None and found[raw]["domain"] is None


def test_public_ipv6(spark):
    row = spark.createDataFrame([("http://[2001:4860:4860::8888]/",)], "u string").select(urls.normalize(F.col("u"), ipv6=True)["is_valid"]).first()
    assert row[0] is True


@pytest.mark.parametrize(
    "url,canonical",
    [("https://A.example", "https://a.example/"), ("https://a.example/b/?q#f", "https://a.example/b?q"), ("http://a.example:80/", "http://a.example/"), ("mailto:x@y", None), ("https://a.example:x/", None), (None, None)],
)
def test_canonical(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == canonical


def test_predicates(spark):
    df = spark.createDataFrame([("https://www.a.example/x/Login/", "a.example"), ("https://b.a.example/logo.PNG", "a.example"), ("https://a.example/.xml", "A.example"), (None, "a.example")], "u string, d string")
    u = F.col("u")
    got = df.select(urls.is_irrelevant(u), urls.same_site(u, F.col("d")), urls.is_supported_href(u), urls.is_absolute(u)).collect()
    assert [tuple(r) for r in got[:3]] == [(True, True, True, True), (True, False, True, True), (False, True, True, True)]
    assert got[3][1] is False and got[3][2] is False and got[3][3] is False


def test_relevance_and_sources(spark):
    row = spark.createDataFrame([("https://a.example/our_company/case_study", "Our Pricing", ["https://x", "note", None, " HTTP://y"])], "u string, t string, s array<string>")
    got = row.select(urls.relevance(F.col("u"), F.col("t")), urls.http_sources(F.col("s")), urls.grounding_key(F.lit(" HTTPS://X.example/ "))).first()
    assert got[0] == 90 and got[1] == ["https://x", " HTTP://y"] and got[2] == "https://x.example"
