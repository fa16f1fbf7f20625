"""Registered queries over hand-made rows, for operators whose results no SQL computes from the tables, with the rows they have to give."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import DEFAULTS, setting
from webloom.operators import intelligence as intel
from webloom.operators import pages as paging
from webloom.plans.engine import Engine
from webloom.sources import http, sinks
from webloom.sources.tables import checkpoint_dir, cut_table, table

FETCHED = "fetch_id bigint, url string, final_url string, status string, html string"

#: fetch_id, url, final_url, status, html; and what extraction makes of it: url, page_type, title, meta_description, headings, clean_text, raw_text_length, language.
PAGES = [
    ((1, "https://a.example/", None, "success", "<html lang=' EN-gb '><head><title> Our\n pumps </title><meta name='Description' content=' Small  pumps '></head><body><nav>Menu</nav><header>Top</header><main><h1>Pumps</h1><p>We make<br>pumps.</p><p>We make</p></main><footer>End</footer>"),
     ("https://a.example/", "homepage", "Our pumps", "Small pumps", "Pumps", "Pumps\nWe make\npumps.\nWe make", 28, "en-gb")),
    ((2, "https://a.example/x1", None, "success", "<title>Pricing</title><meta property='og:description' content='og'><meta name=description content='  '><body><article>a<h2>Plans</h2><h2>PLANS</h2></article><div id=content>no</div>"),
     ("https://a.example/x1", "pricing", "Pricing", "og", "Plans", "a\nPlans\nPLANS", 13, None)),
    ((3, "https://a.example/x2", "https://a.example/y2", "redirected", "<meta name='twitter:description' content='tw'><meta http-equiv='Content-Language' content='DE'><body><div role=main>r<div hidden>h<p>inner</p></div><span aria-hidden=true>g</span></div><main-x>z</main-x>"),
     ("https://a.example/y2", "general", None, "tw", "", "r", 1, "de")),
    ((4, "https://a.example/x3", None, "success", "<body><div class='box content'>c<p style='display : none'>gone</p><p style='VISIBILITY:hidden'>gone</p></div><div>out</div>"), ("https://a.example/x3", "general", None, None, "", "c", 1, None)),
    ((5, "https://a.example/x4", None, "success", "<body><!-- no --><script>x()</script><style>p{}</style><form>f</form><svg><text>s</text></svg><p>Tom &amp; J&eacute;r&#244;me<aside>beside</aside>"), ("https://a.example/x4", "general", None, None, "", "Tom & Jérôme\nbeside", 19, None)),
    ((6, "https://a.example/x5", None, "success", "<body><h1>Frequently asked questions</h1><h3>Straße</h3><h4>STRASSE</h4><p>x"), ("https://a.example/x5", "faq", None, None, "Frequently asked questions|Straße", "Frequently asked questions\nStraße\nSTRASSE\nx", 43, None)),
    ((7, "https://a.example/x6", None, "success", "<title>Pricing<body><h1>Plans"), ("https://a.example/x6", "pricing", "PricingPlans", None, "Plans", None, None, None)),
    ((8, "https://a.example/careers", None, "success", "<title>Pricing</title><body>plans"), ("https://a.example/careers", "career", "Pricing", None, "", "plans", 5, None)),
    ((9, "https://a.example/x7", None, "success", "<title>About us</title><meta name=description content='jobs'><body><footer>contact</footer>"), ("https://a.example/x7", "about", "About us", "jobs", "", "", 0, None)),
    ((10, "https://a.example/x8", None, "not_found", "<body>gone"), ("https://a.example/x8", "unknown", None, None, "", "", 0, None)),
    ((11, "https://a.example/x9", None, "timeout", None), ("https://a.example/x9", "unknown", None, None, "", "", 0, None)),
    ((12, "not an address", None, "success", "<title>Pricing</title><body>b"), ("not an address", "unknown", "Pricing", None, "", "b", 1, None)),
    ((13, "https://a.example/x10", None, "success", " \n "), ("https://a.example/x10", "unknown", None, None, "", "", 0, None)),
    ((14, "https://a.example/legal/privacy%20policy?x=terms", None, "success", "<body><p>a</p>\n<p>a</p><p> a  b c </p>"), ("https://a.example/legal/privacy%20policy?x=terms", "privacy_policy", None, None, "", "a\na b c", 10, None)),
]
_HOME = (
    "<body><a href=' /about/ '>About</a><a href='https://www.a.example/about#team'>us</a><a href='/'>home</a><a href='#top'>top</a><a href=''>none</a><a href='MAILTO:x@a.example'>m</a><a href='tel:1'>t</a><a href='javascript:x()'>j</a>"
    "<a href='data:x'>d</a><a href='https://b.example/pricing'>b</a><a href='//a.example:443/pricing'>p</a><a href='../up/./x/../case_study'>c</a><a href='/cart/x'>c</a><a href='/login'>l</a><a href='/f.PDF'>f</a><a href='/.xml'>dot</a>"
    "<a href='http://[x'>bad</a><a href='/x'><b>Contact</b> us</a><a href='/x'>again</a><a href='/x?q=1'>Our Blog</a><a>no href</a><nav><a href='/faq'>FAQ</a></nav>"
)
HOMES = [(1, "https://a.example", None, "success", _HOME), (2, "https://c.example/", "https://www.c.example/start/", "redirected", "<body>" + "".join(f"<a href='page{k:02d}'>n</a>" for k in range(18))), (3, "https://d.example", None, "failed", _HOME), (4, "nothing", None, "success", _HOME)]
LINKS = [
    (1, 1, "https://a.example/about", 100), (1, 2, "https://www.a.example/about", 100), (1, 3, "https://a.example/pricing", 90), (1, 4, "https://a.example/up/case_study", 85), (1, 5, "https://a.example/faq", 70),
    (1, 6, "https://a.example/x?q=1", 70), (1, 7, "https://a.example/x", 65), (1, 8, "https://a.example/.xml", 0), *((2, k + 1, f"https://www.c.example/start/page{k:02d}", 0) for k in range(15)),
]
REQUESTS = [
    (" c1 ", "Shop.example:443/a/", None, 99 - 59, None), ("", "shop.example", None, 5, "http://x"), ("c2", "shop.example", None, 5, "http://x"), ("c3", "shop.example", None, 51, None), ("c4", "localhost", "other", 5, None),
    ("c5", "shop.example", "other.example", None, None), ("c6", "www.shop.example", "SHOP.example ", 3, "https://x"),
]
CHECKED = [
    ("c1", "https://shop.example/a", 15, None, None, '{"companyId":"c1","status":"in_progress"}'),
    ("", "https://shop.example", 5, "invalid_input", "companyId", '{"companyId":"","status":"error","errorType":"invalid_input","message":"companyId must not be blank","retryable":false,"details":{"field":"companyId"}}'),
    ("c2", "https://shop.example", 5, "invalid_input", "callbackUrl", '{"companyId":"c2","status":"error","errorType":"invalid_input","message":"callbackUrl must start with https://","retryable":false,"details":{"field":"callbackUrl"}}'),
    ("c3", "https://shop.example", 15, "invalid_input", "maxPages", '{"companyId":"c3","status":"error","errorType":"invalid_input","message":"maxPages must be from 1 to 50","retryable":false,"details":{"field":"maxPages"}}'),
    ("c4", None, 5, "invalid_url", "websiteUrl", '{"companyId":"c4","status":"error","errorType":"invalid_url","message":"\'localhost\' cannot be scanned.","retryable":false,"details":{"field":"websiteUrl"}}'),
    ("c5", "https://shop.example", 15, "domain_mismatch", "domain", '{"companyId":"c5","status":"error","errorType":"domain_mismatch","message":"The domain doesn\'t match the website\'s address.","retryable":false,"details":{"field":"domain"}}'),
    ("c6", "https://www.shop.example", 3, None, None, '{"companyId":"c6","status":"in_progress"}'),
]
#: scan_id, company_id, page_ord, url, final_url, status, html
SCANS = [
    ("s1", "c1", 0, "https://a.example", None, "success", "<title>A</title><body><p>We make pumps.</p><a href='/pricing'>Pricing</a><a href='/old'>Old</a>"), ("s1", "c1", 1, "https://a.example/pricing", None, "success", "<body><p>From five.</p>"),
    ("s1", "c1", 2, "https://a.example/old", "https://a.example/pricing", "redirected", "<body><p>From six.</p>"), ("s1", "c1", 3, "https://a.example/gone", None, "not_found", None),
    ("s2", "c2", 0, "https://b.example", None, "timeout", None), ("s3", "c3", 0, "https://c.example", None, "blocked", None), ("s4", "c4", 0, "https://d.example", None, "server_error", None), ("s5", "c5", 0, "https://e.example", None, "success", "<body>Alone."),
    ("s6", "c6", 0, "https://f.example", None, "success", "<body><p>Refuse.</p>"), ("s6", "c6", 1, "https://f.example/about", None, "success", "<body>About."), ("s7", "c7", 0, "https://g.example", None, "success", "<body><p>Second try.</p>"), ("s7", "c7", 1, "https://g.example/x", None, "success", "<body>x"),
]
SCANNED = [
    ("s1", "completed", None, 3, 1, 2, 2, True), ("s2", "failed", "timeout", 0, 1, 1, 0, False), ("s3", "failed", "blocked", 0, 1, 1, 0, False), ("s4", "failed", "website_unreachable", 0, 1, 1, 0, False),
    ("s5", "failed", "no_pages_found", 1, 0, 1, 1, False), ("s6", "failed", "ai_extraction_failed", 2, 0, 2, 2, False), ("s7", "completed", None, 2, 0, 2, 2, True),
]


def _reply(source: str, **extra) -> str:
    field = {"value": "pumps", "confidence": "high", "sources": [source]}
    return json.dumps({"company_overview": field, "products_and_services": field, "pricing": field, "legal_pages": {"terms_available": True, "sources": ["https://elsewhere.test"]}, **extra})


def _client(system: str, prompt: str) -> str | None:
    """Refuses one site, answers another at the second attempt, and all others at once."""
    if "Refuse" in prompt:
        raise RuntimeError("refused")
    if "Second try" in prompt and "alone" not in prompt:
        return "Let me see."
    return _reply(prompt.split("[source: ")[1].split("]")[0])


def page_fields(spark, root):
    """What extraction and classification read from hand-made pages."""
    fetched = spark.createDataFrame([p for p, _ in PAGES], FETCHED)
    rows = paging.extract(fetched)
    # an unclosed title takes in what follows it; how much text is left then is up to the parser
    nested = F.col("fetch_id") == 7
    return rows.select(
        "fetch_id", "url", "page_type", "title", "meta_description", F.array_join("headings", "|").alias("headings"), F.when(~nested, F.col("clean_text")).alias("clean_text"), F.when(~nested, F.col("raw_text_length")).alias("raw_text_length"), "language", "fetch_status"
    ).withColumn("title", F.when(nested, F.regexp_replace("title", " ", "")).otherwise(F.col("title")))


def links_ranked(spark, root):
    return paging.discover_links(spark.createDataFrame(HOMES, FETCHED))


def requests_checked(spark, root):
    rows = [(c, u, d, (m, False, b)) for c, u, d, m, b in REQUESTS]
    requests = spark.createDataFrame(rows, "companyId string, websiteUrl string, domain string, options struct<maxPages: int, forceRescan: boolean, callbackUrl: string>").withColumn("received_at", F.lit(1))
    checked = Engine(spark).check_requests(requests)
    return checked.select("company_id", "url", "max_pages", "error_type", "field", F.regexp_replace("response", r',"scanId":"[^"]*"|,"startedAt":[0-9]+', "").alias("response"))


def _scanned(spark) -> dict[str, DataFrame]:
    rows = [(s, c, k, o, u, f, st, h) for k, (s, c, o, u, f, st, h) in enumerate(SCANS)]
    return Engine(spark, _client).scan(spark.createDataFrame(rows, "scan_id string, company_id string, fetch_id bigint, page_ord int, url string, final_url string, status string, html string"))


def scans_run(spark, root):
    """Scans of hand-made sites, written to a store and read back."""
    place = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    sinks.write_scan(_scanned(spark), place)
    read = lambda name: table(spark, place, name)
    count = lambda name, key, as_: read(name).groupBy("scan_id").agg(F.count_distinct(key).alias(as_))
    known = intel.stored(read("website_intelligence")).select("scan_id", intel.extracted_summary(F.col("intelligence"))["hasPricing"].alias("priced"))
    chunks = read("content_chunks").join(read("scanned_pages").select("page_id", "scan_id"), "page_id").groupBy("scan_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    # pages of one address are one page: the failed one of s1 is stored as well
    rows = read("website_scans").join(count("scanned_pages", "page_id", "stored"), "scan_id", "left").join(chunks, "scan_id", "left").join(known, "scan_id", "left")
    stored = F.col("stored") - F.when(F.col("scan_id") == "s1", 1).otherwise(0)
    out = rows.select("scan_id", "status", "error_type", F.col("pages_scanned").cast("bigint").alias("pages_scanned"), F.col("pages_failed").cast("bigint").alias("pages_failed"), stored.alias("stored"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("priced", F.lit(False)).alias("priced"))
    out = cut_table(out)
    sinks.drop_tables(spark, place)
    return out


def _store(spark):
    scans = [("s1", "c1", "completed", 3, 1, None, 10), ("s2", "c1", "completed", 2, 0, None, 20), ("s3", "c2", "failed", 0, 1, "The homepage did not answer.", 30), ("s4", "c3", "in_progress", 0, 0, None, 40), ("s5", "c4", "completed", 1, 0, None, 50), ("s6", "c5", "failed", 0, 0, None, 60)]
    errors = [("e1", "s3", "blocked", "first", None, 1), ("e2", "s3", "timeout", "last", None, 2), ("e3", "s1", "not_found", "page", "https://a.example/x", 3)]
    data = [("c1", "s1", 1, _reply("https://a.example", pricing=None)), ("c1", "s2", 2, _reply("https://a.example")), ("c4", "s5", 3, '{"company_overview": 5}'), ("c4", "s9", 2, _reply("https://e.example"))]
    frames = (
        spark.createDataFrame(scans, "scan_id string, company_id string, status string, pages_scanned int, pages_failed int, error_summary string, started_at int").withColumn("completed_at", F.lit(None).cast("int")),
        spark.createDataFrame(errors, "error_id string, scan_id string, error_type string, message string, page_url string, created_at int"),
        spark.createDataFrame(data, "company_id string, scan_id string, created_at int, data string"),
    )
    return frames


_FLAGS = '"extractedDataSummary":{{"hasPricing":{0},"hasBlog":false,"hasTerms":{0},"hasPrivacyPolicy":false,"hasCaseStudies":false}}'
STATUSES = [
    ("s1", f'{{"companyId":"c1","scanId":"s1","status":"completed","pagesScanned":3,"pagesFailed":1,{_FLAGS.format("false")},"startedAt":10}}'), ("s2", f'{{"companyId":"c1","scanId":"s2","status":"completed","pagesScanned":2,"pagesFailed":0,{_FLAGS.format("true")},"startedAt":20}}'),
    ("s3", '{"companyId":"c2","scanId":"s3","status":"failed","errorType":"timeout","message":"The homepage did not answer.","retryable":true,"pagesScanned":0,"pagesFailed":1,"startedAt":30}'), ("s4", '{"companyId":"c3","scanId":"s4","status":"in_progress","startedAt":40}'),
    ("s5", f'{{"companyId":"c4","scanId":"s5","status":"completed","pagesScanned":1,"pagesFailed":0,{_FLAGS.format("false")},"startedAt":50}}'), ("s6", '{"companyId":"c5","scanId":"s6","status":"failed","errorType":"internal_error","message":"The scan failed.","retryable":true,"pagesScanned":0,"pagesFailed":0,"startedAt":60}'),
    ("s0", '{"scanId":"s0","status":"error","errorType":"scan_not_found","message":"There is no scan s0.","retryable":false}'),
]


def statuses_answered(spark, root):
    """Status responses with summaries of stored intelligence, failures and unknown scans."""
    scans, errors, data = _store(spark)
    asked = spark.createDataFrame([(s,) for s, _ in STATUSES], "scan_id string")
    return Engine(spark).get_scan_status(scans, errors, intel.stored(data), asked)


def intelligence_answered(spark, root):
    _, _, data = _store(spark)
    companies = spark.createDataFrame([("c1",), ("c4",), ("c9",)], "company_id string")
    found = Engine(spark).get_website_intelligence(companies, data)
    return found.select("company_id", F.col("intelligence.pricing.value").alias("pricing"), "error_type", F.get_json_object("response", "$.errorType").alias("told"))


def addresses_fetched(spark, root):
    """Addresses that no server answers."""
    asked = spark.createDataFrame([("http://127.0.0.1:1/",), ("nonsense",), ("file:///etc/hostname",), (None,)], "url string")
    rows = paging.fetch_rows(http.fetch_responses(asked, timeout=5))
    return rows.select("url", "final_url", "status", "http_status_code", "html", (F.col("elapsed_ms") >= 0).alias("timed"), F.col("error_reason").isNotNull().alias("reason"))


def settings_read(spark, root):
    rows = [(name, int(setting(spark, name)), sinks.log_line("read", setting=name)) for name in sorted(DEFAULTS)]
    return spark.createDataFrame(rows, "name string, value bigint, line string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [page_fields, links_ranked, requests_checked, scans_run, statuses_answered, intelligence_answered, addresses_fetched, settings_read]
    return {f.__name__: f for f in named}


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    return "'" + value.replace("'", "''") + "'" if kind == "VARCHAR" else f"CAST({str(value).lower()} AS {kind})"


def _values(rows: list[tuple], columns: str) -> str:
    """A SELECT of the given rows; ``columns``: names and SQL types."""
    parts = [c.split() for c in columns.split(", ")]
    lines = ", ".join("(" + ", ".join(_literal(v, kind) for v, (_, kind) in zip(row, parts)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {lines}) AS t({', '.join(name for name, _ in parts)})"


def oracle_sql() -> dict[str, str]:
    pages = [(p[0], *fields, p[3]) for p, fields in PAGES]
    return {
        "page_fields": _values(pages, "fetch_id BIGINT, url VARCHAR, page_type VARCHAR, title VARCHAR, meta_description VARCHAR, headings VARCHAR, clean_text VARCHAR, raw_text_length INTEGER, language VARCHAR, fetch_status VARCHAR"),
        "links_ranked": _values(LINKS, "fetch_id BIGINT, rank INTEGER, url VARCHAR, score INTEGER"),
        "requests_checked": _values(CHECKED, "company_id VARCHAR, url VARCHAR, max_pages INTEGER, error_type VARCHAR, field VARCHAR, response VARCHAR"),
        "scans_run": _values(SCANNED, "scan_id VARCHAR, status VARCHAR, error_type VARCHAR, pages_scanned BIGINT, pages_failed BIGINT, stored BIGINT, chunks BIGINT, priced BOOLEAN"),
        "statuses_answered": _values(STATUSES, "scan_id VARCHAR, response VARCHAR"),
        "intelligence_answered": _values([("c1", "pumps", None, None), ("c4", None, "intelligence_not_found", "intelligence_not_found"), ("c9", None, "intelligence_not_found", "intelligence_not_found")], "company_id VARCHAR, pricing VARCHAR, error_type VARCHAR, told VARCHAR"),
        "addresses_fetched": _values([(u, u, "failed", None, None, True, True) for u in ("http://127.0.0.1:1/", "nonsense", "file:///etc/hostname")], "url VARCHAR, final_url VARCHAR, status VARCHAR, http_status_code INTEGER, html VARCHAR, timed BOOLEAN, reason BOOLEAN"),
        "settings_read": _values([(n, v, f"read | setting={n}") for n, v in sorted(DEFAULTS.items())], "name VARCHAR, value BIGINT, line VARCHAR"),
    }
