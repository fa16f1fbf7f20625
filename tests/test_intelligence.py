import json

from webloom.operators import intelligence as intel
from webloom.operators import retrieval, store
from webloom.plans.engine import Engine

REPLY = {
    "company_overview": {"value": "Makes pumps", "confidence": "high", "sources": "https://A.example/about"},
    "products_and_services": {"value": "pumps", "sources": ["https://elsewhere.example"]},
    "pricing": {"value": "from 5", "confidence": "low", "sources": ["https://a.example", 7, "note"]},
    "use_cases": {"value": "not_available", "sources": ["https://a.example"]},
    "legal_pages": {"terms_available": True, "sources": ["https://elsewhere.example"]},
    "missing_information": ["use cases", "contact"],
    "other": 1,
}


def test_first_valid_reply_is_grounded(spark):
    body = json.dumps(REPLY)
    wrong = json.dumps(REPLY | {"pricing": {"value": 5}})
    replies = [("a", 1, "no"), ("a", 2, f"```json\n{body}\n```"), ("b", 1, f"Here: {body} done"), ("c", 1, wrong), ("c", 2, "[1]"), ("d", 1, json.dumps(REPLY | {"company_overview": None})), ("e", 1, None), ("f", 1, json.dumps(REPLY | {"pricing": {"value": "x", "confidence": "sure"}}))]
    contexts = spark.createDataFrame([(g, ["https://a.example", "https://a.example/about"]) for g in "abcdefg"], "g string, sources array<string>")
    got = {r["g"]: r["intelligence"] for r in intel.first_valid(spark.createDataFrame(replies, "g string, attempt int, raw string"), contexts, "g").collect()}
    assert got["a"] == got["b"] and all(got[g] is None for g in "cdefg")
    a = got["a"]
    assert a["company_overview"]["sources"] == ["https://A.example/about"] and a["company_overview"]["confidence"] == "high"
    assert a["products_and_services"]["value"] == "not_available" and a["products_and_services"]["sources"] == [] and a["pricing"]["sources"] == ["https://a.example"] and a["use_cases"] is None
    assert a["legal_pages"]["terms_available"] and a["legal_pages"]["sources"] == [] and a["missing_information"] == ["use cases", "contact", "products and services"]


def test_store(spark):
    scans = spark.createDataFrame([("s1", "c", "failed"), ("s2", "c", "completed")], "scan_id string, company_id string, status string")
    fresh = spark.createDataFrame([("s2", "x", "new", 1), ("s3", "c", "late", 3), ("s3", "c", "new", 2)], "scan_id string, company_id string, status string, seq int")
    got = {r["scan_id"]: r["status"] for r in store.insert_absent(scans, fresh, "scan_id", "seq").collect()}
    assert got == {"s1": "failed", "s2": "completed", "s3": "new"}
    errors = spark.createDataFrame([("e1", "s1", "timeout", "m", None, 1), ("e2", "s1", "blocked", "n", "u", 2), ("e2", "s1", "blocked", "n", "u", 2)], "error_id string, scan_id string, error_type string, message string, page_url string, created_at int")
    last = {r["scan_id"]: (r["error_type"], r["retryable"]) for r in store.last_errors(scans, errors).collect()}
    assert last == {"s1": ("blocked", False), "s2": ("internal_error", True)}
    pages = spark.createDataFrame([("p1", "s1"), ("p1", "s1"), ("p2", "s1")], "page_id string, scan_id string")
    counted = {r["scan_id"]: (r["pages_scanned"], r["pages_failed"], r["pages_discovered"]) for r in store.scan_counters(scans, pages, errors).collect()}
    assert counted == {"s1": (2, 1, 3), "s2": (0, 0, 0)}
    assert [r["seq"] for r in store.rows_of(fresh, "scan_id", "s3", "seq").collect()] == [2, 3] and store.rows_of(fresh, "scan_id", "none", "seq").count() == 0


def test_nearest(spark):
    rows = [(k, [float(k % 3), 1.0, float(k)], k % 2) for k in range(12)] + [(50, [0.0, 0.0, 0.0], 0), (51, None, 0)]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = retrieval.nearest(base.where("vec_id in (0, 50)"), base, "label", 2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"]) for r in got] == [(0, 1), (0, 2)] and got[0]["vec_id"] == 2
    assert retrieval.nearest(base.limit(0), base, "label").count() == 0


HTML = "<title>Pumps</title><body><h1>About pumps</h1><p>We make pumps. They last.</p><a href='/pricing'>Pricing</a></body>"


def test_engine_end_to_end(spark):
    rows = [("s1", "c1", 1, 0, "https://a.example", "success", HTML), ("s1", "c1", 2, 1, "https://a.example/pricing", "success", "<body><p>From five.</p>"), ("s1", "c1", 3, 2, "https://a.example/x", "not_found", None), ("s2", "c2", 4, 0, "https://b.example", "timeout", None)]
    df = spark.createDataFrame([(s, c, k, o, u, None, st, 200, h, 1, None) for s, c, k, o, u, st, h in rows], "scan_id string, company_id string, fetch_id bigint, page_ord int, url string, final_url string, status string, http_status_code int, html string, elapsed_ms int, error_reason string")

    def client(system, prompt):
        assert "https://a.example" in prompt
        if "alone" not in prompt:
            raise RuntimeError("first call fails")
        field = {"value": "pumps", "confidence": "high", "sources": ["https://a.example/"]}
        return json.dumps({"company_overview": field, "products_and_services": field, "pricing": field | {"sources": ["https://c.example"]}})

    out = Engine(spark, client).scan(df)
    scans = {r["scan_id"]: r for r in out["scans"].collect()}
    assert (scans["s1"]["status"], scans["s1"]["pages_scanned"], scans["s1"]["pages_failed"]) == ("completed", 2, 1) and (scans["s2"]["status"], scans["s2"]["error_type"]) == ("failed", "timeout")
    assert scans["s1"]["summary"]["hasPricing"] is False and [r["url"] for r in out["links"].collect()] == ["https://a.example/pricing"]
    assert [r["page_type"] for r in out["pages"].orderBy("fetch_id").collect()] == ["homepage", "pricing", "unknown", "homepage"]


def test_requests(spark):
    rows = [(" c ", "Shop.example", None, 99), ("", "shop.example", None, 5), ("c", "localhost", None, 5), ("c", "shop.example", "other.example", 5), ("c", "shop.example", "WWW.shop.example ", 5)]
    df = spark.createDataFrame([(c, u, d, (m, False, None)) for c, u, d, m in rows], "companyId string, websiteUrl string, domain string, options struct<maxPages: int, forceRescan: boolean, callbackUrl: string>")
    got = Engine(spark).check_requests(df).collect()
    assert [r["error_type"] for r in got] == ["invalid_input", "invalid_input", "invalid_url", "domain_mismatch", None] and got[4]["url"] == "https://shop.example" and got[4]["max_pages"] == 5


def test_requests_stream(spark, tmp_path):
    from webloom.streaming.requests import checked_requests

    schema = "companyId string, websiteUrl string, domain string, options struct<maxPages: int, forceRescan: boolean, callbackUrl: string>, received_at timestamp"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"companyId": "c", "websiteUrl": "a.example", "received_at": "2026-01-01T00:00:00"}\n' * 2)
    stream = checked_requests(Engine(spark), spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["url"] for r in spark.table("checked").collect()] == ["https://a.example"]
