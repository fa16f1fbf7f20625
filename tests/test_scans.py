"""Scans from requests to stored rows: what is fetched, asked and written, and how often."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators import intelligence as intel
from webloom.operators import retrieval
from webloom.plans.engine import Engine
from webloom.sources import http, sinks, tables

FETCHED = "scan_id string, company_id string, fetch_id bigint, page_ord int, url string, final_url string, status string, http_status_code int, html string, elapsed_ms int, error_reason string"
REQUEST = "companyId string, websiteUrl string, domain string, options struct<maxPages: int, forceRescan: boolean, callbackUrl: string>, received_at timestamp"


def fetched(spark, *rows):
    return spark.createDataFrame([(s, c, k, o, u, f, st, 200, h, 1, None) for s, c, k, o, u, f, st, h in rows], FETCHED)


def counting(path, first="valid"):
    """A client that notes each call in a file; its first reply is ``first``."""

    def client(system, prompt):
        with open(path, "a") as f:
            f.write("call\n")
        if first != "valid" and "alone" not in prompt:
            return first
        source = prompt.split("[source: ")[1].split("]")[0]
        field = {"value": "pumps", "confidence": "high", "sources": [source]}
        return json.dumps({"company_overview": field, "products_and_services": field, "pricing": field})

    return client


PAGES = [("s1", "c1", 1, 0, "https://a.example", None, "success", "<body><p>We make pumps.</p><a href=/x>X</a>"), ("s1", "c1", 2, 1, "https://a.example/x", "https://a.example/y", "redirected", "<body><p>Old page.</p>"), ("s1", "c1", 3, 2, "https://a.example/z", "https://a.example/y", "redirected", "<body><p>From five.</p>")]


def calls(path):
    return len(path.read_text().split()) if path.exists() else 0


def test_a_valid_first_reply_is_asked_for_once(spark, tmp_path):
    out = Engine(spark, counting(str(tmp_path / "calls"))).scan(fetched(spark, *PAGES))
    sinks.write_scan(out, str(tmp_path / "store"))
    assert calls(tmp_path / "calls") == 1
    out["scans"].collect(), out["intelligence"].collect()
    assert calls(tmp_path / "calls") == 1


def test_an_invalid_first_reply_is_asked_for_twice_and_no_more(spark, tmp_path):
    out = Engine(spark, counting(str(tmp_path / "calls"), first="I can't tell.")).scan(fetched(spark, *PAGES))
    assert out["scans"].first()["status"] == "completed" and calls(tmp_path / "calls") == 2
    bad = Engine(spark, lambda system, prompt: "no").scan(fetched(spark, *PAGES))
    assert bad["scans"].first()["error_type"] == "ai_extraction_failed"


def test_a_client_of_three_parameters_gets_the_options(spark):
    asked = spark.createDataFrame([("g", 1, "p")], "g string, attempt int, prompt string")
    row = intel.complete(asked, "g", lambda system, prompt, options: json.dumps(options), {"max_output_tokens": 5}).first()
    assert json.loads(row["raw"]) == {"temperature": 0.0, "max_output_tokens": 5}


def test_pages_redirected_to_one_address_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.write_scan(Engine(spark, counting(str(tmp_path / "calls"))).scan(fetched(spark, *PAGES)), root)
    chunks, pages = tables.table(spark, root, "content_chunks").collect(), tables.table(spark, root, "scanned_pages").collect()
    assert len(pages) == len({r["page_id"] for r in pages}) == 2 and len(chunks) == len({r["chunk_id"] for r in chunks}) == 2
    assert {r["text"] for r in chunks} >= {"From five."} and not any("Old" in r["text"] for r in chunks)
    scan = tables.table(spark, root, "website_scans").first()
    assert (scan["status"], scan["pages_scanned"]) == ("completed", 3) and scan["completed_at"] is not None
    stored = tables.table(spark, root, "website_intelligence")
    companies = spark.createDataFrame([("c1",), ("c2",)], "company_id string")
    got = {r["company_id"]: r for r in Engine(spark).intelligence(companies, stored).collect()}
    assert got["c1"]["intelligence"]["pricing"]["value"] == "pumps" and got["c1"]["error_type"] is None
    assert json.loads(got["c2"]["response"])["errorType"] == "intelligence_not_found"


def test_failures_are_stored(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("s1", "c1", 1, 0, "https://a.example", None, "timeout", None), ("s2", "c2", 2, 0, "https://b.example", None, "success", "<body>Text."), ("s3", "c3", 8, *PAGES[0][3:]), ("s3", "c3", 9, 1, "https://a.example/q", None, "not_found", None)]
    sinks.write_scan(Engine(spark, lambda a, b: None).scan(fetched(spark, *rows)), root)
    errors = {(r["scan_id"], r["error_type"], r["page_url"]) for r in tables.table(spark, root, "scan_errors").collect()}
    assert errors == {("s1", "timeout", None), ("s2", "no_pages_found", None), ("s3", "ai_extraction_failed", None), ("s3", "not_found", "https://a.example/q")}
    assert tables.table(spark, root, "website_intelligence").count() == 0


def test_unknown_scans_and_stored_summaries(spark):
    scans = spark.createDataFrame([("s1", "c", "completed", 2, 0, None), ("s2", "c", "failed", 0, 1, "It broke.")], "scan_id string, company_id string, status string, pages_scanned int, pages_failed int, error_summary string").withColumn("started_at", F.lit(None).cast("timestamp")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    errors = spark.createDataFrame([], "error_id string, scan_id string, error_type string, message string, page_url string, created_at timestamp")
    field = {"value": "x", "confidence": "low", "sources": ["https://a.example"]}
    data = [("c", "s1", 1, json.dumps({"company_overview": field, "products_and_services": field, "pricing": field})), ("d", "s9", 1, json.dumps({"company_overview": 5}))]
    known = intel.stored(spark.createDataFrame(data, "company_id string, scan_id string, created_at int, data string"))
    assert {r["company_id"]: r["intelligence"] is None for r in known.collect()} == {"c": False, "d": True}
    asked = spark.createDataFrame([("s1",), ("s2",), ("none",)], "scan_id string")
    got = {r["scan_id"]: json.loads(r["response"]) for r in Engine(spark).scan_status(scans, errors, known, asked).collect()}
    assert got["s1"]["extractedDataSummary"]["hasPricing"] is True and got["s2"]["message"] == "It broke." and got["none"]["errorType"] == "scan_not_found" and got["none"]["scanId"] == "none"


@pytest.fixture(scope="module")
def site():
    hits = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            known = {"/": "<title>Pumps</title><body><p>We make pumps.</p>" + "".join(f"<a href='/p{k}'>Page {k}</a>" for k in range(20)) + "<a href='/gone'>gone about</a>", **{f"/p{k}": f"<body><p>Page number {k} says this." for k in range(20)}}
            self.send_response(200 if self.path in known else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(known.get(self.path, "").encode())

        def log_message(self, *args):
            pass

    served = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}", hits
    served.shutdown()


def test_a_request_is_run_end_to_end(spark, site, tmp_path, monkeypatch):
    address, hits = site
    port = int(address.rsplit(":", 1)[1])
    # the host name of the request is answered by the local server
    monkeypatch.setattr(http, "get", _local(http.get, port))
    rows = [("c1", "pumps.example", None, (4, False, None), None), ("c1", "pumps.example", None, (4, False, None), None), ("c2", "pumps.example", None, (99, False, None), None)]
    requests = spark.createDataFrame(rows, REQUEST).withColumn("received_at", F.lit("2026-01-01").cast("timestamp"))
    out = Engine(spark, counting(str(tmp_path / "calls"))).start(requests)
    sinks.write_scan(out, str(tmp_path / "store"))
    assert len(hits) == 5 and sorted(hits)[0] == "/" and "/gone" in hits, hits
    assert calls(tmp_path / "calls") == 1
    scan = tables.table(spark, str(tmp_path / "store"), "website_scans").collect()
    assert [(r["company_id"], r["status"], r["pages_scanned"], r["pages_failed"], r["website_url"]) for r in scan] == [("c1", "completed", 4, 1, "https://pumps.example")]
    checked = {r["company_id"]: json.loads(r["response"]) for r in out["requests"].collect()}
    assert checked["c1"]["status"] == "in_progress" and checked["c1"]["scanId"] == scan[0]["scan_id"] and checked["c2"]["details"] == {"field": "maxPages"} and "scanId" not in checked["c2"]
    # a fresh scan of the same address isn't repeated unless it is forced
    known = spark.createDataFrame([("c1", "https://pumps.example", "completed")], "company_id string, website_url string, status string").withColumn("completed_at", F.current_timestamp())
    again = Engine(spark).start(requests.where("companyId = 'c1'"), known)
    assert again["scans"].count() == 0 and len(hits) == 5
    forced = requests.where("companyId = 'c1'").limit(1).withColumn("options", F.struct(F.lit(1).alias("maxPages"), F.lit(True).alias("forceRescan"), F.lit(None).cast("string").alias("callbackUrl")))
    assert Engine(spark).start(forced, known)["scans"].count() == 1 and len(hits) == 7


def _local(get, port):
    def local(url, timeout, largest):
        _, _, code, hops, body, spent, error = get(url.replace("https://pumps.example", f"http://127.0.0.1:{port}"), timeout, largest)
        return url, url, code, hops, body, spent, error

    return local


def test_each_request_has_its_own_scan_id(spark):
    rows = [("c", "a.example", None, None, t) for t in (1, 2, 2)]
    requests = spark.createDataFrame(rows, "companyId string, websiteUrl string, domain string, options struct<maxPages: int, forceRescan: boolean, callbackUrl: string>, received_at int")
    assert len({r["scan_id"] for r in Engine(spark).check_requests(requests).collect()}) == 2


def test_search_chunks_stays_within_the_company(spark, monkeypatch):
    rows = [(f"k{k}", "ab"[k % 2], [float(k), 1.0], f"text {k}") for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, company_id string, embedding array<float>, text string")
    asked = spark.createDataFrame([("q", "a", [6.0, 1.0]), ("r", "b", [0.0, 0.0]), ("s", "none", [1.0, 1.0])], "question_id string, company_id string, embedding array<float>")
    cosine = lambda k: (6.0 * k + 1) / (37.0 * (k * k + 1)) ** 0.5
    want = [("q", f"k{k}", "a") for k in sorted(range(0, 40, 2), key=lambda k: -cosine(k))[:3]]
    for base, some in ((20_000, 2_000), (5, 1)):
        monkeypatch.setattr(retrieval, "SLICE_ROWS", base)
        monkeypatch.setattr(retrieval, "QUERY_ROWS", some)
        got = retrieval.search_chunks(chunks, asked, 3).orderBy("rank").collect()
        assert [(r["question_id"], r["chunk_id"], r["company_id"]) for r in got] == want


def test_cuts_are_removed_and_need_a_shared_folder(spark, tmp_path):
    import os

    frame = tables.cut_table(spark.range(5))
    kept = tables.cut(spark.range(3))
    made = [p.removeprefix("file:") for p in tables._made[-2:]]
    assert frame.count() == 5 and kept.count() == 3 and all(os.path.exists(p.replace("//", "/")) for p in made)
    tables.release(spark)
    assert not tables._made and not any(os.path.exists(p.replace("//", "/")) for p in made)
    assert tables.cut(spark.range(3)).count() == 3

    class Cluster:
        master = "spark://host:7077"

    class Session:
        class sparkContext(Cluster):
            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                isEmpty = staticmethod(lambda: True)
                                isDefined = staticmethod(lambda: False)

                            return Empty

                    return Context

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        tables.checkpoint_dir(Session)
