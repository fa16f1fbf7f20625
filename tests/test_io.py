import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators import pages, store
from webloom.plans.engine import Engine
from webloom.sources import http, sinks, tables


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/page")
                self.end_headers()
                return
            self.send_response({"/page": 200, "/big": 200, "/loop": 500}.get(self.path, 404))
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(("ü" * (500 if self.path == "/big" else 3)).encode())

        def log_message(self, *args):
            pass

    served = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}"
    served.shutdown()


def test_fetch(spark, server):
    asked = [f"{server}/{p}" for p in ("page", "moved", "none", "loop", "big")] + ["http://127.0.0.1:1/", "nonsense", None]
    rows = pages.fetch_rows(http.fetch_responses(spark.createDataFrame([(u,) for u in asked], "url string"), timeout=5, largest=100), largest=100).collect()
    got = {r["url"].rsplit("/", 1)[-1] or "refused": r for r in rows}
    assert {k: r["status"] for k, r in got.items()} == {"page": "success", "moved": "redirected", "none": "not_found", "loop": "server_error", "big": "failed", "refused": "failed", "nonsense": "failed"}
    assert got["page"]["html"] == "üüü" and got["moved"]["final_url"].endswith("/page") and got["none"]["html"] is None and got["refused"]["http_status_code"] is None


def test_write_and_read(spark, tmp_path):
    rows = [("s1", "c1", 1, 0, "https://a.example", "success", "<title>A</title><body>We make pumps."), ("s1", "c1", 2, 1, "https://a.example/x", "not_found", None)]
    df = spark.createDataFrame([(s, c, k, o, u, None, st, 200, h, 1, None) for s, c, k, o, u, st, h in rows], "scan_id string, company_id string, fetch_id bigint, page_ord int, url string, final_url string, status string, http_status_code int, html string, elapsed_ms int, error_reason string")
    root = str(tmp_path / "store")
    sinks.write_scan(Engine(spark).scan(df), root)
    chunks = tables.table(spark, root, "content_chunks").collect()
    stored = {r["page_id"]: r for r in tables.table(spark, root, "scanned_pages").collect()}
    assert len(chunks) == 1 and stored[chunks[0]["page_id"]]["page_url"] == "https://a.example" and chunks[0]["metadata"]["page_type"] == "homepage" and len(stored) == 2
    assert tables.table(spark, root, "website_scans").first()["error_type"] == "ai_extraction_failed" and tables.table(spark, root, "website_intelligence").count() == 0
    sinks.drop_tables(spark, root)
    assert not (tmp_path / "store").exists()
    assert sinks.log_line("fetched", url="u", ms=3) == "fetched | url=u ms=3" and sinks.log_line("done") == "done"


def test_failed_scans(spark):
    scans = spark.createDataFrame([("s1", "in_progress", None, None), ("s2", "completed", 5, None)], "scan_id string, status string, completed_at int, error_summary string")
    failures = spark.createDataFrame([("s1", "first", 1), ("s1", "last", 2)], "scan_id string, message string, failed_at int")
    assert [tuple(r) for r in store.fail_scans(scans, failures).orderBy("scan_id").collect()] == [("s1", "failed", 2, "last"), ("s2", "completed", 5, None)]
    errors = store.error_records(failures.select("scan_id", F.lit("timeout").alias("error_type"), "message", F.lit(None).cast("string").alias("page_url"), F.col("failed_at").alias("created_at"))).collect()
    assert len({r["error_id"] for r in errors}) == 2 and all(r["page_url"] is None for r in errors)


def test_small_scans_are_spread(spark, small):
    assert tables.spread(tables.table(spark, small, "documents")).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
