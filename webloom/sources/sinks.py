"""Writing scan results, and one format for log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import store
from webloom.sources.tables import cut_table


def write_scan(out: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """Writes the tables of ``Engine.scan`` under ``root``: pages, chunks, intelligence, scans and errors.

    Each table is written once and read back by the next, so nothing is fetched, parsed or asked
    again.  Of pages of one scan and address the last is kept.  Chunks whose page isn't stored are
    left out, as orphan_chunks shows them.
    """
    last = out["pages"].groupBy("scan_id", "url").agg(F.max_by(F.struct(*out["pages"].columns), F.struct("page_ord", "fetch_id")).alias("r")).select("r.*")
    pages = cut_table(store.page_records(last).withColumn("created_at", F.current_timestamp()))
    chunks = out["chunks"].select("scan_id", "company_id", "page_url", "page_type", "title", "chunk_index", "text").join(pages.select("scan_id", "page_url", "page_id"), ["scan_id", "page_url"])
    known = out["intelligence"].where(F.col("intelligence").isNotNull()).join(out["scans"].select("scan_id", "company_id"), "scan_id")
    found = known.select(store.row_id("intelligence", "scan_id").alias("intelligence_id"), "company_id", "scan_id", F.to_json("intelligence").alias("data"), F.current_timestamp().alias("created_at"))
    failed = out["scans"].where("status = 'failed'").select("scan_id", "error_type", F.col("error_summary").alias("message"), F.lit(None).cast("string").alias("page_url"), F.col("completed_at").alias("created_at"))
    missed = out["pages"].where(~F.col("fetch_status").isin("success", "redirected") & (F.col("page_ord") > 0)).select("scan_id", F.col("fetch_status").alias("error_type"), F.concat(F.lit("Page not read: "), F.col("fetch_status")).alias("message"), F.col("url").alias("page_url"), F.current_timestamp().alias("created_at"))
    tables = {"scanned_pages": pages, "content_chunks": store.chunk_records(chunks), "website_intelligence": found, "scan_errors": store.error_records(failed.unionByName(missed)), "website_scans": out["scans"].drop("summary")}
    for name, frame in tables.items():
        frame.write.mode(mode).parquet(f"{root}/{name}.parquet")


def drop_tables(spark: SparkSession, root: str) -> None:
    """Removes all tables under ``root``; for tests."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def log_line(event: str, **fields) -> str:
    """One line of the log: the event, then its fields."""
    return " ".join([event, "|", *(f"{k}={v}" for k, v in fields.items())]) if fields else event
