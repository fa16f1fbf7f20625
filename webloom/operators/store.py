"""The crawl store: keyed lookups, latest rows, counters, and writing scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.constants import RETRYABLE_ERRORS
from webloom.functions.text import strip


def row_id(prefix: str, *key: str) -> Column:
    """A stable id from a row's natural key; a retried task makes the same one."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256), 1, 32))


def insert_absent(existing: DataFrame, fresh: DataFrame, key: str, seq: str) -> DataFrame:
    """Existing rows and those fresh ones whose key is new; the first of equal fresh keys wins."""
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*fresh.columns), seq).alias("r")).select("r.*")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns), allowMissingColumns=True)


def rows_of(df: DataFrame, key: str, value, seq: str) -> DataFrame:
    """Rows of one key in insertion order; none for an unknown key."""
    return df.where(F.col(key) == F.lit(value)).orderBy(seq)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by the columns of ``order``."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def attach_pages(chunks: DataFrame, pages: DataFrame, seq: str) -> DataFrame:
    """Chunks with the page_id of their page_url; of pages with one address the last wins, others are left out."""
    last = pages.groupBy("page_url").agg(F.max_by("page_id", seq).alias("page_id"))
    return chunks.join(last, "page_url")


def orphan_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    return chunks.join(pages.select("page_url").distinct(), "page_url", "left_anti")


def scan_counters(scans: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """``scan_id, pages_scanned, pages_failed, pages_discovered`` counted from the rows.

    A page or error delivered twice counts once; an error without page_url is the scan's own.
    """
    scanned = pages.groupBy("scan_id").agg(F.count_distinct("page_id").alias("pages_scanned"))
    failed = errors.where(F.col("page_url").isNotNull()).groupBy("scan_id").agg(F.count_distinct("error_id").alias("pages_failed"))
    joined = scans.select("scan_id").distinct().join(scanned, "scan_id", "left").join(failed, "scan_id", "left").fillna(0)
    return joined.withColumn("pages_discovered", F.col("pages_scanned") + F.col("pages_failed"))


def last_errors(scans: DataFrame, errors: DataFrame) -> DataFrame:
    """Scans with their last error's type and message; a scan without one reads internal_error."""
    last = errors.groupBy("scan_id").agg(F.max_by(F.struct("error_type", "message"), F.struct("created_at", "error_id")).alias("e"))
    joined = scans.join(last, "scan_id", "left")
    kind = F.coalesce(F.col("e.error_type"), F.lit("internal_error"))
    return joined.select(*scans.columns, kind.alias("error_type"), F.col("e.message").alias("error_message"), kind.isin(*RETRYABLE_ERRORS).alias("retryable"))


def page_records(pages: DataFrame) -> DataFrame:
    """Extracted pages as stored pages, ids from scan and address."""
    return pages.select(
        row_id("page", "scan_id", "url").alias("page_id"), "scan_id", "company_id", F.col("url").alias("page_url"), "page_type", F.col("title").alias("page_title"), F.lit(None).cast("int").alias("http_status"), "clean_text",
        F.struct("fetch_status", "meta_description", "headings", "language", "raw_text_length").alias("metadata"),
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks with a page as stored chunks."""
    return chunks.select(row_id("chunk", "page_id", "chunk_index").alias("chunk_id"), "page_id", "company_id", "chunk_index", "text", F.struct("page_url", "page_type", "title").alias("metadata"))


def callback_error(url: Column) -> Column:
    return F.when(url.isNotNull() & ~url.startswith("https://"), "callbackUrl must start with https://")


def company_error(company_id: Column) -> Column:
    return F.when(strip(F.coalesce(company_id, F.lit(""))) == "", "companyId must not be blank")


def envelope(**columns: Column) -> Column:
    """A JSON object of the given columns without null fields."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in columns.items()]))


def fail_scans(scans: DataFrame, failures: DataFrame) -> DataFrame:
    """Scans with those of ``failures(scan_id, message, failed_at)`` set to failed, their message kept as summary."""
    last = failures.groupBy("scan_id").agg(F.max_by(F.struct("message", "failed_at"), "failed_at").alias("f"))
    joined = scans.join(last, "scan_id", "left")
    failed = F.col("f").isNotNull()
    changed = {"status": F.lit("failed"), "completed_at": F.col("f.failed_at"), "error_summary": F.col("f.message")}
    return joined.select(*[F.when(failed, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in scans.columns])


def error_records(failures: DataFrame) -> DataFrame:
    """Scan errors of ``failures(scan_id, error_type, message, page_url, created_at)``; no page_url means the whole scan."""
    return failures.select(row_id("error", "scan_id", "error_type", "message", "page_url", "created_at").alias("error_id"), "scan_id", "error_type", "message", "page_url", "created_at")
