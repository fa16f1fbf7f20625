"""The pipeline from requests or fetched pages to stored, grounded intelligence, and the reads of the API."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.constants import setting
from webloom.functions import urls
from webloom.operators import chunks as chunking
from webloom.operators import intelligence as intel
from webloom.operators import pages as paging
from webloom.operators import store
from webloom.sources import http
from webloom.sources.sinks import log_line
from webloom.sources.tables import cut_table

LOG = logging.getLogger("webloom")
FAILURES = {"timeout": "The homepage did not answer in time.", "blocked": "The site refused the request.", "website_unreachable": "The homepage could not be read.", "no_pages_found": "The homepage links to no page of the site.", "ai_extraction_failed": "No valid intelligence was extracted."}


class Engine:
    """Scans as DataFrames: one row a request, page, chunk or reply; failures are rows with a status.

    ``client(system, prompt)``, or ``client(system, prompt, options)``, answers prompts on the
    workers; without it, pass a table of replies to ``scan``.
    """

    def __init__(self, spark: SparkSession, client: Callable | None = None):
        self.spark, self.client = spark, client

    def check_requests(self, requests: DataFrame, received: str = "received_at") -> DataFrame:
        """Requests ``companyId, websiteUrl, domain, options`` with ``scan_id, url, domain, max_pages, error_type, message, field, response``.

        The first failing rule is reported: company, callback, pages, then the address and the
        domain's match; ``field`` names what is wrong.  Each request has a scan_id of its own, made
        of company, address and the time ``received``; a request delivered twice keeps it.
        Requests without that column are taken as received now, so write the result before reading it twice.
        """
        address = urls.normalize(F.col("websiteUrl"), setting(self.spark, "MAX_URL_LENGTH"), ipv6=True)
        at = F.col(received) if received in requests.columns else F.current_timestamp()
        checked = requests.withColumn("n", address).withColumn("at", at)
        pages, domain = F.col("options.maxPages"), F.col("domain")
        company, callback = store.company_error(F.col("companyId")), store.callback_error(F.col("options.callbackUrl"))
        mismatch = domain.isNotNull() & ~urls.domains_match(domain, F.col("n.domain"))
        rules = [
            ("invalid_input", "companyId", company),
            ("invalid_input", "callbackUrl", callback),
            ("invalid_input", "maxPages", F.when(~pages.between(1, 50), "maxPages must be from 1 to 50")),
            ("invalid_url", "websiteUrl", F.when(~F.col("n.is_valid"), F.col("n.error_reason"))),
            ("domain_mismatch", "domain", F.when(mismatch, "The domain doesn't match the website's address.")),
        ]
        first = F.coalesce(*[F.when(message.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), message.alias("message"))) for kind, field, message in rules])
        limit = F.lit(setting(self.spark, "MAX_PAGES_PER_SCAN"))
        rows = checked.withColumn("e", first).withColumn("scan_id", store.row_id("scan", "companyId", "websiteUrl", "at"))
        e = F.col("e")
        refused = store.envelope(companyId=F.trim("companyId"), status=F.lit("error"), errorType=e["kind"], message=e["message"], retryable=F.lit(False), details=F.struct(e["field"].alias("field")))
        accepted = store.envelope(companyId=F.trim("companyId"), scanId=F.col("scan_id"), status=F.lit("in_progress"), startedAt=F.col("at"))
        return rows.select(
            F.trim("companyId").alias("company_id"), "scan_id", F.col("n.url").alias("url"), F.col("n.domain").alias("domain"), F.least(F.coalesce(pages, limit), limit).alias("max_pages"), F.col("options.forceRescan").alias("force_rescan"),
            F.col("at").alias("started_at"), e["kind"].alias("error_type"), e["message"].alias("message"), e["field"].alias("field"), F.when(e.isNull(), accepted).otherwise(refused).alias("response"),
        )

    def start(self, requests: DataFrame, scans: DataFrame | None = None, fresh: str = "1 day") -> dict[str, DataFrame]:
        """Runs requests end to end: homepages, their links, the linked pages, and all stages of ``scan``.

        Returns the tables of ``scan`` with ``requests`` (checked, with their responses) and
        ``fetched``.  Where ``scans`` (company_id, website_url, status, completed_at) holds a scan of
        the same company and address completed within ``fresh``, a request without forceRescan is
        answered but not run.  An address is fetched once however many scans ask for it.
        """
        checked = cut_table(self.check_requests(requests))
        asked = checked.where("error_type is null").dropDuplicates(["scan_id"])
        if scans is not None:
            recent = scans.where((F.col("status") == "completed") & (F.col("completed_at") >= F.current_timestamp() - F.expr(f"INTERVAL {fresh}"))).select("company_id", F.col("website_url").alias("url")).distinct()
            forced = F.coalesce("force_rescan", F.lit(False))
            asked = asked.where(forced).unionByName(asked.where(~forced).join(recent, ["company_id", "url"], "left_anti"))
        asked = asked.select("scan_id", "company_id", "url", "max_pages", "started_at", F.col("url").alias("website_url"), "domain")
        home = cut_table(self._fetch(asked.withColumn("page_ord", F.lit(0))))
        parsed_home = cut_table(paging.parse_pages(home))
        most = setting(self.spark, "MAX_PAGES_PER_SCAN")
        linked = paging.discover_links(home.where(paging.is_ok(F.col("status"))), most=most, parsed=parsed_home).select("fetch_id", F.col("rank").alias("page_ord"), F.col("url").alias("page"))
        wanted = home.join(linked.withColumnRenamed("page_ord", "n"), "fetch_id").where(F.col("n") <= F.col("max_pages"))
        others = cut_table(self._fetch(wanted.select("scan_id", "company_id", F.col("page").alias("url"), "max_pages", "started_at", "website_url", "domain", F.col("n").alias("page_ord"))))
        fetched = home.unionByName(others)
        out = self.scan(fetched, parsed=parsed_home.unionByName(cut_table(paging.parse_pages(others))))
        LOG.info(log_line("scans_started", requests=checked.count(), fetched=fetched.count()))
        return out | {"requests": checked, "fetched": fetched}

    def _fetch(self, pages: DataFrame) -> DataFrame:
        """``pages`` with a fetch_id and the fetch result of their url; each host is asked by one worker at a time."""
        largest = setting(self.spark, "MAX_CONTENT_SIZE_BYTES")
        addresses = pages.select("url").distinct().repartition(urls.host(F.col("url")))
        answers = paging.fetch_rows(http.fetch_responses(addresses, timeout=setting(self.spark, "REQUEST_TIMEOUT_SECONDS"), largest=largest), largest=largest)
        return pages.withColumn("fetch_id", store.row_id("fetch", "scan_id", "page_ord")).join(answers, "url")

    def scan(self, fetched: DataFrame, replies: DataFrame | None = None, parsed: DataFrame | None = None) -> dict[str, DataFrame]:
        """Runs all stages over ``fetched(scan_id, company_id, fetch_id, page_ord, url, final_url, status, html, ...)``.

        page_ord 0 is the homepage; pages beyond ``max_pages``, where fetched has it, are left out.
        Each page is parsed once and each context's model is asked once while its reply is valid;
        both results are written before they are read.  Of pages of one scan and address the last
        is read.  Returns the tables pages, links, chunks, contexts, intelligence and scans; a scan
        whose homepage failed has no intelligence, nor one without any page but its homepage.
        """
        if "max_pages" in fetched.columns:
            fetched = fetched.where((F.col("page_ord") <= F.col("max_pages")) | F.col("max_pages").isNull())
        carried = [c for c in ("started_at", "website_url", "domain") if c in fetched.columns]
        keys = fetched.select("fetch_id", "scan_id", "company_id", "page_ord", *carried).dropDuplicates(["fetch_id"])
        parsed = cut_table(paging.parse_pages(fetched)) if parsed is None else parsed
        pages = cut_table(paging.extract(fetched, parsed=parsed).join(keys, "fetch_id"))
        homes = fetched.where("page_ord = 0")
        links = paging.discover_links(homes, most=setting(self.spark, "MAX_PAGES_PER_SCAN"), parsed=parsed.join(homes.select("fetch_id").distinct(), "fetch_id", "left_semi")).join(keys, "fetch_id").select("scan_id", "rank", "url", "score")
        ok = pages.where(paging.is_ok(F.col("fetch_status")))
        last = ok.groupBy("scan_id", F.col("url").alias("page_url")).agg(F.max_by(F.struct("company_id", "page_type", "title", "clean_text", "page_ord"), F.struct("page_ord", "fetch_id")).alias("p"))
        kept = last.select("scan_id", "page_url", "p.*")
        size, overlap = setting(self.spark, "CHUNK_SIZE_TOKENS"), setting(self.spark, "CHUNK_OVERLAP_TOKENS")
        # chunks carry the scan's id through the company column and get their company back by it
        chunks = chunking.chunk_pages(kept.withColumn("company_id", F.col("scan_id")), size, overlap).withColumnRenamed("company_id", "scan_id")
        chunks = cut_table(chunks.join(kept.select("scan_id", "page_url", "page_ord", "company_id"), ["scan_id", "page_url"]))
        # a scan that fails before the model is asked asks nothing
        counts = pages.groupBy("scan_id", "company_id").agg(
            F.sum(paging.is_ok(F.col("fetch_status")).cast("int")).alias("pages_scanned"),
            F.sum((~paging.is_ok(F.col("fetch_status"))).cast("int")).alias("pages_failed"),
            F.max(F.when(F.col("page_ord") == 0, F.col("fetch_status"))).alias("home_status"),
            F.max("page_ord").alias("last_page"), *[F.first(c, True).alias(c) for c in carried],
        )
        failure = F.when(F.col("home_status").isin("timeout", "blocked"), F.col("home_status")).when(F.col("home_status").isNull() | ~paging.is_ok(F.col("home_status")), "website_unreachable").when(F.col("last_page") == 0, "no_pages_found")
        counts = cut_table(counts.withColumn("failure", failure))
        selected = chunking.select_context(chunks.join(counts.where("failure is null").select("scan_id"), "scan_id", "left_semi"), "scan_id", "page_ord", setting(self.spark, "LLM_MAX_CONTEXT_CHARS"))
        contexts = cut_table(chunking.context_text(selected, "scan_id"))
        if replies is None and self.client is not None:
            replies = intel.ask(contexts, "scan_id", self.client, options={"max_output_tokens": setting(self.spark, "LLM_MAX_OUTPUT_TOKENS")})
        found = cut_table(intel.first_valid(replies, contexts, "scan_id")) if replies is not None else contexts.select("scan_id", F.lit(None).cast(intel.INTELLIGENCE).alias("intelligence"))
        kind = F.coalesce("failure", F.when(F.col("intelligence").isNull(), "ai_extraction_failed"))
        message = F.coalesce(*[F.when(F.col("error_type") == k, m) for k, m in FAILURES.items()])
        scans = counts.join(found, "scan_id", "left").withColumn("error_type", kind).select(
            "scan_id", "company_id", *carried, F.when(F.col("error_type").isNull(), "completed").otherwise("failed").alias("status"), "error_type", message.alias("error_summary"), "pages_scanned", "pages_failed",
            (F.col("pages_scanned") + F.col("pages_failed")).alias("pages_discovered"), F.current_timestamp().alias("completed_at"), intel.extracted_summary(F.col("intelligence")).alias("summary"),
        )
        return {"pages": pages, "links": links, "chunks": chunks, "contexts": contexts, "intelligence": found, "scans": scans}

    def scan_status(self, scans: DataFrame, errors: DataFrame, intelligence: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """One JSON response a scan: ``scan_id, response``, for all scans or for those of ``asked(scan_id)``.

        Counts are given once a scan has ended; the summary only where the company's latest
        intelligence (company_id, scan_id, created_at, intelligence) comes from this scan.  A scan
        that isn't known is answered with scan_not_found.
        """
        newest = store.latest(intelligence, "company_id", "created_at", "scan_id").select("company_id", "scan_id", F.col("intelligence").alias("i"))
        joined = store.last_errors(scans, errors).join(newest, ["company_id", "scan_id"], "left")
        ended, done, bad = F.col("status").isin("completed", "failed"), F.col("status") == "completed", F.col("status") == "failed"
        told = F.coalesce("error_summary", "error_message") if "error_summary" in scans.columns else F.col("error_message")
        response = F.struct(
            F.col("company_id").alias("companyId"), F.col("scan_id").alias("scanId"), "status", F.when(bad, F.col("error_type")).alias("errorType"), F.when(bad, F.coalesce(told, F.lit("The scan failed."))).alias("message"), F.when(bad, F.col("retryable")).alias("retryable"),
            F.when(ended, F.col("pages_scanned")).alias("pagesScanned"), F.when(ended, F.col("pages_failed")).alias("pagesFailed"), F.when(done, intel.extracted_summary(F.col("i"))).alias("extractedDataSummary"), F.col("started_at").alias("startedAt"), F.col("completed_at").alias("completedAt"),
        )
        answered = joined.select("scan_id", F.to_json(response).alias("response"))
        if asked is None:
            return answered
        none = _not_found("scan_not_found", F.concat(F.lit("There is no scan "), F.col("scan_id"), F.lit(".")), scanId=F.col("scan_id"))
        return asked.select("scan_id").distinct().join(answered, "scan_id", "left").select("scan_id", F.coalesce("response", none).alias("response"))

    def intelligence(self, companies: DataFrame, intelligence: DataFrame) -> DataFrame:
        """The latest intelligence of each company, with intelligence_not_found where there is none: ``company_id, intelligence, error_type, response``.

        ``intelligence`` has company_id, scan_id, created_at and either the struct or, as stored,
        ``data`` in JSON, which is checked again.
        """
        known = intel.stored(intelligence) if "intelligence" not in intelligence.columns else intelligence
        newest = store.latest(known.select("company_id", "scan_id", "created_at", "intelligence"), "company_id", "created_at", "scan_id").select("company_id", "intelligence")
        joined = companies.select("company_id").distinct().join(newest, "company_id", "left")
        none = _not_found("intelligence_not_found", F.concat(F.lit("There is no intelligence of company "), F.col("company_id"), F.lit(".")), companyId=F.col("company_id"))
        missing = F.col("intelligence").isNull()
        return joined.withColumn("error_type", F.when(missing, "intelligence_not_found")).withColumn("response", F.when(missing, none).otherwise(F.to_json("intelligence")))

    # the same three under the names of the tool server
    scan_website, get_scan_status, get_website_intelligence = start, scan_status, intelligence


def _not_found(kind: str, message: Column, **ids: Column) -> Column:
    return store.envelope(**ids, status=F.lit("error"), errorType=F.lit(kind), message=message, retryable=F.lit(False))
