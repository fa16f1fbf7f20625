"""Fetch status, page parsing, classification, extraction and link discovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.constants import DEFAULTS, OK_STATUSES, PAGE_TYPES, RETRYABLE_STATUSES, SIGNAL_WEIGHTS, URL_WEIGHT
from webloom.functions import urls
from webloom.functions.html import page_fields
from webloom.functions.text import has_phrase, keyword_text, let, normal_lines, strip
from webloom.functions.urls import resolve

PARSED = (
    "title string, meta_description string, html_language string, headings array<string>, raw_text string, signal_title string, signal_meta string, "
    "signal_headings string, signal_content string, anchors array<struct<ord:int,href:string,abs_url:string,text:string>>"
)


def status_of(code: Column, redirected: Column) -> Column:
    """The fetch status of an HTTP code; bare redirects and other client errors count as failed."""
    return (
        F.when(code.between(200, 299), F.when(redirected, "redirected").otherwise("success"))
        .when(code.isin(401, 403, 429), "blocked")
        .when(code.isin(404, 410), "not_found")
        .when(code.between(500, 599), "server_error")
        .otherwise("failed")
    )


def is_ok(status: Column) -> Column:
    return status.isin(*OK_STATUSES)


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUSES)


def fetch_rows(responses: DataFrame, largest: int = DEFAULTS["MAX_CONTENT_SIZE_BYTES"]) -> DataFrame:
    """Fetch results from raw responses ``url, final_url, status_code, n_redirects, body, elapsed_ms, error``.

    A response with ``error`` (timeout, or anything else) never reached a page.  Bodies above
    ``largest`` bytes are failed and not kept.
    """
    failed = F.col("error").isNotNull()
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    status = status_of(F.col("status_code"), F.coalesce(F.col("n_redirects"), F.lit(0)) > 0)
    too_large = size > largest
    full = F.when(failed, F.when(F.lower("error").contains("timeout"), "timeout").otherwise("failed")).when(too_large, "failed").otherwise(status)
    reason = (
        F.when(failed, F.col("error"))
        .when(too_large, F.concat(F.lit("Content too large ("), size, F.lit(" bytes).")))
        .when(~is_ok(status), F.concat(F.lit("HTTP "), F.col("status_code"), F.lit(" ("), status, F.lit(").")))
    )
    return responses.select(
        "url",
        F.when(failed, F.col("url")).otherwise(F.col("final_url")).alias("final_url"),
        full.alias("status"),
        F.when(~failed, F.col("status_code")).alias("http_status_code"),
        F.when(~failed & ~too_large & is_ok(status), F.col("body")).alias("html"),
        "elapsed_ms",
        reason.alias("error_reason"),
    )


def parse_pages(fetched: DataFrame, key: str = "fetch_id") -> DataFrame:
    """Parses each page once: ``key`` and the columns of PARSED.

    ``fetched`` has key, url, final_url, status and html.  Only ok fetches with html are parsed;
    a page that can't be parsed gives empty fields; repeated keys are parsed once a row.
    """
    base = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))
    wanted = fetched.where(is_ok(F.col("status")) & (strip(F.coalesce("html", F.lit(""))) != "")).select(F.col(key).alias("k"), base.alias("base"), "html")
    kind = fetched.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, base, source in zip(batch["k"], batch["base"], batch["html"]):
                try:
                    fields = page_fields(source)
                except Exception:  # a broken page is an empty row, not a failed job
                    fields = page_fields("")
                fields["anchors"] = [{"ord": o, "href": h, "abs_url": resolve(base or "", h), "text": t} for o, h, t in fields["anchors"]]
                rows.append({"k": k, **fields})
            yield pd.DataFrame(rows, columns=["k", *(c.split()[0] for c in PARSED.split(", "))])

    return wanted.mapInPandas(run, f"k {kind}, {PARSED}").withColumnRenamed("k", key)


def _best_type(scores: list[tuple[str, Column]]) -> Column:
    """The type of the highest positive score; the first of the table wins ties."""
    ranked = F.array_max(F.array(*[F.struct(score.alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("type")) for k, (name, score) in enumerate(scores)]))
    return F.when(ranked["score"] > 0, ranked["type"])


def url_type(url: Column) -> Column:
    return let(
        keyword_text(F.concat(urls.path(url), F.lit(" "), urls.query(url))),
        lambda text: _best_type([(name, sum((has_phrase(text, p).cast("int") * URL_WEIGHT for p in phrases), F.lit(0))) for name, phrases in PAGE_TYPES.items()]),
    )


def classify(url: Column, title: Column | None = None, headings: Column | None = None, meta: Column | None = None, content: Column | None = None) -> Column:
    """The page type from the URL, else from the page's own words; the URL has the last word.

    Without signals of a page, a page no URL phrase names is unknown.
    """
    address = strip(F.coalesce(url, F.lit("")))
    signals = {name: c for name, c in {"title": title, "headings": headings, "meta": meta, "content": content}.items() if c is not None}
    by_page = F.lit(None).cast("string")
    if signals:

        def scored(s: Column) -> Column:
            scores = [(name, sum((has_phrase(s[signal], p).cast("int") * SIGNAL_WEIGHTS[signal] for p in phrases for signal in signals), F.lit(0))) for name, phrases in PAGE_TYPES.items()]
            return F.coalesce(_best_type(scores), F.when(F.concat(*[s[signal] for signal in signals]) != "", "general"))

        by_page = let(F.struct(*[keyword_text(c).alias(name) for name, c in signals.items()]), scored)
    return F.when(~urls.is_absolute(address), "unknown").when(urls.is_homepage(address), "homepage").otherwise(F.coalesce(url_type(address), by_page, F.lit("unknown")))


def extract(fetched: DataFrame, key: str = "fetch_id", parsed: DataFrame | None = None) -> DataFrame:
    """Extracted pages: ``key, url, page_type, title, meta_description, headings, clean_text, raw_text_length, language, fetch_status``.

    Every fetch gives a row; failed and empty ones have null fields, no headings and empty text.
    ``parsed``: rows of parse_pages, where they have been made before.
    """
    parsed = (parse_pages(fetched, key) if parsed is None else parsed).dropDuplicates([key])
    base = fetched.where(F.col(key).isNotNull()).select(key, F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")).alias("url"), F.col("status").alias("fetch_status")).dropDuplicates([key])
    joined = base.join(parsed, key, "left")
    return joined.select(
        key,
        "url",
        classify(F.col("url"), F.col("signal_title"), F.col("signal_headings"), F.col("signal_meta"), F.col("signal_content")).alias("page_type"),
        "title",
        "meta_description",
        F.coalesce("headings", F.array().cast("array<string>")).alias("headings"),
        F.coalesce(normal_lines(F.col("raw_text")), F.lit("")).alias("clean_text"),
        F.coalesce(F.length("raw_text"), F.lit(0)).alias("raw_text_length"),
        F.col("html_language").alias("language"),
        "fetch_status",
    )


def discover_links(fetched: DataFrame, key: str = "fetch_id", most: int = DEFAULTS["MAX_PAGES_PER_SCAN"], parsed: DataFrame | None = None) -> DataFrame:
    """The best internal links of each page: ``key, rank, url, score``.

    Links of other sites, the page itself, files and pages behind forms are left out; each
    address counts once with its best score; ties are in the order of addresses.  ``parsed``: rows
    of parse_pages, where they have been made before.
    """
    parsed = (parse_pages(fetched, key) if parsed is None else parsed).dropDuplicates([key]).select(key, "anchors")
    base = fetched.select(key, F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")).alias("base")).dropDuplicates([key])
    anchors = parsed.join(base, key).select(key, urls.canonical(F.col("base")).alias("home"), urls.site(F.col("base")).alias("site"), F.inline("anchors"))
    supported = anchors.where(urls.is_supported_href(F.col("href")) & F.col("home").isNotNull() & (F.col("site") != ""))
    # the address is read by every rule below; a generator has it computed once
    links = supported.select(key, "home", "site", "text", F.explode(F.array(urls.canonical(F.col("abs_url")))).alias("url"))
    links = links.where(F.col("url").isNotNull() & (urls.site(F.col("url")) == F.col("site")) & (F.col("url") != F.col("home")) & ~urls.is_irrelevant(F.col("url")))
    best = links.groupBy(key, "url").agg(F.max(urls.relevance(F.col("url"), F.col("text"))).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "url")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "rank", "url", "score")
