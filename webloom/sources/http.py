"""Fetching addresses on the workers; every failure is a row."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from webloom.constants import DEFAULTS

RESPONSES = "url string, final_url string, status_code int, n_redirects int, body string, elapsed_ms int, error string"
AGENT = "webloom/1.0 (website reader)"


def get(url: str, timeout: float, largest: int) -> tuple:
    """One row of RESPONSES for ``url``; redirects are followed and counted, nothing is raised.

    One byte more than ``largest`` is read at most, which is enough to tell that a page is too
    large.
    """
    hops = 0

    class Counting(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            nonlocal hops
            hops += 1
            return super().redirect_request(*args)

    began = time.monotonic()
    spent = lambda: int(round((time.monotonic() - began) * 1000))
    if not url.lower().startswith(("http://", "https://")):
        return url, url, None, hops, None, spent(), "Unsupported scheme."
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        try:
            answer = urllib.request.build_opener(Counting).open(request, timeout=timeout)
        except urllib.error.HTTPError as e:  # an answer as well
            answer = e
        with answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            raw = answer.read(largest + 1)
            try:
                body = raw.decode(charset, errors="replace")
            except LookupError:
                body = raw.decode("utf-8", errors="replace")
            return url, answer.geturl(), answer.getcode(), hops, body, spent(), None
    except TimeoutError:
        return url, url, None, hops, None, spent(), "Timeout."
    except Exception as e:  # no failure ends a scan
        kind = "Timeout." if "timed out" in str(e) else f"{type(e).__name__}: {e}"
        return url, url, None, hops, None, spent(), kind[:300]


def fetch_responses(addresses: DataFrame, timeout: float = DEFAULTS["REQUEST_TIMEOUT_SECONDS"], largest: int = DEFAULTS["MAX_CONTENT_SIZE_BYTES"]) -> DataFrame:
    """Raw responses of ``addresses(url)``, one after another in each partition.

    Partition by host before, where a host must not be asked by several workers at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                yield pd.DataFrame([get(url, timeout, largest)], columns=[c.split()[0] for c in RESPONSES.split(", ")])

    return addresses.select("url").where("url is not null").mapInPandas(run, RESPONSES)
