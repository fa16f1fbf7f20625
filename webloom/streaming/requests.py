"""Scan requests as a stream: checked as they come, one row a scan however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webloom.plans.engine import Engine


def checked_requests(engine: Engine, requests: DataFrame, event_time: str = "received_at", late: str = "1 hour") -> DataFrame:
    """Checked requests of a batch or streaming frame with an event time; repeats within ``late`` are dropped."""
    key = ["companyId", "websiteUrl"]
    timed = requests.withWatermark(event_time, late)
    once = timed.dropDuplicatesWithinWatermark(key) if requests.isStreaming else timed.dropDuplicates(key)
    return engine.check_requests(once)
