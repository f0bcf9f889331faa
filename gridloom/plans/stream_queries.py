"""Streaming queries, each drained over the events that are there."""

from __future__ import annotations

from gridloom.plans.catalog import query
from gridloom.streaming import jobs


@query("stream_windows", "SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling windows of a day over the event stream."""
    return jobs.drained(jobs.windowed(jobs.event_stream(spark, sf_dir)))


@query("stream_windows_appended", "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT CAST(floor(epoch(start)) AS BIGINT) AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_windows_appended(spark, sf_dir):
    """Windows of a day, each written once, when the watermark has passed its end."""
    return jobs.appended(jobs.windowed(jobs.event_stream(spark, sf_dir)))
