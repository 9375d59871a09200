"""Streaming queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import scans
from .registry import query


def stream(t, name: str):
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/{name}*")


@query("str_histogram", "SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return scans.run_available(t.spark, scans.running_histogram(stream(t, "events"), "event_type", "value", 10.0))


@query("str_coverage", 'SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n, sum(event_id % 10)::BIGINT AS total FROM events GROUP BY 1')
def _(t):
    s = stream(t, "events").withColumn("v", F.col("event_id") % 10)
    return scans.run_available(t.spark, scans.running_coverage(s, "user_id", "event_id", "v"))


#: Of each user the first events, up to the first one beyond the range: the rows come in the order of the file.
@query("str_reservoir", "SELECT user_id, event_id FROM events WHERE event_id BETWEEN 100 AND 699 AND user_id IN (SELECT user_id FROM events WHERE event_id > 699) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '-4'), event_id) <= 3")
def _(t):
    return scans.run_available(t.spark, scans.range_samples(stream(t, "events"), "user_id", "event_id", low=100, high=699, size=3, seed=4), mode="append")


#: One batch holds all, so no row is late; the watermark then closes the days that ended before the last hour.
@query("str_windows", """WITH d AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL)
 SELECT start, event_type, n FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    days = scans.run_available(t.spark, scans.windowed_counts(stream(t, "events"), "ts", "event_type"), mode="append")
    return days.withColumn("start", F.col("start").cast("timestamp_ntz"))
