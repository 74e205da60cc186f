"""Queries on the events table: one user is one machine, event_type its foreground app."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.operators import intervals
from daytrace.plans.registry import query, table

#: Events of a user are hours apart, so the idle gap is four hours here.
IDLE_S = 4 * 3600.0


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, machine, app, ts in epoch seconds."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("machine"),
        F.col("event_type").alias("app"),
        F.col("value"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
    )


SEGMENTS_SQL = """
WITH o AS (SELECT event_id, user_id AS machine, event_type AS app, epoch_us(ts) / 1e6 AS ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= 14400.0 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts
      FROM o WINDOW w AS (PARTITION BY machine ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
"""


@query(
    "session_day_rollup",
    SEGMENTS_SQL
    + """, seg AS (SELECT machine, segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY ALL)
SELECT strftime(make_timestamp(CAST(floor(start_ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS segments,
       CAST(sum(n) AS BIGINT) AS events, round(sum(end_ts - start_ts), 3) AS active_s
FROM seg GROUP BY 1""",
)
def session_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 (idle gap alone), A3: sessions of each machine rolled up by the day they start on."""
    segs = intervals.idle_segments(observations(spark, sf_dir), ["machine"], "ts", ["event_id"], IDLE_S)
    spans = segs.groupBy("machine", "segment").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    return spans.groupBy(F.date_format(F.timestamp_seconds("start_ts"), "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("segments"), F.sum("n").alias("events"), F.round(F.sum(F.col("end_ts") - F.col("start_ts")), 3).alias("active_s")
    )
