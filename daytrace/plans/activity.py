"""Queries on events and orders: intervals, segments, batches, states, counts and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrace.config import ScreenshotDedupSettings, SegmentSettings
from daytrace.functions.text import normalize_title
from daytrace.operators import dedup, intervals, jobs, logs, reports, segments, typed_text
from daytrace.plans.registry import query, table
from daytrace.plans.sessions import IDLE_S, SEGMENTS_SQL, observations

O = "o AS (SELECT event_id, user_id AS machine, event_type AS app, value, epoch_us(ts) / 1e6 AS ts FROM events)"


@query("interval_runs", f"""
WITH {O}, c AS (SELECT *, CASE WHEN lag(app) OVER w IS DISTINCT FROM app THEN 1 ELSE 0 END AS starts FROM o WINDOW w AS (PARTITION BY machine ORDER BY ts, event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT machine, run, any_value(app) AS app, min(ts) AS start_ts, count(*) AS n FROM r GROUP BY machine, run)
SELECT machine, CAST(run AS BIGINT) AS run, app, start_ts, lead(start_ts) OVER (PARTITION BY machine ORDER BY run) AS end_ts, n FROM s""")
def interval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one app per machine; a run ends where the next starts."""
    return intervals.runs(observations(spark, sf_dir), ["machine"], "ts", ["event_id"], ["app"]).select("machine", "run", "app", "start_ts", "end_ts", "n")


@query("idle_gap_segments", SEGMENTS_SQL + "SELECT machine, CAST(segment AS BIGINT) AS segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, max(ts) - min(ts) AS duration_s FROM s GROUP BY machine, segment")
def idle_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 (idle gap alone)."""
    segs = intervals.idle_segments(observations(spark, sf_dir), ["machine"], "ts", ["event_id"], IDLE_S)
    return segs.groupBy("machine", "segment").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("duration_s"))


@query("segment_dominant", SEGMENTS_SQL + """, c AS (SELECT machine, segment, app, count(*) AS n, min((ts, event_id)) AS first FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY machine, segment ORDER BY n DESC, first) AS k FROM c)
SELECT machine, CAST(segment AS BIGINT) AS segment, app AS dominant_app FROM k WHERE k = 1""")
def segment_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent app of a segment, the one seen first among equals."""
    segs = intervals.idle_segments(observations(spark, sf_dir), ["machine"], "ts", ["event_id"], IDLE_S)
    return segments.dominant(segs, ["machine", "segment"], "app", ["ts", "event_id"], "dominant_app")


@query("batch_prefix", SEGMENTS_SQL + """, d AS (SELECT machine, segment, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_s FROM s GROUP BY machine, segment),
a AS (SELECT *, sum(duration_s) OVER (PARTITION BY machine ORDER BY start_ts, segment ROWS UNBOUNDED PRECEDING) AS acc, sum(duration_s) OVER (PARTITION BY machine) AS whole FROM d)
SELECT machine, CAST(segment AS BIGINT) AS segment, end_ts, round(duration_s, 3) AS duration_s FROM a WHERE acc - duration_s < 18000.0 AND whole >= 18000.0""")
def batch_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First segments of a machine that last five hours together."""
    d = idle_gap_segments(spark, sf_dir)
    out = segments.batch_prefix(d, ["machine"], "duration_s", ["start_ts", "segment"], 18000.0)
    return out.select("machine", "segment", "end_ts", F.round("duration_s", 3).alias("duration_s"))


@query("blocked_split", f"WITH {O} SELECT machine, count(*) FILTER (app IN ('error')) AS blocked, count(*) FILTER (app NOT IN ('error')) AS open FROM o GROUP BY machine")
def blocked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of blocked and of other apps."""
    b = jobs.is_blocked(F.col("app"), ["ERROR"])
    return observations(spark, sf_dir).groupBy("machine").agg(F.count_if(b).alias("blocked"), F.count_if(~b).alias("open"))


@query("overlap_exclusion", SEGMENTS_SQL + """, d AS (SELECT machine, segment, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY machine, segment),
r(a, b) AS (VALUES (1704153600.0, 1704240000.0), (1705000000.0, 1705100000.0))
SELECT machine, CAST(segment AS BIGINT) AS segment FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE start_ts <= b AND a <= end_ts)""")
def overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that touch no reserved range."""
    ranges = spark.createDataFrame([(1704153600.0, 1704240000.0), (1705000000.0, 1705100000.0)], "from_ts double, to_ts double")
    return segments.without_reserved(idle_gap_segments(spark, sf_dir), ranges, F.col("start_ts"), F.col("end_ts")).select("machine", "segment")


@query("contained_purge", SEGMENTS_SQL + """, d AS (SELECT machine, segment, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY machine, segment)
SELECT machine, count(*) AS rest, min(start_ts) AS first_ts FROM d WHERE NOT (start_ts >= 1704153600.0 AND end_ts <= 1705449600.0) GROUP BY machine""")
def contained_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5: what a purge of contained segments leaves."""
    marked = jobs.mark_contained(idle_gap_segments(spark, sf_dir).withColumn("summarized", F.lit(False)), 1704153600.0, 1705449600.0)
    rest = jobs.purged(marked, "start_ts", "end_ts", 1704153600.0, 1705449600.0, F.col("summarized"))
    return rest.groupBy("machine").agg(F.count("*").alias("rest"), F.min("start_ts").alias("first_ts"))


@query("activity_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS machines FROM events GROUP BY 1")
def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: days with events and how many."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("machines"))


@query("status_counts_zero_filled", """
WITH s(status) AS (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) SELECT s.status, count(o.o_orderkey) AS n FROM s LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status""")
def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: orders of every status, those without any too."""
    return jobs.status_counts(table(spark, sf_dir, "orders"), ["F", "O", "P", "X", "Y"], "o_orderstatus")


@query("pending_ranges", """
SELECT 'events' AS "table", count(*) AS n, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM events
UNION ALL SELECT 'orders', count(*), min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)) FROM orders
UNION ALL SELECT 'lineitem', count(*), min(epoch_us(l_shipdate)), max(epoch_us(l_shipdate)) FROM lineitem""")
def pending_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and time range of each table."""
    at = lambda t, c: table(spark, sf_dir, t).select(F.unix_micros(F.col(c).cast("timestamp")).alias("ts"))
    return jobs.ranges({"events": (at("events", "ts"), "ts", None), "orders": (at("orders", "o_orderdate"), "ts", None), "lineitem": (at("lineitem", "l_shipdate"), "ts", None)})


@query("latest_orders", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM k WHERE k = 1""")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each key."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return jobs.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("upsert_customers", """
WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
SELECT c.c_custkey, c.c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN n USING (c_custkey)""")
def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key, one column passed on."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("c_name", F.lit("new"))
    return jobs.upsert(old, new.join(old.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"], keep=["c_name"])


@query("recovered_orders", """
SELECT CASE o_orderstatus WHEN 'P' THEN 'abandoned' WHEN 'O' THEN 'cancelled' ELSE 'completed' END AS status, count(*) AS n, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS ended FROM orders GROUP BY 1""")
def recovered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open work is given up when a run starts."""
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("completed")
    none = F.lit(None).cast("double")
    rows = jobs.recover(table(spark, sf_dir, "orders").select(status.alias("status"), none.alias("finished_at"), none.alias("updated_ts")), 1.0)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("finished_at").alias("ended"))


@query("admission_reasons", """
SELECT CASE WHEN event_type = 'signup' THEN 'bypass' WHEN user_id % 7 = 0 THEN 'gate_disabled' WHEN value IS NULL THEN 'unknown_admits' WHEN value > 50 THEN 'locked' ELSE 'not_locked' END AS admission, count(*) AS n FROM events GROUP BY 1""")
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table of admission."""
    e = table(spark, sf_dir, "events").select((F.col("event_type") == "signup").alias("bypass"), (F.col("user_id") % 7 != 0).alias("gate_enabled"), (F.col("value") > 50).alias("locked"))
    return jobs.may_start(e).groupBy("admission").agg(F.count("*").alias("n"))


@query("state_as_of", f"""
WITH {O}, s AS (SELECT machine, ts, app AS state FROM o WHERE app IN ('error', 'purchase'))
SELECT o.event_id, s.state FROM o ASOF LEFT JOIN s ON o.machine = s.machine AND o.ts >= s.ts""")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state in force at each event."""
    o = observations(spark, sf_dir)
    states = o.where(F.col("app").isin("error", "purchase")).select("machine", "ts", F.col("app").alias("state"))
    return jobs.as_of_state(o.select("event_id", "machine", "ts"), states, ["machine"]).select("event_id", "state")


@query("missing_recap_days", """
WITH d AS (SELECT DISTINCT user_id AS machine, strftime(ts, '%Y-%m-%d') AS day FROM events), p AS (SELECT DISTINCT user_id AS machine, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase')
SELECT machine, day FROM d WHERE day < '2024-01-25' AND NOT EXISTS (SELECT 1 FROM p WHERE p.machine = d.machine AND p.day = d.day)""")
def missing_recap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with events but without a purchase, before a cutoff."""
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return d.select("machine", "day").distinct().where("day < '2024-01-25'").join(d.where("event_type = 'purchase'").select("machine", "day").distinct(), ["machine", "day"], "left_anti")


@query("latency_summary", """
SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90, round(max(value), 6) AS max, round(avg(value), 6) AS mean
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of a value by kind."""
    return logs.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("failure_bursts", """
WITH e AS (SELECT user_id % 10 AS grp, event_id, event_type, epoch_us(date_trunc('hour', ts)) AS hr FROM events WHERE event_type = 'error'),
c AS (SELECT *, CASE WHEN lag(hr) OVER w IS DISTINCT FROM hr THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY grp ORDER BY hr, event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY grp ORDER BY hr, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT grp, min(hr) AS start, max(hr) AS "end", count(*) AS n FROM r GROUP BY grp, run HAVING count(*) > 1""")
def failure_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at the same hour."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 10).alias("grp"), "event_id", F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("at"))
    return logs.failure_bursts(e, ["grp"], ["at", "event_id"], "at", "event_id").select("grp", "start", "end", "n")


@query("log_gap_anomalies", f"""
WITH {O}, d AS (SELECT event_id, machine, ts - lag(ts) OVER (PARTITION BY machine ORDER BY event_id) AS delta_s FROM o)
SELECT event_id, machine, round(delta_s, 3) AS delta_s, CASE WHEN delta_s < 0 THEN 'negative_delta' ELSE 'large_gap' END AS anomaly FROM d WHERE delta_s < 0 OR delta_s > 86400""")
def log_gap_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out of order in reading order, or long after the entry before."""
    out = logs.time_anomalies(observations(spark, sf_dir), "ts", ["event_id"], ["machine"], 86400.0)
    return out.select("event_id", "machine", F.round("delta_s", 3).alias("delta_s"), "anomaly")


@query("lifecycle_first_last", """
SELECT l_orderkey, min(l_shipdate) FILTER (l_returnflag = 'R') AS first_returned, min(l_shipdate) FILTER (l_linestatus = 'O') AS first_open, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_linestatus)) AS last_status, max(l_linenumber) AS attempts FROM lineitem GROUP BY l_orderkey""")
def lifecycle_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First time of each stage and last state per job."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("first_returned"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))).alias("first_open"),
        F.max_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_linestatus")).alias("last_status"), F.max("l_linenumber").alias("attempts"))


@query("write_rate", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS writes FROM events GROUP BY 1")
def write_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per tumbling window."""
    out = jobs.write_rate(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts", "1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "writes")


@query("count_changes", """
WITH b AS (SELECT event_type AS status, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), a AS (SELECT event_type AS status, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT coalesce(a.status, b.status) AS status, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b ON a.status = b.status""")
def count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of counts between two snapshots."""
    e = table(spark, sf_dir, "events")
    n = lambda df: df.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return jobs.count_changes(n(e.where("ts < timestamp_ntz '2024-01-10 00:00:00'")), n(e.where("ts >= timestamp_ntz '2024-01-10 00:00:00'")))


@query("top_k_labels", "SELECT p_brand AS label, CAST(sum(greatest(1, p_size)) AS BIGINT) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 10")
def top_k_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report by weight, ties by first place."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_size").cast("bigint").alias("w"), "p_partkey")
    return reports.rank(rows, ["label"], F.col("w"), ["p_partkey"], 10)


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: customers' windows per machine, with a title of app and number, every eighth a screenshot."""
    o = observations(spark, sf_dir)
    shot = F.col("event_id") % 8 == 0
    return o.select(
        "machine", F.col("ts").alias("start_ts"), (F.col("ts") + F.coalesce(F.abs("value"), F.lit(0.0)) * 60).alias("end_ts"), F.when(shot, "screenshot").otherwise("active_interval").alias("kind"),
        F.col("app").alias("process_name"), F.concat_ws(" ", "app", F.lit("window"), (F.col("event_id") % 5).cast("string")).alias("window_title"), (F.col("app") == "error").alias("blocked"),
        F.when(~shot, F.col("event_id")).alias("active_interval_id"), F.when(shot, F.col("event_id")).alias("screenshot_id"),
        F.when(shot, F.substring(F.sha2(F.col("app"), 256), 1, 16)).alias("fingerprint"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("hotkeys"),
    )


@query("full_segments")
def full_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full segmentation by running context."""
    out = segments.segments(_activity(spark, sf_dir), ["machine"], SegmentSettings(idle_gap_s=IDLE_S, max_duration_s=86400.0))
    return out.select("machine", "segment_id", "start_ts", "end_ts", "observation_count", "closure_reason", "process_name", "is_closed")


#: Screenshots with the halves of their hashes, numbered per machine, and the bits by which two differ.
_SHOT_ROWS = f"""
WITH RECURSIVE {O}, h AS (SELECT machine, event_id AS id, ts, app, substr(sha256(app || '|' || (event_id % 3)), 1, 16) AS h, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) AS nr FROM o),
n AS MATERIALIZED (SELECT machine, id, ts, app, nr, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b FROM h),"""
_SHOT_BITS = "CAST(bit_count(xor(x.a, n.a)) + bit_count(xor(x.b, n.b)) AS INT)"
_SHOT_KEPT = "[]::STRUCT(ts DOUBLE, app VARCHAR, a BIGINT, b BIGINT)[] AS kept"


@query("representative_picks", f"""{_SHOT_ROWS}
r AS (SELECT DISTINCT machine, 0::BIGINT AS nr, NULL::BIGINT AS id, NULL::DOUBLE AS ts, false AS takes, 0 AS picked, {_SHOT_KEPT} FROM n
UNION ALL SELECT machine, nr, id, ts, takes, picked + takes::INT, CASE WHEN takes THEN list_concat([{{'ts': ts, 'app': app, 'a': a, 'b': b}}], kept)[1:8] ELSE kept END FROM (
  SELECT n.machine, n.nr, n.id, n.ts, n.app, n.a, n.b, r.picked, r.kept, r.picked < 20 AND coalesce(n.ts - list_filter(r.kept, lambda x: x.app = n.app AND (n.ts - x.ts >= 86400 OR {_SHOT_BITS} <= 6))[1].ts >= 86400, true) AS takes
  FROM r JOIN n ON n.machine = r.machine AND n.nr = r.nr + 1))
SELECT machine, id, ts FROM r WHERE takes""")
def representative_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenshots of a machine that differ from the last picked."""
    return dedup.representative_screenshots(_shots(spark, sf_dir), ["machine"], ScreenshotDedupSettings(max_selected=20, min_interval_s=86400.0)).select("machine", "id", "ts")


@query("capture_decisions", f"""{_SHOT_ROWS}
r AS (SELECT DISTINCT machine, 0::BIGINT AS nr, NULL::BIGINT AS id, NULL::DOUBLE AS ts, false AS keep, NULL::VARCHAR AS reason, NULL::INT AS distance, CAST(0 AS INT) AS streak, NULL::DOUBLE AS last, {_SHOT_KEPT} FROM n
UNION ALL SELECT machine, nr, id, ts, keep, reason, distance, CASE WHEN NOT keep THEN streak WHEN ts - last < 86400 THEN streak + 1 ELSE 1 END, CASE WHEN keep THEN ts ELSE last END, CASE WHEN keep THEN list_concat([{{'ts': ts, 'app': app, 'a': a, 'b': b}}], kept)[1:8] ELSE kept END FROM (
  SELECT *, distance IS NULL OR distance > 6 OR ts - near_ts >= 86400 AS keep, CASE WHEN distance IS NULL THEN 'new_context' WHEN distance <= 6 AND ts - near_ts < 86400 THEN 'perceptual_duplicate' ELSE 'visual_context_changed' END AS reason FROM (
    SELECT * EXCLUDE (alike), list_min(list_transform(alike, lambda x: x.d)) AS distance, list_filter(alike, lambda x: x.d = list_min(list_transform(alike, lambda y: y.d)))[1].ts AS near_ts FROM (
      SELECT n.*, r.streak, r.last, r.kept, list_transform(list_filter(r.kept, lambda x: x.app = n.app), lambda x: {{'d': {_SHOT_BITS}, 'ts': x.ts}}) AS alike FROM r JOIN n ON n.machine = r.machine AND n.nr = r.nr + 1))))
SELECT machine, id, ts, keep, reason, distance, NULL::DOUBLE AS similarity, streak FROM r WHERE nr > 0""")
def capture_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each screenshot kept or dropped as it comes."""
    return dedup.capture_decisions(_shots(spark, sf_dir), ["machine"], ScreenshotDedupSettings(min_interval_s=86400.0))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    return observations(spark, sf_dir).select(
        "machine", F.col("event_id").alias("id"), "ts", F.col("app").alias("process_name"), F.col("app").alias("window_title"), none.cast("bigint").alias("window_hwnd"), none.cast("bigint").alias("active_interval_id"),
        F.substring(F.sha2(F.concat_ws("|", "app", (F.col("event_id") % 3).cast("string")), 256), 1, 16).alias("perceptual_hash"), none.cast("string").alias("fingerprint"), none.cast("string").alias("exact_hash"))


@query("typed_text", """
WITH t AS (SELECT conv_id, turn, lower(text) AS text, length(text) AS n FROM conversations WHERE text <> '')
SELECT conv_id, 'turn ' || turn AS window_title, text, CAST(n AS INT) AS raw_key_count FROM t""")
def typed_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a conversation typed key by key, a window per turn, rebuilt."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    key = F.when(F.col("ch") == " ", "Key.space").when(F.col("ch") == "\n", "Key.enter").otherwise(F.col("ch"))
    keys = c.select("conv_id", (F.col("turn") * 1e6 + F.col("i") / 10).alias("ts"), F.col("i").alias("id"), key.alias("key"), F.lit("down").alias("event_type"), F.array().cast("array<string>").alias("modifiers"),
                    F.lit("chat").alias("process_name"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("window_title"), F.lit(1).cast("bigint").alias("hwnd"))
    return typed_text.reconstruct(keys, ["conv_id"]).select("conv_id", "window_title", "text", "raw_key_count")


@query("typed_hotkeys", f"""
WITH {O} SELECT machine, ts AS start_ts, CASE WHEN app = 'purchase' THEN '' WHEN app = 'signup' THEN 'S' ELSE substr(app, 1, 1) END AS text, CASE WHEN app = 'purchase' THEN 'CTRL+P' ELSE '' END AS hotkey, CAST(1 AS INT) AS raw_key_count FROM o""")
def typed_hotkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a key in a window of its own: purchases with ctrl, signups with shift; released keys and modifiers do not count."""
    o = observations(spark, sf_dir)
    held = F.when(F.col("app") == "purchase", F.array(F.lit("ctrl"))).when(F.col("app") == "signup", F.array(F.lit("shift"))).otherwise(F.array().cast("array<string>"))
    keys = o.select("machine", "ts", F.col("event_id").alias("id"), F.substring("app", 1, 1).alias("key"), F.lit("down").alias("event_type"), held.alias("modifiers"), F.lit("app").alias("process_name"), F.col("event_id").cast("string").alias("window_title"), F.lit(1).cast("bigint").alias("hwnd"))
    noise = keys.withColumns({"key": F.lit("Key.shift")}).unionByName(keys.withColumn("event_type", F.lit("up")))
    return typed_text.reconstruct(keys.unionByName(noise), ["machine"]).select("machine", "start_ts", "text", F.coalesce(F.get("hotkeys", F.lit(0)), F.lit("")).alias("hotkey"), "raw_key_count")


@query("held_modifiers", f"""
WITH {O}, m AS (SELECT event_id, machine, ts, app FROM o)
SELECT event_id, coalesce(last_value(CASE WHEN app IN ('purchase', 'error') THEN app END IGNORE NULLS) OVER (PARTITION BY machine ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'purchase' AS ctrl_held FROM m""")
def held_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases press ctrl, errors release it; is it held at each event?"""
    o = observations(spark, sf_dir)
    ctrl = F.col("app").isin("purchase", "error")
    events = o.select("machine", F.col("event_id").alias("id"), "ts", F.when(ctrl, "Key.ctrl_l").otherwise("a").alias("key"), F.when(F.col("app") == "error", "up").otherwise("down").alias("event_type"))
    return typed_text.held_modifiers(events, ["machine"]).select(F.col("id").alias("event_id"), F.array_contains("modifiers", "ctrl").alias("ctrl_held"))


@query("normalized_titles", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part""")
def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles in normal form."""
    return table(spark, sf_dir, "part").select("p_partkey", normalize_title(F.col("p_name")).alias("title"))


@query("day_rank_window", f"""
WITH {O} SELECT machine, strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, count(*) AS n, bool_or(app = 'purchase') AS has_purchase FROM o GROUP BY 1, 2""")
def day_rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-days with activity, and whether anything was bought."""
    return observations(spark, sf_dir).groupBy("machine", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.bool_or(F.col("app") == "purchase").alias("has_purchase"))


@query("recent_scan", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def recent_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty rows of each user, a scan with a limit as its feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 20").select("user_id", "event_id")
