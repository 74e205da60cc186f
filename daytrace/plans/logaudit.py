"""Queries of the log audit: crash, lock, storage and config audits, order of shutdown, timelines, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.operators import logs
from daytrace.plans.audit import JOB_SQL
from daytrace.plans.registry import query, table

#: Log line of each kind of event: logger, level, message.
_SAID = {
    "click": ("app.lock", "INFO", "event=session_locked"),
    "view": ("app.storage", "INFO", "event=db_open operation=open"),
    "purchase": ("app.config", "INFO", "event=config_loaded endpoint=http://e/ model=m"),
    "error": ("app.crash", "ERROR", "event=crash_exception stage=main error_type=ProgrammingError"),
    "signup": ("app.lock", "WARNING", "event=session_unlocked"),
}
#: Shutdown event of each kind of event.
_ENDS = {"signup": "storage_closed", "error": "shutdown_complete", "purchase": "summary_store", "view": "session_heartbeat_started", "click": "crash_monitor_finalize_start"}


def _log(spark: SparkSession, sf_dir: str, lines: dict[str, tuple[str, str, str]], more=None) -> DataFrame:
    """Events as parsed log entries, a log file per user."""
    said = F.lit("2024-01-01 00:00:00 [INFO] app.other: event=other")
    for kind, (logger, level, message) in lines.items():
        said = F.when(F.col("event_type") == kind, f"2024-01-01 00:00:00 [{level}] {logger}: {message}").otherwise(said)
    line = said if more is None else F.concat(said, more)
    return logs.parse(logs.records(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("line_no"), line.alias("line"))))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, _SAID)


N = "count(*) FILTER (event_type = '{}')"


@query("crash_audits", """
SELECT CAST(user_id AS VARCHAR) AS source_file, count(*) FILTER (event_type = 'error') AS crash_events, count(*) FILTER (event_type = 'error') AS unhandled_exceptions, count(*) FILTER (event_type = 'error') > 0 AS evidence_available,
 true AS instrumentation_gap FROM events GROUP BY user_id""")
def crash_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash audit of each log."""
    return logs.crash_audit(_audited(spark, sf_dir), ["source_file"]).select("source_file", "crash_events", "unhandled_exceptions", "evidence_available", "instrumentation_gap")


@query("crash_stages", "SELECT 'main' AS stage, count(*) AS n FROM events WHERE event_type = 'error' HAVING count(*) > 0")
def crash_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash entries by stage."""
    return logs.crash_stages(_audited(spark, sf_dir))


@query("lock_audits", """
WITH l AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS session_locked, count(*) FILTER (event_type = 'signup') AS session_unlocked FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS source_file, session_locked, session_unlocked, session_locked + session_unlocked > 0 AS gate_observable, CASE WHEN session_locked + session_unlocked = 0 THEN 2 ELSE 1 END AS n_contradictions FROM l""")
def lock_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock audit of each log."""
    return logs.lock_audit(_audited(spark, sf_dir), ["source_file"]).select("source_file", "session_locked", "session_unlocked", "gate_observable", F.size("contradictions").alias("n_contradictions"))


@query("storage_audits", """
SELECT CAST(user_id AS VARCHAR) AS source_file, count(*) FILTER (event_type = 'view') AS storage_events, count(*) FILTER (event_type = 'view') AS db_open_events, count(*) FILTER (event_type = 'error') AS db_errors, false AS startup_recovery_seen FROM events GROUP BY user_id""")
def storage_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage audit of each log."""
    return logs.storage_audit(_audited(spark, sf_dir), ["source_file"]).select("source_file", "storage_events", "db_open_events", "db_errors", "startup_recovery_seen")


@query("storage_operations", "SELECT CAST(user_id AS VARCHAR) AS source_file, 'open' AS operation, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id")
def storage_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage entries by operation."""
    return logs.storage_operations(_audited(spark, sf_dir), ["source_file"])


@query("config_audits", """
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS source_file, n AS config_events, CASE WHEN n > 0 THEN 'http://e/' ELSE '' END AS endpoints, CASE WHEN n > 0 THEN 'm' ELSE '' END AS models, n = 0 AS config_instrumentation_gap FROM c""")
def config_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config audit of each log."""
    c = logs.config_audit(_audited(spark, sf_dir), ["source_file"])
    return c.select("source_file", "config_events", F.array_join("endpoints", ",").alias("endpoints"), F.array_join("models", ",").alias("models"), "config_instrumentation_gap")


@query("log_timeline", "SELECT CAST(user_id AS VARCHAR) AS source_file, event_id AS line_start, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level FROM events WHERE event_type IN ('error', 'signup', 'view')")
def log_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and worse, and the opening of databases, in reading order."""
    return logs.timeline(_audited(spark, sf_dir), ["db_open"]).select("pos.source_file", "pos.line_start", "level")


@query("order_violations", """
WITH a AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS closed, count(*) FILTER (event_type = 'error') AS done, min(event_id) FILTER (event_type = 'click') AS fin, max(event_id) FILTER (event_type = 'purchase') AS written, max(event_id) FILTER (event_type = 'view') AS beat FROM events GROUP BY user_id),
v AS (SELECT user_id, 'shutdown_storage_ordering_violation' AS type, 'Critical' AS severity FROM a WHERE written > closed
UNION ALL SELECT user_id, 'missing_summary_workers_joined', 'High' FROM a WHERE done > 0 UNION ALL SELECT user_id, 'missing_crash_finalization_marker', 'High' FROM a WHERE done > 0 UNION ALL SELECT user_id, 'heartbeat_after_finalize_start', 'High' FROM a WHERE beat > fin
UNION ALL SELECT DISTINCT user_id, 'lmstudio_request_id_reused_across_jobs', 'Medium' FROM (SELECT user_id FROM events WHERE event_type IN ('signup', 'error', 'purchase', 'view', 'click') GROUP BY user_id, event_id % 5 HAVING min(event_id % 3) < max(event_id % 3)))
SELECT CAST(user_id AS VARCHAR) AS source_file, type, severity FROM v""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the order of shutdown and reused request ids in each log."""
    lines = {kind: ("app.main", "INFO", f"event={name}") for kind, name in _ENDS.items()}
    ids = F.when(F.col("event_type").isin(list(_ENDS)), F.concat(F.lit(" lm_request_id=r"), (F.col("event_id") % 5).cast("string"), F.lit(" summary_job_id=j"), (F.col("event_id") % 3).cast("string"))).otherwise("")
    return logs.order_violations(_log(spark, sf_dir, lines, ids), ["source_file"])


@query("log_quality", """
WITH c AS (SELECT conv_id, count(*) AS total, count(*) FILTER (role IN ('user', 'assistant')) AS parsed FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS source_file, CASE WHEN parsed / total::DOUBLE >= 0.999 THEN 'excellent' WHEN parsed / total::DOUBLE >= 0.98 THEN 'good' WHEN parsed / total::DOUBLE >= 0.90 THEN 'fair' ELSE 'poor' END AS quality FROM c""")
def log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much of each log's lines became entries; turns of users and assistants are entries."""
    line = F.when(F.col("role").isin("user", "assistant"), F.concat(F.lit("2024-01-01 00:00:00 [INFO] app: said "), F.col("turn").cast("string"))).otherwise("a loose line")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("line_no"), line.alias("line"))
    total = lines.groupBy("source_file").agg(F.count("*").alias("total"))
    parsed = logs.records(lines).groupBy("source_file").agg(F.count("*").alias("parsed"))
    return total.join(parsed, "source_file", "left").select("source_file", logs.parsing_quality(F.coalesce("parsed", F.lit(0)), F.col("total")).alias("quality"))


_JOB = {"click": "event=job_created job_type=day_summary", "purchase": "event=request_submit timeout_s=50.5", "error": "event=http_response status=error error_type=Timeout", "view": "event=http_response status=ok", "signup": "event=job_completed"}


@query("queue_alignment", JOB_SQL + """, j AS (SELECT user_id, bool_or(event_type = 'click') AND NOT bool_or(event_type = 'signup') AS stalled FROM events GROUP BY user_id)
SELECT 'j' || user_id AS job_id, stalled, EXISTS (SELECT 1 FROM r WHERE r.user_id = j.user_id AND r.outcome = 'error') AS failed_request FROM j""")
def queue_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that never ended and jobs with failed requests."""
    lines = {kind: ("app.client", "INFO", told) for kind, told in _JOB.items()}
    e = _log(spark, sf_dir, lines, F.concat(F.lit(" job_id=j"), F.col("user_id").cast("string")))
    return logs.queue_alignment(logs.job_lifecycles(e), logs.requests(e))


@query("missing_signals", """
SELECT array_to_string(list_filter([CASE WHEN count(*) FILTER (event_type IN ('click', 'signup')) = 0 THEN 'no lock/unlock events' END, 'no screenshot captures', 'no text segment finalization'], lambda x: x IS NOT NULL), '; ') AS missing FROM events""")
def missing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the logs lack altogether."""
    e = _audited(spark, sf_dir)
    return logs.missing_signals(logs.lock_audit(e), logs.capture_audit(e)).select(F.array_join("missing", "; ").alias("missing"))


_SHOTS = {"click": ("app.capture", "INFO", "event=screenshot_skipped reason="), "purchase": ("app.capture", "INFO", "event=screenshot_dedup_keep reason="), "signup": ("app.services", "INFO", "event=monitoring_state_change active="), "error": ("app.services", "WARNING", "event=monitoring_paused_by_lock by=")}


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a capture log, with the hour's place in its half day as reason, none at noon and midnight."""
    hour = F.hour("ts") % 12
    return _log(spark, sf_dir, _SHOTS, F.when(hour > 0, F.concat(F.lit("r"), hour.cast("string"))).otherwise(""))


@query("dedup_reasons", """
SELECT CASE event_type WHEN 'click' THEN 'skip' ELSE 'keep' END AS decision, CASE WHEN hour(ts) % 12 = 0 THEN 'unknown' ELSE 'r' || (hour(ts) % 12) END AS reason, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2""")
def dedup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of skipped and kept screenshots."""
    return logs.dedup_summary(_shots(spark, sf_dir))


@query("filter_analysis", "SELECT count(*) FILTER (event_type = 'signup') AS monitoring_state_changes, count(*) FILTER (event_type = 'error') > 0 AS lock_admission_visible, false AS known_gate FROM events")
def filter_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log shows of the filter on the foreground."""
    return logs.filter_analysis(_shots(spark, sf_dir))


@query("crash_dumps", """
WITH c AS (SELECT conv_id, min(turn) FILTER (turn % 4 = 1) AS t1, count(*) FILTER (turn % 4 = 1) AS thread_count, count(*) FILTER (turn % 4 = 0) AS heads, count(*) FILTER (turn % 4 = 3) AS told FROM conversations GROUP BY conv_id)
SELECT CAST(c.conv_id AS VARCHAR) AS source_file, CAST(thread_count AS INT) AS thread_count, CAST(length(f.text) AS INT) AS top_line, CASE WHEN told > 0 AND c.conv_id % 2 = 0 THEN 'High' ELSE 'Low' END AS confidence
FROM c LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = t1 + 1 WHERE heads > 0""")
def crash_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps with their threads and first frame, and whether the main log knows their session (of even ones)."""
    c = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 4
    line = F.when(kind == 0, "Fatal Python error: Aborted").when(kind == 1, "Current thread 0x00ab (most recent call first):").when(
        kind == 2, F.concat(F.lit('  File "a.py", line '), F.char_length("text").cast("string"), F.lit(" in run"))).otherwise(F.concat(F.lit("session_id=s"), F.col("conv_id").cast("string")))
    dumps = logs.crash_dumps(c.select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("line_no"), line.alias("line")))
    known = c.where("conv_id % 2 = 0").select(F.create_map(F.lit("session_id"), F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("fields"))
    return logs.correlate_crashes(dumps, known).select("source_file", F.col("thread_count").cast("int").alias("thread_count"), F.col("top_frame.line").alias("top_line"), "confidence")
