"""Structured logs: multi-line records, key=value fields, signatures, lifecycles, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.functions.text import bound

#: Formats of the log (fixed values).
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[([A-Z]+)\] ([^:]+): (.*)$"
TAG = r"^\[([A-Z]+)\]\s*(.*)$"
FIELD = r"([A-Za-z_][A-Za-z0-9_.-]*)=(.*?)(?=\s+[A-Za-z_][A-Za-z0-9_.-]*=|$)"
EXCEPTION = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_.]*):.*$"
CRASH_HEADER = r"^(?:Windows fatal exception|Fatal Python error):.*$"
CRASH_THREAD = r"^(Current thread|Thread) 0x([0-9a-fA-F]+) \(most recent call first\):$"
CRASH_FRAME = r'^\s+File "([^"]+)", line (\d+) in (.*)$'
#: Masks of a signature, in the order in which they apply.
MASKS = [
    (r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", "<ts>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b0x[0-9a-fA-F]+\b", "<addr>"),
    (r"\b[A-Za-z]:\\(?:[^\\\s]+\\)*[^\\\s]*\b", "<path>"),
    (r"(?<!\w)/(?:[^/\s]+/)*[^/\s]+", "<path>"),
    (r"\s+", " "),
    (r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])", "<num>"),
]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
PATH_FIELDS = ["app_data_dir", "config_path", "db_path", "endpoint", "error", "file", "file_path"]
# fixed values: event names of each stage
STARTED = ["job_started", "summary_job_started", "daily_summary_job_started"]
SUBMITTED = ["request_submit", "http_request"]
COMPLETED = ["job_completed", "summary_job_completed", "daily_summary_job_completed", "daily_summary_job_reconciled"]
FAILED = ["job_failed", "summary_job_failed"]
CANCELLED = ["job_cancelled", "summary_job_cancelled", "daily_summary_job_cancelled"]
SERVICES = {"Keyboard capture": "keyboard_capture", "Screenshot capture": "screenshot_capture", "Text reconstruction": "text_reconstruction"}


def numbered_lines(files: DataFrame) -> DataFrame:
    """(source_file, line_no from 1, line) of whole files (source_file, value); the order of lines is the file's."""
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", "")
    return files.select("source_file", F.posexplode(F.split(body, "\n", -1)).alias("i", "line")).select("source_file", (F.col("i") + 1).alias("line_no"), "line")


def records(lines: DataFrame) -> DataFrame:
    """One row per entry: header fields, line_start, line_end, continuation lines as traceback. Lines before the first header belong to none."""
    w = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_head", F.col("line").rlike(HEADER)).withColumn("_entry", F.sum(F.col("_head").cast("int")).over(w)).where("_entry > 0")
    rest = F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line_no", "line"))))
    one = marked.groupBy("source_file", "_entry").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min_by("line", "line_no").alias("_h"), rest.alias("_rest"))
    part = lambda k: F.regexp_extract("_h", HEADER, k)
    trace = F.rtrim(F.array_join(F.transform("_rest", lambda x: x["line"]), "\n"))
    return one.select(
        "source_file", "line_start", "line_end", F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(2).alias("level"), part(3).alias("logger"),
        part(4).alias("raw"), F.nullif(trace, F.lit("")).alias("traceback"),
    )


def fields_of(message: Column) -> Column:
    """map of key=value fields, the last of equal keys; values run to the next key."""
    key = lambda field: F.substring_index(field, "=", 1)
    pair = lambda field: F.struct(key(field).alias("key"), F.trim(F.substr(field, F.char_length(key(field)) + 2)).alias("value"))
    last = lambda found: F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: key(later) == key(x)))
    return bound(F.regexp_extract_all(message, F.lit(FIELD), 0), lambda found: F.map_from_entries(F.transform(last(found), pair)))


def event_name(message: Column, fields: Column, tag: Column) -> Column:
    """the event field; the stage of tagged or job lines; or a service's start or stop."""
    staged = fields["stage"].isNotNull() & (tag.isNotNull() | fields["job_type"].isNotNull())
    out = F.when(fields["event"].isNotNull(), fields["event"]).when(staged, fields["stage"])
    for words, name in SERVICES.items():
        for verb in ("started", "stopped"):
            out = out.when(message.startswith(f"{words} service {verb}"), f"{name}_{verb}")
    return out


def category(logger: Column, event: Column, tag: Column) -> Column:
    """part of the system, by tag, then event, then logger."""
    event = F.coalesce(event, F.lit(""))
    return (
        F.when(tag == "LLM", "lmstudio").when(tag == "CRASH", "crash")
        .when(event.rlike("^(foreground_window_change|privacy_block_transition|key_capture|text_segment|screenshot_)") | logger.rlike("(keyboard_capture|screenshot_capture|text_reconstructor|window_tracker)$"), "capture")
        .when(event.rlike("^(db_|storage_|purge|cleanup)") | logger.contains("storage"), "storage")
        .when(event.rlike("^(config_|runtime_paths)") | logger.contains("config"), "config")
        .when(event.rlike("^(crash_|faulthandler|previous_run|session_heartbeat|session_finalized)") | logger.contains("crash"), "crash")
        .when(event.rlike("^(session_(un)?locked|monitoring_)"), "lock")
        .when(event.rlike("summary|recap|^job_|^lmstudio_") | logger.rlike("summarizer|semantic_coalescing|lmstudio_embeddings"), "summary")
        .when(logger.rlike("services|scheduler|main"), "lifecycle").when(logger.contains("ui"), "ui").otherwise("other")
    )


def error_class(level: Column, fields: Column, traceback: Column) -> Column:
    """the error_type field, the last exception of a traceback, or the stage of a failed step."""
    found = F.regexp_extract_all(F.coalesce(traceback, F.lit("")), F.lit(EXCEPTION), 1)
    failed = level.isin("ERROR", "CRITICAL") & (fields["status"] == "error")
    return F.coalesce(F.nullif(fields["error_type"], F.lit("")), F.get(F.reverse(found), F.lit(0)), F.when(failed, F.coalesce(fields["stage"], fields["event"], F.lit("error"))))


def masked(c: Column) -> Column:
    for pattern, name in MASKS:
        c = F.regexp_replace(c, pattern, name)
    return F.lower(F.trim(c))


def signature(df: DataFrame) -> Column:
    """category, subsystem, event, masked message, traceback and fields, joined by bars."""
    def value(k: Column, v: Column) -> Column:
        number = v.rlike(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$|^[\d.]+$")
        path = k.isin(PATH_FIELDS) | v.rlike(MASKS[3][0]) | v.rlike(MASKS[4][0])
        return F.when(F.lower(v).isin("true", "false"), "<bool>").when(number, "<num>").when(path, "<path>").when(v.rlike(MASKS[1][0]), "<uuid>").otherwise(masked(v))

    pairs = F.array_sort(F.map_entries("fields"))
    told = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), value(e["key"], e["value"]))), " ")
    return F.array_join(F.filter(F.array("category", "subsystem", F.coalesce("event_name", "level"), masked(F.col("message")), masked(F.coalesce("traceback", F.lit(""))), told), lambda p: p != ""), " | ")


def severity(level: Column, event: Column, klass: Column, traceback: Column) -> Column:
    hard = klass.isin("AttributeError", "ProgrammingError", "RuntimeError", "OSError") & traceback.isNotNull()
    return F.when((level == "CRITICAL") | F.coalesce(hard, F.lit(False)), "Critical").when(level == "ERROR", "High").when(level == "WARNING", "Medium").when(
        event.isin("summary_drain_failed", "session_monitor_start_failed", "session_monitor_registration_failed"), "High").otherwise("Low")


def parse(recs: DataFrame) -> DataFrame:
    """Entries with tag, message, fields, event_name, category, subsystem, error_class, severity and pos (read order)."""

    # each step is bound: a filter on a column of the result would otherwise repeat all steps for each of their uses
    def told(rec: Column, tag: Column, message: Column, fields: Column, event: Column, klass: Column) -> Column:
        subsystem = F.coalesce(F.nullif(F.element_at(F.split(rec["logger"], "[.]"), -1), F.lit("")), F.lit("other"))
        return F.struct(tag.alias("tag"), message.alias("message"), fields.alias("fields"), event.alias("event_name"), category(rec["logger"], event, tag).alias("category"), subsystem.alias("subsystem"),
                        klass.alias("error_class"), severity(rec["level"], event, klass, rec["traceback"]).alias("severity"))

    def named(rec: Column, tag: Column, message: Column, fields: Column) -> Column:
        klass = error_class(rec["level"], fields, rec["traceback"])
        return bound(event_name(message, fields, tag), lambda event: bound(klass, lambda k: told(rec, tag, message, fields, event, k)))

    def read(rec: Column, tag: Column) -> Column:
        message = F.when(tag.isNotNull(), F.regexp_extract(rec["raw"], TAG, 2)).otherwise(rec["raw"])
        return bound(message, lambda m: bound(fields_of(m), lambda fields: named(rec, tag, m, fields)))

    entry = bound(F.struct("level", "logger", "raw", "traceback"), lambda rec: bound(F.nullif(F.regexp_extract(rec["raw"], TAG, 1), F.lit("")), lambda tag: read(rec, tag)))
    return recs.withColumn("_entry", entry).select(*recs.columns, "_entry.*").withColumn("pos", F.struct("source_file", "line_start"))


def counters(events: DataFrame, by: str) -> DataFrame:
    """Entries per level, subsystem, category, message or signature, most frequent first seen first."""
    return events.groupBy(by).agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").drop("first")


def class_spans(events: DataFrame) -> DataFrame:
    """First and last time of each error class."""
    return events.where("error_class is not null").groupBy("error_class").agg(F.min_by("ts", "pos").alias("first_seen"), F.max_by("ts", "pos").alias("last_seen"))


def taxonomy(events: DataFrame, examples: int = 3) -> DataFrame:
    """Warnings and errors by signature: count, first and last time, first examples, worst severity, traceback, class."""
    bad = events.where(F.col("level").isin("WARNING", "ERROR", "CRITICAL"))
    bad = bad.withColumn("signature", signature(bad)).withColumn("_rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
    # a window keeps the first few, so that no signature's entries are gathered
    w = Window.partitionBy("signature", F.pmod(F.xxhash64("pos"), F.lit(64))).orderBy("pos")
    some = bad.select("signature", "pos", "message", F.row_number().over(w).alias("k")).where(F.col("k") <= examples).groupBy("signature").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "message"))), 1, examples).alias("_e"))
    out = bad.groupBy("signature").agg(
        F.count("*").alias("n"), F.min_by("ts", "pos").alias("first_seen"), F.max_by("ts", "pos").alias("last_seen"), F.max("_rank").alias("_rank"),
        F.bool_or(F.col("traceback").isNotNull()).alias("has_traceback"), F.min_by("error_class", F.when(F.col("error_class").isNotNull(), F.col("pos"))).alias("error_class"), F.min_by("subsystem", "pos").alias("subsystem"),
    ).join(some, "signature")
    return out.withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank").cast("int"))).withColumn("examples", F.transform("_e", lambda x: x["message"])).drop("_e", "_rank").orderBy(F.desc("n"), "signature")


def time_anomalies(events: DataFrame, ts: str, order: Sequence[str], keys: Sequence[str] = (), gap_s: float = 600.0) -> DataFrame:
    """Entries before their predecessor in reading order, or more than ``gap_s`` after it."""
    w = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*order)
    out = events.withColumn("delta_s", F.col(ts) - F.lag(ts).over(w))
    return out.withColumn("anomaly", F.when(F.col("delta_s") < 0, "negative_delta").when(F.col("delta_s") > gap_s, "large_gap")).where("anomaly is not null")


def job_lifecycles(events: DataFrame) -> DataFrame:
    """Per job the first time of each stage, first terminal status, most attempts, type and latest target day."""
    e, f = F.col("event_name"), F.col("fields")
    one = events.withColumn("job_id", f["job_id"]).where("job_id is not null and job_id not in ('', 'none')")
    first = lambda names, also=F.lit(True): F.min_by("ts", F.when(e.isin(names) & also, F.col("pos")))
    recovered = (e == "startup_recovery_job") & f["status"].isin("abandoned", "cancelled")
    end = F.when(e.isin(COMPLETED), "completed").when(e.isin(FAILED), "failed").when(e.isin(CANCELLED), "cancelled").when(e == "daily_summary_job_reused", "reused").when(recovered, f["status"])
    return one.groupBy("job_id").agg(
        F.min_by(f["job_type"], F.when(f["job_type"].isNotNull(), F.col("pos"))).alias("job_type"), F.max_by(f["target_day"], F.when(f["target_day"].isNotNull(), F.col("pos"))).alias("target_day"),
        F.max(f["attempt"].try_cast("int")).alias("attempts"), first(["job_created"]).alias("created_at"), first(["job_created", "job_queued"]).alias("queued_at"),
        first(["summary_job_dequeued"]).alias("dequeued_at"), first(STARTED).alias("started_at"), first(SUBMITTED).alias("request_submit_at"),
        F.max_by("ts", F.when(e == "request_success", F.col("pos"))).alias("request_success_at"), first(["response_parse"]).alias("response_parse_at"),
        first(["summary_store"], f["status"] == "start").alias("store_started_at"), first(["summary_store"], f["status"] == "ok").alias("store_finished_at"),
        first(COMPLETED).alias("completed_at"), first(FAILED).alias("failed_at"), F.min_by(end, F.when(end.isNotNull(), F.col("pos"))).alias("terminal_status"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Requests of each job: a submit opens one, later events fill what it lacks; zero and empty count as lacking."""
    e, f = F.col("event_name"), F.col("fields")
    one = events.withColumn("job_id", f["job_id"]).where("job_id is not null and job_id not in ('', 'none')").where(e.isin([*SUBMITTED, "request_success", "http_response", "response_parse"]))
    w = Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # replies before any submit belong to the first request
    one = one.withColumn("request_no", F.greatest(F.lit(1), F.sum(e.isin(SUBMITTED).cast("int")).over(w)))
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("pos")))
    text = lambda name, also=F.lit(True): first(F.when(also, F.nullif(f[name], F.lit(""))))
    number = lambda name, kind: first(F.nullif(f[name].try_cast(kind), F.lit(0).cast(kind)))
    reply = ~e.isin(SUBMITTED)
    failed = f["status"] == "error"
    outcome = F.when((e == "response_parse") & failed, "parse_error").when((e == "http_response") & failed, "error").when(e.isin("http_response", "request_success"), "success")
    return one.groupBy("job_id", "request_no").agg(
        F.min_by("ts", "pos").alias("submitted_at"), text("endpoint").alias("endpoint"), text("model", reply).alias("model"), F.max(f["timeout_s"].try_cast("double")).alias("timeout_s"), number("elapsed_s", "double").alias("elapsed_s"),
        number("http_status", "int").alias("http_status"), text("error_type").alias("error_type"), text("error").alias("error"),
        F.max_by(outcome, F.when(outcome.isNotNull(), F.col("pos"))).alias("outcome"), text("status", reply).alias("parse_status"),
    )


def latency(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, least, median, nearest-rank p90, most and mean of a value, to six places."""
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.min(x), 6).alias("min"), F.round(F.percentile(x, 0.5), 6).alias("median"), F.round(F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{value}`)"), 6).alias("p90"),
        F.round(F.max(x), 6).alias("max"), F.round(F.avg(x), 6).alias("mean"),
    )


def request_audit(reqs: DataFrame) -> DataFrame:
    """One row: totals by outcome and kind of error, models, endpoints."""
    kind = F.col("error_type")
    return reqs.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == "success").alias("success"), F.count_if(F.col("outcome").isin("error", "parse_error")).alias("failure"), F.count_if(kind == "Timeout").alias("timeouts"),
        F.count_if(kind == "ConnectionError").alias("connection_errors"), F.count_if(kind.isin("HTTPError", "LMStudioServiceUnavailableError")).alias("unavailable"),
        F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("endpoint")).alias("endpoints"),
    )


def failure_bursts(reqs: DataFrame, keys: Sequence[str], order: Sequence[str], at: str = "submitted_at", ident: str = "job_id") -> DataFrame:
    """Two or more failures in a row that were submitted at the same time."""
    w = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*order)
    new = F.coalesce((~F.col(at).eqNullSafe(F.lag(at).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    runs = reqs.withColumn("_new", F.when(first, 1).otherwise(new)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(ident).alias("_i")))), lambda x: x["_i"]).alias("ids"))
    return out.where("n > 1").drop("_run")


def queue_audit(jobs: DataFrame) -> DataFrame:
    """One row: jobs, created, terminal, incomplete, stalled; whether a queue stayed open."""
    done = F.coalesce(F.col("terminal_status").isin("completed", "failed", "cancelled", "abandoned"), F.lit(False))
    stalled = F.col("created_at").isNotNull() & F.col("terminal_status").isNull()
    return jobs.agg(F.count("*").alias("jobs"), F.count("created_at").alias("created"), F.count_if(done).alias("terminal"), F.count_if(F.col("terminal_status").isNull()).alias("incomplete"), F.count_if(stalled).alias("stalled"), F.coalesce(F.bool_or(stalled), F.lit(False)).alias("queue_open"))


def duplicate_jobs(jobs: DataFrame) -> DataFrame:
    """Day jobs of the same day."""
    days = jobs.where("job_type = 'day_summary'").groupBy("job_type", "target_day").agg(F.array_sort(F.collect_list("job_id")).alias("job_ids"))
    return days.where(F.size("job_ids") > 1)


def long_running(reqs: DataFrame) -> DataFrame:
    """Requests that took longer than their timeout."""
    return reqs.where(F.col("elapsed_s") > F.col("timeout_s"))


#: Counter of each capture event (fixed values).
CAPTURE = {
    "foreground_window_change": "foreground_changes", "privacy_block_transition": "privacy_transitions", "key_capture_accepted": "key_accepted", "key_capture_skipped": "key_skipped",
    "key_capture_buffer_flushed": "key_flushes", "key_capture_buffer_flush_failed": "key_flush_failed", "text_segment_finalized": "text_segments", "screenshot_captured": "screenshots_captured",
}


def capture_audit(events: DataFrame) -> DataFrame:
    """One row of capture counters."""
    e = F.col("event_name")
    blocked = F.lower(F.trim(F.col("fields")["blocked"])).isin("true", "1", "yes", "on")
    return events.agg(*[F.count_if(e == k).alias(v) for k, v in CAPTURE.items()], F.count_if((e == "foreground_window_change") & blocked).alias("blocked_foreground"))


def reasons(events: DataFrame, event: str, field: str = "reason") -> DataFrame:
    """Histogram of the reasons of an event."""
    return events.where(F.col("event_name") == event).groupBy(F.coalesce(F.nullif(F.col("fields")[field], F.lit("")), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def filter_analysis(events: DataFrame) -> DataFrame:
    """One row: how often monitoring changed, whether locks show in the log, and that no gate is known."""
    e = F.col("event_name")
    return events.agg(
        F.count_if(e == "monitoring_state_change").alias("monitoring_state_changes"),
        F.coalesce(F.bool_or(e.isin("monitoring_paused_by_lock", "monitoring_resumed_after_unlock")), F.lit(False)).alias("lock_admission_visible"), F.lit(False).alias("known_gate"),
    )


def dedup_summary(events: DataFrame) -> DataFrame:
    """(decision, reason, n) of the screenshots that were skipped and kept."""
    told = lambda name, event: reasons(events, event).select(F.lit(name).alias("decision"), "reason", "n")
    return told("skip", "screenshot_skipped").unionByName(told("keep", "screenshot_dedup_keep"))


def timeline(events: DataFrame, also: Sequence[str]) -> DataFrame:
    """Warnings and worse, and the named events, in reading order; messages of at most 320 characters."""
    message = F.replace(F.col("message"), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(message) <= 320, message).otherwise(F.concat(F.substring(message, 1, 317), F.lit("...")))
    return events.where(F.col("level").isin("WARNING", "ERROR", "CRITICAL") | F.col("event_name").isin(list(also))).select("pos", "ts", "level", "logger", "event_name", short.alias("message"), "fields").orderBy("pos")


def order_violations(line: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, one row per kind of violation of the order of shutdown, and for reuse of a request id."""
    e = F.col("event_name")
    at = line.groupBy(*keys).agg(
        *[F.min(F.when(e == n, F.col("pos"))).alias(n) for n in ("storage_closed", "shutdown_complete", "crash_monitor_finalize_start", "summary_workers_joined")],
        F.min(F.when(e.isin("crash_monitor_session_finalized", "crash_monitor_finalize_failed"), F.col("pos"))).alias("finalized"),
        F.max(F.when(e.isin("summary_flush_triggered", "summary_job_started", "summary_store", "lmstudio_request_success"), F.col("pos"))).alias("last_write"),
        F.max(F.when(e == "session_heartbeat_started", F.col("pos"))).alias("last_heartbeat"),
    )
    late = lambda name: F.col("shutdown_complete").isNotNull() & (F.col(name).isNull() | (F.col(name) > F.col("shutdown_complete")))
    kinds = F.array_compact(F.array(
        F.when(F.col("last_write") > F.col("storage_closed"), F.struct(F.lit("shutdown_storage_ordering_violation").alias("type"), F.lit("Critical").alias("severity"))),
        F.when(late("summary_workers_joined"), F.struct(F.lit("missing_summary_workers_joined").alias("type"), F.lit("High").alias("severity"))),
        F.when(late("finalized"), F.struct(F.lit("missing_crash_finalization_marker").alias("type"), F.lit("High").alias("severity"))),
        F.when(F.col("last_heartbeat") > F.col("crash_monitor_finalize_start"), F.struct(F.lit("heartbeat_after_finalize_start").alias("type"), F.lit("High").alias("severity"))),
    ))
    order = at.select(*keys, F.explode(kinds).alias("k")).select(*keys, "k.*")
    f = F.col("fields")
    reused = line.where(f["lm_request_id"].isNotNull() & f["summary_job_id"].isNotNull()).groupBy(*keys, f["lm_request_id"].alias("r")).agg(F.min(f["summary_job_id"]).alias("a"), F.max(f["summary_job_id"]).alias("b")).where("a <> b")
    return order.unionByName(reused.select(*keys, F.lit("lmstudio_request_id_reused_across_jobs").alias("type"), F.lit("Medium").alias("severity")).distinct())


def crash_dumps(lines: DataFrame) -> DataFrame:
    """Per file with a crash header: header, session_id, pid, threads (number, current, frames with file, line, function)."""
    w = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    one = lines.withColumn("_thread", F.col("line").rlike(CRASH_THREAD)).withColumn("thread_no", F.sum(F.col("_thread").cast("int")).over(w))
    part = lambda p, k: F.regexp_extract("line", p, k)
    frame = F.when(F.col("line").rlike(CRASH_FRAME), F.struct("line_no", part(CRASH_FRAME, 1).alias("file"), part(CRASH_FRAME, 2).cast("int").alias("line"), part(CRASH_FRAME, 3).alias("function")))
    threads = one.where("thread_no > 0").groupBy("source_file", "thread_no").agg(F.max(F.when(F.col("_thread"), part(CRASH_THREAD, 2))).alias("thread_id"), F.max(F.when(F.col("_thread"), part(CRASH_THREAD, 1) == "Current thread")).alias("current"), F.array_sort(F.collect_list(frame)).alias("frames"))
    per_file = threads.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("thread_no", "thread_id", "current", "frames"))).alias("threads"))
    last = lambda key: F.max_by(fields_of(F.col("line"))[key], F.when(fields_of(F.col("line"))[key].isNotNull(), F.col("line_no")))
    heads = lines.groupBy("source_file").agg(F.min_by("line", F.when(F.col("line").rlike(CRASH_HEADER), F.col("line_no"))).alias("header"), last("session_id").alias("session_id"), last("pid").try_cast("int").alias("pid")).where("header is not null")
    out = heads.join(per_file, "source_file", "left")
    return out.withColumn("thread_count", F.coalesce(F.size("threads"), F.lit(0))).withColumn("top_frame", F.get(F.get("threads", F.lit(0))["frames"], F.lit(0)))


def correlate_crashes(dumps: DataFrame, events: DataFrame) -> DataFrame:
    """Dumps with the confidence that the log holds their session: by session id, by pid, or not at all."""
    f = F.col("fields")
    ids = events.select(f["session_id"].alias("session_id")).where("session_id is not null").distinct().withColumn("_s", F.lit(True))
    pids = events.select(f["pid"].try_cast("int").alias("pid")).where("pid is not null").distinct().withColumn("_p", F.lit(True))
    both = dumps.join(ids, "session_id", "left").join(pids, "pid", "left")
    return both.withColumn("confidence", F.when(F.col("_s"), "High").when(F.col("_p"), "Medium").otherwise("Low")).withColumn("matched_by", F.when(F.col("_s"), "session_id").when(F.col("_p"), "pid")).drop("_s", "_p")


def parsing_quality(parsed: Column, total: Column) -> Column:
    """how much of a log's lines became entries."""
    share = parsed / F.greatest(total, F.lit(1))
    return F.when(total == 0, "no lines").when(share >= 0.999, "excellent").when(share >= 0.98, "good").when(share >= 0.90, "fair").otherwise("poor")


# fixed values
DATABASE_ERRORS = ["SqlCipherOpenError", "SqlCipherKeyMismatchError", "DatabaseKeyMissingError", "DatabaseKeyCorruptedError", "DatabaseKeyProtectionError", "DatabaseKeyUnprotectError", "ProgrammingError"]
FINALIZED = ["session_finalized", "crash_monitor_session_finalized"]
RUNTIME_PATHS = ["app_data_dir", "log_dir", "screenshot_dir", "db_path", "config_path"]
LOCK_EVENTS = ["session_locked", "session_unlocked", "monitoring_paused_by_lock", "monitoring_resumed_after_unlock"]


def _seen(names: Sequence[str]) -> Column:
    return F.coalesce(F.bool_or(F.col("event_name").isin(list(names))), F.lit(False))


def crash_audit(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, crash entries, unhandled exceptions, failures of the session monitor, and which markers were seen."""
    e, stage = F.col("event_name"), F.col("fields")["stage"]
    crash = F.col("category") == "crash"
    monitor = stage.isin("session_monitor_stop_post_message", "session_monitor_unregister_notification", "session_monitor_unregister_class")
    return events.groupBy(*keys).agg(
        F.count_if(crash).alias("crash_events"), F.count_if(crash & e.isin("crash_exception", "run_protected_exception")).alias("unhandled_exceptions"), F.count_if(crash & monitor).alias("session_monitor_failures"),
        _seen(FINALIZED).alias("clean_finalization_seen"), _seen(["faulthandler_enable", "faulthandler_enabled", "crash_monitor_faulthandler_enabled"]).alias("faulthandler_seen"),
        _seen(["previous_run_check", "previous_run_unexpected_exit"]).alias("previous_unclean_shutdown_seen"), F.coalesce(F.bool_or(crash), F.lit(False)).alias("evidence_available"), (~_seen(FINALIZED)).alias("instrumentation_gap"),
    )


def crash_stages(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Crash entries by stage, or else by event."""
    stage = F.coalesce(F.nullif(F.col("fields")["stage"], F.lit("")), F.nullif(F.col("event_name"), F.lit("")), F.lit("unknown"))
    return events.where("category = 'crash'").groupBy(*keys, stage.alias("stage")).agg(F.count("*").alias("n"))


def lock_audit(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, counts of lock events, changes of monitoring, contradictions, and whether the gate can be observed."""
    e = F.col("event_name")
    out = events.groupBy(*keys).agg(
        *[F.count_if(e == n).alias(n) for n in LOCK_EVENTS], F.count_if(e == "monitoring_state_change").alias("monitoring_state_changes"),
        F.coalesce(F.bool_or(F.col("message").contains("process_backlog_only_while_locked")), F.lit(False)).alias("_flag"))
    none = (F.col("session_locked") == 0) & (F.col("session_unlocked") == 0)
    told = F.array_compact(F.array(F.when(~F.col("_flag"), F.lit("missing_process_backlog_only_while_locked_logging")), F.when(none, F.lit("no_lock_events_observed"))))
    return out.withColumn("contradictions", told).withColumn("gate_observable", ~none).drop("_flag")


def storage_audit(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, storage entries, openings, database errors, write rates, and which steps were seen."""
    e = F.col("event_name")
    return events.groupBy(*keys).agg(
        F.count_if(F.col("category") == "storage").alias("storage_events"), F.count_if(e == "db_open").alias("db_open_events"), F.count_if(F.col("error_class").isin(DATABASE_ERRORS)).alias("db_errors"),
        F.count_if(e == "db_write_rate").alias("write_rate_events"), _seen(["startup_recovery"]).alias("startup_recovery_seen"), _seen(["purge_actions"]).alias("purge_actions_seen"),
        (~_seen(["config_unknown_fields"])).alias("instrumentation_gap"),
    )


def storage_operations(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Storage entries by operation, or else by event."""
    return events.where("category = 'storage' and event_name is not null").groupBy(*keys, F.coalesce(F.col("fields")["operation"], F.col("event_name")).alias("operation")).agg(F.count("*").alias("n"))


def config_audit(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, the paths of the first runtime_paths entry, config entries, endpoints, models and the highest timeout."""
    e, f = F.col("event_name"), F.col("fields")
    first = lambda name: F.min_by(F.nullif(f[name], F.lit("")), F.when(e == "runtime_paths", F.col("pos")))
    config = F.col("category") == "config"
    return events.groupBy(*keys).agg(
        *[first(n).alias(n) for n in RUNTIME_PATHS], F.count_if(config).alias("config_events"), F.array_sort(F.collect_set(F.nullif(f["endpoint"], F.lit("")))).alias("endpoints"), F.array_sort(F.collect_set(F.nullif(f["model"], F.lit("")))).alias("models"),
        F.max(F.when(e == "request_submit", f["timeout_s"].try_cast("double"))).alias("request_timeout_s"), (F.count_if(config) == 0).alias("config_instrumentation_gap"),
    )


def queue_alignment(jobs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Per job whether it is stalled and whether a request of its failed."""
    stalled = F.col("job_type").isin("event_summary", "day_summary") & F.col("terminal_status").isNull()
    failed = reqs.where(F.col("outcome").isin("error", "parse_error")).select("job_id").distinct().withColumn("_f", F.lit(True))
    return jobs.select("job_id", F.coalesce(stalled, F.lit(False)).alias("stalled")).join(failed, "job_id", "left").select("job_id", "stalled", F.coalesce("_f", F.lit(False)).alias("failed_request"))


def missing_signals(locks: DataFrame, capture: DataFrame) -> DataFrame:
    """What a log's lock audit and capture counters lack, of one row each."""
    both = locks.select("session_locked", "session_unlocked").crossJoin(capture.select("screenshots_captured", "text_segments"))
    return both.select(F.array_compact(F.array(
        F.when((F.col("session_locked") == 0) & (F.col("session_unlocked") == 0), "no lock/unlock events"), F.when(F.col("screenshots_captured") == 0, "no screenshot captures"),
        F.when(F.col("text_segments") == 0, "no text segment finalization"))).alias("missing"))


def stage_line(stage: Column, status: Column, job_id: Column, **fields: Column) -> Column:
    """A tagged line of key=value fields, as ``fields_of`` reads it; fields that are null are left out."""
    parts = [F.lit("[LLM]"), F.concat(F.lit("stage="), stage), F.concat(F.lit("status="), status), F.concat(F.lit("job_id="), F.coalesce(job_id.cast("string"), F.lit("none")))]
    return F.concat_ws(" ", *parts, *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()])


def notified(errors: DataFrame, keys: Sequence[str], order: Sequence[str], category: str = "category", message: str = "message", resolved: str = "resolved") -> DataFrame:
    """Errors that are shown: of a category, those whose message is not the active one; a resolved row clears it."""
    w = Window.partitionBy(*keys, category).orderBy(*order)
    last = F.lag(F.struct(message, resolved)).over(w)
    same = F.coalesce(~last[resolved] & last[message].eqNullSafe(F.col(message)), F.lit(False))
    return errors.withColumn("notify", ~F.col(resolved) & ~same)
