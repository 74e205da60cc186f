"""Queries of the audit side: reports, filters, bundles, log audits. Tables stand for audit rows by an adapter each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.operators import coalesce, entities, jobs, logs, quality, reports, search
from daytrace.plans.registry import query, table


@query("orphan_files", """
SELECT page_id, url AS path FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND replace(lower(q.url), '/', chr(92)) = replace(lower(p.url), '/', chr(92)))""")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that nothing refers to."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return jobs.orphans(p, p.where("page_id % 3 = 0").select(F.upper("path").alias("file_path")))


@query("admission_skips", """
SELECT CASE WHEN event_type = 'signup' THEN 'monitoring_inactive' WHEN event_type = 'error' THEN 'blocked' WHEN user_id % 11 = 0 THEN 'no_active_interval' WHEN user_id % 2 <> event_id % 2 THEN 'foreground_mismatch' END AS skip_reason, count(*) AS n FROM events GROUP BY 1""")
def admission_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why captures are skipped."""
    e = table(spark, sf_dir, "events").select(
        (F.col("event_type") != "signup").alias("monitoring"), (F.col("event_type") == "error").alias("blocked"), F.when(F.col("user_id") % 11 != 0, F.col("event_id")).alias("interval_id"),
        (F.col("event_id") % 2).alias("hwnd"), (F.col("user_id") % 2).alias("interval_hwnd"), F.lit(1).alias("pid"), F.lit(1).alias("interval_pid"))
    return jobs.admission(e).groupBy("skip_reason").agg(F.count("*").alias("n"))


def _entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("entity_value"), F.lower("p_type").alias("entity_normalized"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("day"), F.col("p_retailprice").alias("start_ts"), (F.col("p_size") % 10 / 10).alias("confidence"))


ENTITY_SQL = "WITH e AS (SELECT p_partkey AS id, p_brand AS entity_type, p_name AS entity_value, lower(p_type) AS entity_normalized, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS day, p_retailprice AS start_ts, (p_size % 10) / 10.0::DOUBLE AS confidence FROM part) "


@query("entity_search", ENTITY_SQL + "SELECT id, day, confidence FROM e WHERE (contains(lower(entity_value), 'e') OR contains(entity_normalized, 'e')) AND day >= '2024-01-05' AND day <= '2024-01-20' AND confidence >= 0.3 ORDER BY day DESC, start_ts DESC, confidence DESC, id DESC LIMIT 200")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the latest entities by text, days and confidence."""
    return entities.search(_entity_rows(spark, sf_dir), query=" E ", first_day="2024-01-05", last_day="2024-01-20", min_confidence=0.3).select("id", "day", "confidence")


@query("low_confidence_entities", ENTITY_SQL + "SELECT entity_type, count(*) AS n, max(confidence) AS surest FROM e WHERE confidence < 0.8 GROUP BY entity_type")
def low_confidence_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure entities by type."""
    return reports.low_confidence(_entity_rows(spark, sf_dir)).groupBy("entity_type").agg(F.count("*").alias("n"), F.max("confidence").alias("surest"))


@query("entity_counts", ENTITY_SQL + "SELECT day, entity_type, count(*) AS n FROM e GROUP BY ALL")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type of each day."""
    return quality.entity_counts(_entity_rows(spark, sf_dir), ["day"]).select("day", F.explode("entity_counts_by_type").alias("entity_type", "n"))


@query("diagnostics_filter", """
SELECT event_id AS id, round(value, 4) AS final_merge_score FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-03' AND event_type = 'click' AND value < 60 AND user_id % 2 = 0 ORDER BY event_id LIMIT 500""")
def diagnostics_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of merge diagnostics of a day by decision, text and score."""
    d = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("decision"), F.when(F.col("user_id") % 2 == 0, F.array(F.lit("gap_too_large"))).otherwise(F.array().cast("array<string>")).alias("blockers"),
        F.array(F.lit("below_min_cosine")).alias("reasons"), F.col("value").alias("final_merge_score"))
    return search.filter_diagnostics(d, day="2024-01-03", decision="click", text=" Gap_too ", below=60.0).select("id", F.round("final_merge_score", 4).alias("final_merge_score"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    part = F.regexp_extract("url", "://[^/?#]*/([a-z]*)", 1)
    return table(spark, sf_dir, "pages").select(
        host.alias("process_name"), host.alias("normalized_process_name"), part.alias("window_title"), part.alias("normalized_window_title"), F.col("page_id").cast("double").alias("start_ts"), F.col("page_id").cast("double").alias("end_ts"),
        F.lit(2).alias("extracted_entity_count"), F.lit(1).alias("unclassified_evidence_count"), F.array(F.regexp_extract("url", "^([a-z]*)", 1)).alias("matched_parser_names"), (F.col("page_id") % 4 / 4).alias("parser_confidence"),
        (F.col("page_id") % 3 != 0).alias("unknown_app"), F.lit(True).alias("used_generic_parser"), (F.col("page_id") % 5 == 0).alias("used_specialized_parser"), F.col("page_id").alias("pos"))


COVERAGE_SQL = "WITH c AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]*)', 1) AS part, regexp_extract(url, '^([a-z]*)', 1) AS scheme, page_id % 3 <> 0 AS unknown, (page_id % 4) / 4.0::DOUBLE AS conf, page_id % 5 = 0 AS special FROM pages) "


@query("unknown_windows", COVERAGE_SQL + "SELECT host AS normalized_process_name, part AS normalized_title_sample, count(*) AS occurrence_count, CAST(min(page_id) AS DOUBLE) AS first_seen_ts, 'No specialized parser matched; generic parsers extracted ' || array_to_string(list_sort(list_distinct(list(scheme))), ', ') || '.' AS suggested_parser_reason FROM c WHERE unknown GROUP BY host, part")
def unknown_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown windows by process and title."""
    return reports.unknown_windows(_coverage(spark, sf_dir)).select("normalized_process_name", "normalized_title_sample", "occurrence_count", "first_seen_ts", "suggested_parser_reason")


@query("parser_coverage", COVERAGE_SQL + "SELECT host AS normalized_process_name, count(*) AS occurrence_count, count(*) FILTER (unknown) AS unknown_app_count, count(*) FILTER (special) AS used_specialized_parser_count FROM c GROUP BY host ORDER BY occurrence_count DESC, host LIMIT 25")
def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the parsers used per process."""
    return reports.coverage_by_process(_coverage(spark, sf_dir)).select("normalized_process_name", "occurrence_count", "unknown_app_count", "used_specialized_parser_count")


@query("top_unknown", COVERAGE_SQL + "SELECT host AS label, CAST(count(*) AS BIGINT) AS n FROM c WHERE unknown GROUP BY host ORDER BY n DESC, host LIMIT 5")
def top_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report of unknown processes, from coverage where there is no rollup."""
    c = _coverage(spark, sf_dir)
    return reports.top_unknown(reports.unknown_apps(c.where("false")), c)


@query("occurrence_sum", COVERAGE_SQL + ", u AS (SELECT host, count(*) AS n FROM c WHERE unknown GROUP BY host) SELECT CAST(sum(greatest(1, n)) AS BIGINT) AS n FROM u")
def occurrence_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed occurrences of a rollup."""
    return reports.occurrences(reports.unknown_apps(_coverage(spark, sf_dir)))


def _bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return {
        "summaries": e.select(day), "daily_summaries": e.where("day(ts) % 4 <> 0").select(day).distinct(), "activity_entities": d.select(F.when(F.col("lang") == "en", "file_path").when(F.col("lang") == "de", "task_candidate").otherwise("web_page_title").alias("entity_type")),
        "evidence_quality": e.where("value is not null").select(day, F.lit("event").alias("summary_kind"), (F.col("user_id") % 8 / 8).alias("score"), quality.bucket(F.col("user_id") % 8 / 8).alias("bucket"), (F.col("event_type") == "error").alias("degraded_payload"),
                                                                (F.col("user_id") % 2 == 0).alias("has_file_evidence"), F.lit(None).cast("boolean").alias("has_task_evidence"), F.lit(False).alias("has_conversation_evidence")),
    }


METRICS_SQL = """
WITH s AS (SELECT count(*) AS event_summary_count FROM events), d AS (SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) AS daily_summary_count FROM events WHERE day(ts) % 4 <> 0),
e AS (SELECT count(*) AS activity_entity_count, count(*) FILTER (lang = 'en') AS file_entity_count, count(*) FILTER (lang = 'de') AS task_candidate_count, count(*) FILTER (lang NOT IN ('en', 'de')) AS conversation_entity_count FROM documents),
q AS (SELECT round(avg((user_id % 8) / 8.0::DOUBLE), 3) AS average_score, count(*) FILTER (user_id % 8 = 7) AS n_excellent, count(*) FILTER (user_id % 8 = 6) AS n_good, count(*) FILTER (user_id % 8 IN (3, 4, 5)) AS n_weak, count(*) FILTER (user_id % 8 < 3) AS n_poor,
 count(*) FILTER (event_type = 'error') AS degraded_payload_count, count(*) FILTER (user_id % 2 <> 0) AS raw_only_event_summary_count FROM events WHERE value IS NOT NULL)
"""


@query("bundle_metrics", METRICS_SQL + "SELECT *, round(activity_entity_count / event_summary_count, 2) AS entities_per_summary FROM s, d, e, q")
def bundle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a bundle."""
    return reports.metrics(_bundle(spark, sf_dir)).drop("date_range_start", "date_range_end", "missing_daily_recap_days")


@query("bundle_advice", METRICS_SQL + """, m AS (SELECT * FROM s, d, e, q), days AS (SELECT count(*) AS missing FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE day(ts) % 4 = 0)),
a AS (SELECT unnest([CASE WHEN raw_only_event_summary_count / event_summary_count >= 0.4 THEN 'Many summaries rest on process and window names alone: extract more files, tasks and conversations.' END,
 CASE WHEN missing > 0 THEN 'Active days lack a daily recap: check how days are reconciled.' END,
 CASE WHEN degraded_payload_count / (event_summary_count + daily_summary_count) >= 0.15 THEN 'Many payloads are degraded: tighten the prompt or repair responses.' END,
 CASE WHEN file_entity_count >= 5 AND task_candidate_count <= greatest(1, file_entity_count // 3) THEN 'Files are well covered, tasks are not: improve the search for task labels.' END,
 CASE WHEN (n_good + n_excellent) / (event_summary_count + daily_summary_count) >= 0.7 AND n_weak + n_poor = 0 THEN 'Evidence is mostly good or excellent.' END]) AS advice FROM m, days)
SELECT advice FROM a WHERE advice IS NOT NULL""")
def bundle_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice on the measures of a bundle."""
    return spark.createDataFrame([(line,) for line in reports.recommendations(reports.metrics(_bundle(spark, sf_dir)).first())], "advice string")


@query("bundle_changes", "SELECT count(*) - count(*) FILTER (day(ts) <= 15) AS event_summary_count FROM events")
def bundle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the measures between two bundles."""
    b = _bundle(spark, sf_dir)
    half = b | {"summaries": b["summaries"].where("day <= '2024-01-15'")}
    return reports.compare(reports.metrics(b), reports.metrics(half)).select("event_summary_count")


@query("member_lists", "SELECT n_nationkey AS id, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS summary_ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def member_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with their members in order, none included."""
    bridge = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("coalesced_summary_id"), F.col("s_suppkey").alias("summary_id"), F.col("s_suppkey").alias("member_index"))
    lists = coalesce.member_lists(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), bridge)
    return lists.select("id", F.array_join("summary_ids", ",").alias("summary_ids"))


@query("effective_rows", """
SELECT strftime(o_orderdate, '%Y-%m') AS day, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT strftime(o_orderdate, '%Y-%m') AS day, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND strftime(o_orderdate, '%Y-%m') NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderstatus = 'P')""")
def effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged rows of a day where there are any, else the raw ones."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return search.effective_summaries(o.where("o_orderstatus <> 'P'").drop("o_orderstatus"), o.where("o_orderstatus = 'P'").drop("o_orderstatus"))


@query("orders_with_customer", "SELECT o_orderkey, c_name, CASE WHEN o_orderkey % 2 = 0 THEN '[REDACTED]' ELSE o_orderpriority END AS priority FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their job, one column redacted for some."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", F.col("o_orderpriority").alias("priority"))
    return reports.redact(o.where("o_orderkey % 2 = 0"), priority=True).unionByName(reports.redact(o.where("o_orderkey % 2 <> 0"), priority=False))


_JOB = {"click": "event=job_created", "purchase": "event=request_submit timeout_s=50.5", "error": "event=http_response status=error error_type=Timeout", "view": "event=http_response status=ok", "signup": "event=job_completed"}


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines of jobs, a job per user."""
    told = F.lit("event=job_queued")
    for kind, line in _JOB.items():
        told = F.when(F.col("event_type") == kind, line).otherwise(told)
    seconds = F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit(" elapsed_s="), (F.col("event_id") % 100).cast("string"), F.lit(".5"))).otherwise("")
    line = F.concat(F.lit("2024-01-01 00:00:00 [INFO] app.client: "), told, F.lit(" job_id=j"), F.col("user_id").cast("string"), seconds)
    return logs.parse(logs.records(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_file"), F.col("event_id").alias("line_no"), line.alias("line"))))


JOB_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM events WHERE event_type IN ('purchase', 'error', 'view')),
r AS (SELECT user_id, greatest(1, k) AS request_no, arg_max(CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'success' END, event_id) FILTER (event_type IN ('error', 'view')) AS outcome,
 arg_min((event_id % 100) + 0.5, event_id) FILTER (event_type IN ('error', 'view')) AS elapsed_s, max(50.5) FILTER (event_type = 'purchase') AS timeout_s, bool_or(event_type = 'error') AS timed_out FROM e GROUP BY user_id, greatest(1, k))
"""


@query("log_requests", JOB_SQL + "SELECT 'j' || user_id AS job_id, CAST(request_no AS BIGINT) AS request_no, outcome, CAST(elapsed_s AS DOUBLE) AS elapsed_s FROM r")
def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each job."""
    return logs.requests(_job_log(spark, sf_dir)).select("job_id", "request_no", "outcome", "elapsed_s")


@query("log_request_audit", JOB_SQL + "SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'error') AS failure, count(*) FILTER (timed_out) AS timeouts, count(*) FILTER (elapsed_s > timeout_s) AS long_running FROM r")
def log_request_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all requests."""
    r = logs.requests(_job_log(spark, sf_dir))
    slow = logs.long_running(r).agg(F.count("*").alias("long_running"))
    return logs.request_audit(r).select("total", "success", "failure", "timeouts").crossJoin(slow)


@query("log_queue_audit", """
WITH j AS (SELECT user_id, bool_or(event_type = 'click') AS created, bool_or(event_type = 'signup') AS done FROM events GROUP BY user_id)
SELECT count(*) AS jobs, count(*) FILTER (created) AS created, count(*) FILTER (done) AS terminal, count(*) FILTER (NOT done) AS incomplete, count(*) FILTER (created AND NOT done) AS stalled, bool_or(created AND NOT done) AS queue_open FROM j""")
def log_queue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all jobs."""
    return logs.queue_audit(logs.job_lifecycles(_job_log(spark, sf_dir)))


@query("log_counters", "SELECT CASE event_type WHEN 'click' THEN 'job_created' WHEN 'purchase' THEN 'request_submit' WHEN 'error' THEN 'http_response' WHEN 'view' THEN 'http_response' WHEN 'signup' THEN 'job_completed' ELSE 'job_queued' END AS event_name, count(*) AS n FROM events GROUP BY 1")
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by event."""
    return logs.counters(_job_log(spark, sf_dir), "event_name")


@query("capture_audit", """
SELECT count(*) FILTER (event_type = 'click') AS foreground_changes, CAST(0 AS BIGINT) AS privacy_transitions, count(*) FILTER (event_type = 'view') AS key_accepted, count(*) FILTER (event_type = 'purchase') AS key_skipped, CAST(0 AS BIGINT) AS key_flushes,
 CAST(0 AS BIGINT) AS key_flush_failed, CAST(0 AS BIGINT) AS text_segments, count(*) FILTER (event_type = 'signup') AS screenshots_captured, count(*) FILTER (event_type = 'click' AND user_id % 2 = 0) AS blocked_foreground FROM events""")
def capture_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of capture events."""
    names = F.create_map(*[F.lit(x) for x in ("click", "foreground_window_change", "view", "key_capture_accepted", "purchase", "key_capture_skipped", "signup", "screenshot_captured")])
    e = table(spark, sf_dir, "events").select(F.coalesce(names[F.col("event_type")], F.lit("other")).alias("event_name"), F.create_map(F.lit("blocked"), F.when(F.col("user_id") % 2 == 0, "True").otherwise("no")).alias("fields"))
    return logs.capture_audit(e)


@query("processed_events", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS processed FROM events GROUP BY event_type")
def processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, S3, A5: events marked as processed by id."""
    e = table(spark, sf_dir, "events")
    rows = jobs.mark_processed(e.select(F.col("event_id").alias("id"), "event_type", F.lit(False).alias("processed")), e.where("event_id % 3 = 0").select(F.col("event_id").alias("id")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("processed").alias("processed"))


@query("day_signatures")
def day_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number per day that changes with its rows."""
    return search.day_signature(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")))
