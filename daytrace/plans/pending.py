"""Queries on pending work, lookups, stored rows and reports' orders; events stand for intervals, screenshots and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrace.operators import decoders, jobs, logs, pending, reports, responses, segments
from daytrace.plans.registry import query, table
from daytrace.plans.sessions import observations
from daytrace.schemas import evolve

INTERVALS_SQL = """
WITH i AS (SELECT event_id AS id, user_id AS machine, event_type, value, epoch_us(ts) / 1e6 AS start_ts, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events)
"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval from each event of a machine to its next one; every third is summarized, errors are blocked."""
    o = observations(spark, sf_dir)
    end = F.lead("ts").over(Window.partitionBy("machine").orderBy("ts", "event_id"))
    return o.select("machine", F.col("event_id").alias("id"), F.col("ts").alias("start_ts"), end.alias("end_ts"), F.col("app").alias("process_name"), F.concat_ws(" ", "app", F.lit("window")).alias("window_title"),
                    (F.col("app") == "error").alias("blocked"), (F.col("event_id") % 3 == 0).alias("summarized"), "value")


@query("pending_intervals", INTERVALS_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY start_ts, id) AS k FROM i WHERE end_ts IS NOT NULL AND id % 3 <> 0) SELECT machine, id, start_ts, end_ts FROM p WHERE k <= 10")
def pending_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten closed, unsummarized intervals of each machine, a scan with a limit as its feature."""
    return pending.pending_intervals(_intervals(spark, sf_dir), ["machine"], 10).select("machine", "id", "start_ts", "end_ts")


@query("pending_blocked_intervals", INTERVALS_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY start_ts, id) AS k FROM i WHERE event_type = 'error' AND end_ts IS NOT NULL AND id % 3 <> 0) SELECT machine, id, start_ts, end_ts FROM p WHERE k <= 10")
def pending_blocked_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of blocked intervals."""
    return pending.pending_intervals(_intervals(spark, sf_dir).where("blocked"), ["machine"], 10).select("machine", "id", "start_ts", "end_ts")


@query("pending_texts", "SELECT conv_id, turn AS id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 2 = 0) WHERE k <= 3")
def pending_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three texts of each conversation that no summary has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").cast("double").alias("start_ts"), "text", (F.col("turn") % 2 == 1).alias("summarized"))
    return pending.pending_texts(c, ["conv_id"], 3).select("conv_id", "id", "text")


@query("pending_screenshots", "SELECT machine, id, ts FROM (SELECT user_id AS machine, event_id AS id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_id % 4 <> 0) WHERE k <= 20")
def pending_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty oldest unsummarized screenshots of each machine."""
    o = observations(spark, sf_dir).select("machine", F.col("event_id").alias("id"), "ts", (F.col("event_id") % 4 == 0).alias("summarized"))
    return pending.pending_screenshots(o, ["machine"]).select("machine", "id", "ts")


@query("unreserved_intervals", INTERVALS_SQL + """, r(a, b) AS (VALUES (1704067200.0, 1704100000.0), (1704153600.0, 1704240000.0)),
f AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY start_ts, id) AS k FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY start_ts, id) AS left_k FROM f WHERE k <= 15 AND NOT EXISTS (SELECT 1 FROM r WHERE start_ts <= b AND a <= coalesce(end_ts, start_ts)))
SELECT machine, id, start_ts FROM n WHERE left_k <= 5""")
def unreserved_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an expanded number of intervals of a machine the first five outside reserved ranges."""
    ranges = spark.createDataFrame([(1704067200.0, 1704100000.0), (1704153600.0, 1704240000.0)], "from_ts double, to_ts double")
    return pending.unreserved(_intervals(spark, sf_dir), ["machine"], ranges, 5).select("machine", "id", "start_ts")


@query("machine_backlog", """
SELECT user_id AS machine, count(*) FILTER (event_type = 'click') AS intervals, count(*) FILTER (event_type = 'error') AS screenshots, count(*) FILTER (event_type IN ('click', 'error')) > 0 AS backlog FROM events GROUP BY user_id""")
def machine_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines with pending work."""
    n = observations(spark, sf_dir).groupBy("machine").agg(F.count_if(F.col("app") == "click").alias("intervals"), F.count_if(F.col("app") == "error").alias("screenshots"))
    zero = {c: F.lit(0).cast("long") for c in pending.BACKLOG if c not in n.columns}
    return pending.has_backlog(n.withColumns(zero)).select("machine", "intervals", "screenshots", "backlog")


OBSERVED_SQL = INTERVALS_SQL + """, u AS (
SELECT machine, 'active_interval' AS kind, start_ts, coalesce(end_ts, start_ts) AS end_ts, event_type = 'error' AS blocked FROM i
UNION ALL SELECT machine, 'blocked_interval', start_ts, coalesce(end_ts, start_ts), true FROM i WHERE event_type = 'error'
UNION ALL SELECT machine, 'text_segment', start_ts, start_ts + 1, false FROM i WHERE id % 5 = 0
UNION ALL SELECT machine, 'screenshot', start_ts, start_ts, false FROM i WHERE id % 8 = 0)
"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _intervals(spark, sf_dir)
    texts = i.where("id % 5 = 0").select("machine", "start_ts", (F.col("start_ts") + 1).alias("end_ts"), "process_name", "window_title", F.lit("x").alias("text"), F.array().cast("array<string>").alias("hotkeys"))
    shots = i.where("id % 8 = 0").select("machine", F.col("start_ts").alias("ts"), "process_name", "window_title", F.col("id").alias("active_interval_id"), "id", F.lit("").alias("perceptual_hash"), F.lit("f").alias("fingerprint"))
    return segments.observations(i, i.where("blocked").withColumn("active_interval_id", F.col("id")), texts, shots, ["machine"])


@query("observation_union", OBSERVED_SQL + "SELECT machine, kind, start_ts, end_ts, blocked, row_number() OVER (PARTITION BY machine, kind ORDER BY start_ts, end_ts) AS place FROM u")
def observation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the four inputs, each kind of a machine in order."""
    return decoders.placed(_observed(spark, sf_dir), ["machine", "kind"], ["start_ts", "end_ts"]).select("machine", "kind", "start_ts", "end_ts", "blocked", F.col("place").cast("long").alias("place"))


@query("batch_spans", OBSERVED_SQL + "SELECT machine, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM u GROUP BY machine")
def batch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest start and latest end over the four inputs."""
    return segments.batch_span(_observed(spark, sf_dir), ["machine"])


JOBS_SQL = """
WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS target_day, CAST(o_orderkey % 3 + 1 AS INT) AS attempt, o_totalprice AS timeout_s FROM orders)
"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit("day_summary").alias("job_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("target_day"), (F.col("o_orderkey") % 3 + 1).alias("attempt"), F.col("o_totalprice").alias("timeout_s"))


@query("job_lookup", JOBS_SQL + "SELECT id, status, target_day, attempt, timeout_s FROM j WHERE id = 7")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id; the filter reaches the scan."""
    return decoders.job(_jobs(spark, sf_dir), 7).select("id", "status", "target_day", "attempt", "timeout_s")


@query("job_records", JOBS_SQL + "SELECT id, status, target_day, attempt, timeout_s FROM j")
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as typed records."""
    return decoders.jobs(_jobs(spark, sf_dir)).select("id", "status", "target_day", "attempt", "timeout_s")


@query("day_job_actions", JOBS_SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY target_day ORDER BY id DESC) AS k FROM j)
SELECT target_day AS day, CASE WHEN status IN ('queued', 'running') THEN 'reuse' ELSE 'requeue' END AS action, CAST(CASE WHEN status IN ('queued', 'running') THEN attempt ELSE attempt + 1 END AS INT) AS attempt FROM l WHERE k = 1""")
def day_job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: for each day whether its last job is reused or queued again, and the attempt."""
    return jobs.day_job_actions(_jobs(spark, sf_dir))


RECAPS_SQL = """
WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'no day' ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS day, text AS recap_text, doc_id % 4 <> 0 AS sound, lang, source, CAST(doc_id % 9 AS INT) AS n FROM documents)
"""


def _recaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recaps; the payload of every fourth is a list, of every eighth no JSON."""
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("job_id"), F.struct(F.col("lang").alias("schema")).alias("metadata"), F.col("source").alias("model_name")))
    payload = F.when(F.col("doc_id") % 8 == 0, "{broken").when(F.col("doc_id") % 4 == 0, "[1]").otherwise(good)
    day = F.when(F.col("doc_id") % 11 == 0, "no day").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), day.alias("day"), F.col("text").alias("recap_text"), payload.alias("recap_json"), (F.col("doc_id") % 9).cast("int").alias("source_batch_count"), F.col("doc_id").cast("double").alias("created_ts"))


@query("recap_records", RECAPS_SQL + "SELECT id, try_cast(day AS DATE) AS day, CASE WHEN sound THEN source END AS model_name, CASE WHEN sound THEN lang END AS schema, n AS source_batch_count FROM r")
def recap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recaps with their payload parsed; what is no object is null."""
    get = lambda p: F.try_variant_get("payload", p, "string")
    return decoders.recaps(_recaps(spark, sf_dir)).select("id", "day", get("$.model_name").alias("model_name"), get("$.metadata.schema").alias("schema"), "source_batch_count")


@query("recap_of_day", RECAPS_SQL + "SELECT id, DATE '2024-01-05' AS day, n AS source_batch_count FROM r WHERE day = '2024-01-05'")
def recap_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recaps of a day."""
    return decoders.recap_of(_recaps(spark, sf_dir), "2024-01-05").select("id", "day", "source_batch_count")


@query("audit_recaps", RECAPS_SQL + "SELECT day, id AS daily_summary_id, CASE WHEN sound THEN CAST(id AS VARCHAR) END AS job_id, n AS source_summary_count, CASE WHEN sound THEN lang END AS prompt_name, CASE WHEN sound THEN source END AS model_name FROM r")
def audit_recaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit form of recaps."""
    return reports.daily_rows(_recaps(spark, sf_dir)).select("day", "daily_summary_id", "job_id", "source_summary_count", "prompt_name", "model_name")


@query("audit_coalesced", "SELECT user_id AS coalesced_id, count(*) AS member_count, min(event_id) AS first_member, 'High' AS confidence_bucket, 0.95::DOUBLE AS merge_score_aggregate FROM events GROUP BY user_id")
def audit_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit form of coalesced summaries, the events of a user as members."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list("event_id")).alias("summary_ids"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).cast("double").alias("start_ts"))
    c = c.withColumns({"day": F.lit("2024-01-01"), "end_ts": F.col("start_ts"), "summary_text": F.lit("x"), "created_ts": F.col("start_ts"), "summary_json": F.lit('{"confidence_bucket": "High", "merge_score": 0.95}')})
    return reports.coalesced_rows(c).select("coalesced_id", F.col("member_count").cast("long").alias("member_count"), F.get("member_summary_ids", F.lit(0)).alias("first_member"), "confidence_bucket", "merge_score_aggregate")


@query("audit_diagnostics", "SELECT event_id AS left_summary_id, event_id + 1 AS right_summary_id, event_type AS decision, round(value, 4) AS merge_score, user_id % 2 = 0 AS same_app, user_id % 3 = 0 AS same_window, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS n_reasons, 0.9::DOUBLE AS min_cosine FROM events")
def audit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit form of merge diagnostics, their lists read from JSON."""
    d = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("left_summary_id"), (F.col("event_id") + 1).alias("right_summary_id"), F.lit(0.5).alias("embedding_cosine_similarity"),
        F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0).alias("app_similarity_score"), F.when(F.col("user_id") % 3 == 0, 0.4).otherwise(0.0).alias("window_similarity_score"), F.lit(0.0).alias("keyword_overlap_score"),
        F.lit(60.0).alias("temporal_gap_seconds"), F.when(F.col("user_id") % 2 == 0, '["gap_too_large"]').otherwise("nothing").alias("blockers_json"), F.lit("[]").alias("reasons_json"), F.col("value").alias("final_merge_score"),
        F.col("event_type").alias("decision"), F.lit(0.0).alias("created_ts"))
    rows = reports.diagnostic_rows(decoders.diagnostics(d))
    return rows.select("left_summary_id", "right_summary_id", "decision", F.round("merge_score", 4).alias("merge_score"), "same_app", "same_window", F.size("reason").alias("n_reasons"), F.col("semantic_parameters.min_cosine").alias("min_cosine"))


@query("entity_records", "SELECT p_partkey AS activity_entity_id, p_brand AS entity_type, p_size AS size, round((p_size % 10) / 10.0::DOUBLE, 2) AS confidence FROM part")
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their attributes parsed, under the audit's name of the id."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_type"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("attributes_json"), (F.col("p_size") % 10 / 10).alias("confidence"))
    return decoders.entities(e).select("activity_entity_id", "entity_type", F.try_variant_get("attributes", "$.size", "int").alias("size"), F.round("confidence", 2).alias("confidence"))


@query("report_flags", "SELECT event_id AS summary_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE (user_id % 8) / 8.0 END::DOUBLE AS score, CASE WHEN event_type = 'error' THEN 'poor' ELSE event_type END AS bucket, coalesce(value > 50, false) AS unknown_app FROM events")
def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored quality reports with defaults for what they lack."""
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("summary_id"), F.when(F.col("user_id") % 3 == 0, "none").otherwise((F.col("user_id") % 8 / 8).cast("string")).alias("score"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("bucket"), (F.col("value") > 50).alias("unknown_app"))
    return decoders.report_flags(r, ["unknown_app"])


@query("unclean_runs", "SELECT event_id, CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_type <> 'signup' AND event_id % 4 <> 0")
def unclean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose state lacks a clean shutdown; every fourth had one, signups left no state."""
    state = F.when(F.col("event_type") != "signup", F.to_json(F.struct(F.col("user_id").alias("session_id"), (F.col("event_id") % 4 == 0).alias("clean_shutdown"))))
    return decoders.unclean_runs(table(spark, sf_dir, "events").select("event_id", state.alias("state"))).select("event_id", "session_id")


@query("error_notifications", """
WITH n AS (SELECT event_id, event_type = 'purchase' AS resolved, lag(event_type = 'purchase') OVER w AS was_resolved, lag(user_id % 2) OVER w AS was, user_id % 2 AS message FROM (SELECT *, event_id % 10 AS grp FROM events) WINDOW w AS (PARTITION BY user_id, grp ORDER BY ts, event_id))
SELECT event_id, NOT resolved AND NOT coalesce(NOT was_resolved AND was = message, false) AS notify FROM n""")
def error_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error is shown unless it is the active one of its category on its machine; purchases resolve it."""
    e = observations(spark, sf_dir).select("event_id", "ts", "machine", (F.col("event_id") % 10).alias("category"), (F.col("machine") % 2).alias("message"), (F.col("app") == "purchase").alias("resolved"))
    return logs.notified(e, ["machine"], ["ts", "event_id"]).select("event_id", "notify")


@query("stage_lines", "SELECT event_id, event_type AS stage, CASE WHEN value IS NULL THEN NULL ELSE printf('%.3f', value) END AS elapsed_s, CAST(user_id AS VARCHAR) AS job_id FROM events")
def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged lines written and read again."""
    e = table(spark, sf_dir, "events")
    line = logs.stage_line(F.col("event_type"), F.lit("ok"), F.col("user_id"), elapsed_s=F.col("value").cast("decimal(18,3)"))
    f = logs.fields_of(F.regexp_extract(line, logs.TAG, 2))
    return e.select("event_id", f["stage"].alias("stage"), f["elapsed_s"].alias("elapsed_s"), f["job_id"].alias("job_id"))


@query("chunk_summaries", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS job_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) AS start_ts, text AS summary_text FROM conversations")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of chunks as summaries of a next round."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("summary_text"), F.lit("{}").alias("summary_json"))
    return responses.pseudo_summaries(c, ["conv_id"], ["turn"]).select("conv_id", "job_id", "start_ts", "summary_text")


@query("merged_recaps", """
WITH w AS (SELECT conv_id, turn, list_slice(string_split(text, ' '), 1, 6) AS w, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, array_to_string(list_slice(flatten(list(w ORDER BY turn)), 1, 20), ' ') AS files, string_agg(text, ' ' ORDER BY turn) AS summary_text FROM w GROUP BY conv_id""")
def merged_recaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a recap merged without a model: lists one after the other, at most twenty members."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("summary_text"), F.slice(F.split("text", " "), 1, 6).alias("files"))
    return responses.merge_recaps(c, ["conv_id"], ["files"], "turn").select("conv_id", F.array_join("files", " ").alias("files"), "summary_text")


@query("capped_lists", "SELECT conv_id, count(*) AS original_count, count(*) > 5 AS truncated, least(count(*), 5) AS included_count FROM conversations GROUP BY conv_id")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a prompt with their cap, original and included counts; what is beyond the cap is counted, not gathered."""
    out = responses.prompt_payloads(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 5, responses.BUDGET)
    return out.select("conv_id", "original_count", "truncated", "included_count")


@query("evolved_rows", "SELECT event_type AS key, count(*) AS n, CAST(0 AS BIGINT) AS titled FROM events GROUP BY event_type")
def evolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older form in the columns of today's relation."""
    old = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.lit("dropped").alias("gone"))
    return evolve(old, "key_events").groupBy("key").agg(F.count("*").alias("n"), F.count("window_title").alias("titled"))


@query("report_orders", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type NULLS FIRST, strftime(ts, '%Y-%m-%d'), ts, event_id) AS report_place, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS card_place,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS summary_place FROM events""")
def report_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows in the orders of coalescing, of cards and of quality reports."""
    o = observations(spark, sf_dir).select("machine", F.col("event_id").alias("id"), F.col("event_id").alias("summary_id"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("app").alias("summary_kind"), F.to_date(F.timestamp_seconds("ts")).cast("string").alias("day"))
    out = decoders.placed(o, ["machine"], decoders.REPORT_ORDER).withColumnRenamed("place", "report_place")
    out = decoders.placed(out, ["machine"], decoders.card_order()).withColumnRenamed("place", "card_place")
    out = decoders.placed(out, ["machine"], decoders.SUMMARY_ORDER).withColumnRenamed("place", "summary_place")
    return out.select(F.col("id").alias("event_id"), *[F.col(c).cast("long").alias(c) for c in ("report_place", "card_place", "summary_place")])


@query("draft_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, lower(l_linestatus), CAST(l_partkey AS VARCHAR), printf('%012d', l_linenumber)) AS place FROM lineitem")
def draft_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the entity drafts of a summary: an order's lines."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("entity_type"), F.lower("l_linestatus").alias("source_kind"), F.col("l_partkey").cast("string").alias("entity_normalized"), F.format_string("%012d", F.col("l_linenumber")).alias("source_ref"))
    return decoders.placed(d, ["l_orderkey"], decoders.DRAFT_ORDER).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))
