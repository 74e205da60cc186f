"""Queries on conversations as summaries: recaps reduced until one is left, prompt payloads cut to size, summaries merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.config import SummaryDedupSettings
from daytrace.operators import dedup, responses, segments
from daytrace.plans.registry import query, table
from daytrace.plans.sessions import observations


@query("reduced_recaps", """
WITH RECURSIVE t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS todo, list([role] ORDER BY turn) AS tags FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, 0 AS round, todo, tags, []::VARCHAR[] AS now, []::VARCHAR[] AS now_tags, []::VARCHAR[][] AS out, []::VARCHAR[][] AS out_tags, len(todo) AS n, 0 AS chunk_count, false AS done, false AS local FROM t
UNION ALL SELECT conv_id, CASE WHEN last AND NOT stop THEN round + 1 ELSE round END, CASE WHEN NOT last THEN todo[2:] WHEN stop THEN todo ELSE list_transform(full_out, lambda x: CASE WHEN length(array_to_string(x, ' ')) <= most THEN array_to_string(x, ' ') ELSE array_to_string(x, ' ')[1:most] || '...' END) END,
  CASE WHEN NOT last THEN tags[2:] WHEN stop THEN tags ELSE list_transform(full_tags, lambda x: x[1:20]) END, CASE WHEN last THEN [] WHEN fits THEN list_concat(now, [todo[1]]) ELSE [todo[1]] END, CASE WHEN last THEN [] WHEN fits THEN list_concat(now_tags, tags[1]) ELSE tags[1] END,
  CASE WHEN last AND stop THEN full_out WHEN last THEN [] WHEN fits THEN out ELSE list_concat(out, [now]) END, CASE WHEN last AND stop THEN full_tags WHEN last THEN [] WHEN fits THEN out_tags ELSE list_concat(out_tags, [now_tags]) END,
  CASE WHEN last AND NOT stop THEN len(full_out) ELSE n END, CASE WHEN last AND round = 0 THEN len(full_out) ELSE chunk_count END, last AND stop, last AND stop AND n > 1 FROM (
  SELECT *, len(todo) = 0 AS last, len(now) = 0 OR list_sum(list_transform(now, lambda x: greatest(1, length(x)))) + greatest(1, length(todo[1])) <= 600 AS fits,
         list_concat(out, [now]) AS full_out, list_concat(out_tags, [now_tags]) AS full_tags, CASE WHEN conv_id % 2 = 0 THEN 150 ELSE 400 END AS most, round > 0 AND (n = 1 OR len(out) + 1 >= n) AS stop FROM r WHERE NOT done))
SELECT conv_id, CASE WHEN local THEN array_to_string(flatten(out), ' ') ELSE out[1][1] END AS summary_text, array_to_string(flatten(out_tags)[1:20], ',') AS tags, CAST(round - 1 AS INT) AS rounds, local AS merged_locally, CAST(chunk_count AS BIGINT) AS chunk_count FROM r WHERE done""")
def reduced_recaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns reduced to one recap per conversation; an answer keeps 150 or, for odd ones, 400 characters of its chunk."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("summary_text"), F.array("role").alias("tags"))
    most = F.when(F.col("conv_id") % 2 == 0, 150).otherwise(400)
    answer = lambda merged: merged.withColumn("summary_text", responses.shortened(F.col("summary_text"), most))
    out = responses.reduce_recaps(c, ["conv_id"], ["tags"], "turn", F.char_length("summary_text"), 600, answer)
    return out.select("conv_id", "summary_text", F.array_join("tags", ",").alias("tags"), "rounds", "merged_locally", "chunk_count")


@query("prompt_payloads", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr, string_split(text, '. ') AS parts FROM conversations),
c AS (SELECT conv_id, nr, turn, role, CASE WHEN length(text) > 60 THEN text[1:60] || '...' ELSE text END AS text, list_transform(parts, lambda x: CASE WHEN length(x) > 60 THEN x[1:60] || '...' ELSE x END) AS parts,
      coalesce(length(text) > 60, false) OR len(list_filter(parts, lambda x: length(x) > 60)) > 0 AS cut FROM t)
SELECT conv_id, count(*) AS original_count, least(count(*), 4) AS included_count, bool_or(cut AND nr <= 4) AS texts_truncated, bool_or(cut AND nr <= 4) OR count(*) > 4 AS truncated,
       array_to_string(list(turn || ':' || role || ':' || coalesce(text, '') || ':' || coalesce(array_to_string(parts, '|'), '') ORDER BY nr) FILTER (nr <= 4), chr(10)) AS items FROM c GROUP BY conv_id""")
def prompt_payload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four turns of each conversation with the texts in their nested parts cut, and what was left out."""
    part = F.transform(F.split("text", r"\. "), lambda x: F.struct(x.alias("line"), F.map_from_arrays(F.array(F.lit("same")), F.array(x)).alias("more")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", part.alias("parts"))
    out = responses.prompt_payloads(c, ["conv_id"], ["turn"], 4, 60)
    told = F.transform("items", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")), F.lit(":"), F.coalesce(F.array_join(F.transform(x["parts"], lambda p: p["more"]["same"]), "|"), F.lit(""))))
    return out.select("conv_id", "original_count", "included_count", "texts_truncated", "truncated", F.array_join(told, "\n").alias("items"))


@query("merged_summaries")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as summaries, stored, merged into the one that they continue, or suppressed; what stays stored, with the ends that merges moved."""
    return dedup.stored_summaries(dedup.merge_summaries(_summaries(spark, sf_dir), ["machine"], SUMMARIES), ["machine"])


#: Events of a user are hours apart.
SUMMARIES = SummaryDedupSettings(cooldown_s=8 * 3600.0)


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as summaries of ten minutes: the app is the title, and with the event's parity the process."""
    o = observations(spark, sf_dir)
    return o.select(
        "machine", F.col("event_id").alias("id"), F.col("ts").alias("start_ts"), (F.col("ts") + 600).alias("end_ts"), F.col("ts").alias("created_ts"), F.concat_ws(" ", "app", F.lit("seen on page"), (F.col("event_id") % 4).cast("string")).alias("summary_text"),
        F.concat_ws("-", "app", (F.col("event_id") % 2).cast("string")).alias("process_name"), F.col("app").alias("window_title"), (F.col("app") == "error").alias("blocked"), F.lit("").alias("closure_reason"))


@query("serialized_batches", """
WITH o AS (SELECT user_id AS machine, event_id, event_type AS app, epoch_us(ts) / 1e6 AS ts FROM events),
i AS (SELECT machine, list(app ORDER BY ts, event_id) AS intervals, min(ts) AS a, max(ts) + 1 AS b FROM o WHERE app <> 'view' GROUP BY machine),
s AS (SELECT machine, list(event_id ORDER BY ts, event_id) AS shots, min(ts) AS a, max(ts) AS b FROM (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts, event_id) AS k FROM o WHERE app = 'view') WHERE k <= 3 GROUP BY machine)
SELECT coalesce(i.machine, s.machine) AS machine, least(i.a, s.a) AS start_ts, greatest(i.b, s.b) AS end_ts, coalesce(array_to_string(intervals, ','), '') AS intervals, coalesce(array_to_string(shots, ','), '') AS shots, CAST(coalesce(len(shots), 0) AS INT) AS n_shots FROM i FULL JOIN s ON i.machine = s.machine""")
def serialized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per machine one batch with its intervals and first three screenshots as JSON, parsed again here."""
    o = observations(spark, sf_dir)
    intervals = o.where("app <> 'view'").select("machine", F.col("ts").alias("start_ts"), (F.col("ts") + 1).alias("end_ts"), F.col("app").alias("process_name"), F.format_string("%012d", "event_id").alias("window_title"), F.lit(False).alias("blocked"))
    shots = o.where("app = 'view'").select("machine", "ts", F.format_string("%012d", "event_id").alias("file_path"), F.col("app").alias("process_name"))
    out = segments.serialized_batches({"active_intervals": intervals, "screenshots": shots}, ["machine"])
    member = lambda part, name: F.array_join(F.transform(part, lambda x: F.get_json_object(x, f"$.{name}")), ",")
    ids = F.array_join(F.transform("screenshots", lambda x: F.get_json_object(x, "$.file_path").cast("bigint").cast("string")), ",")
    return out.select("machine", "start_ts", "end_ts", member("active_intervals", "process_name").alias("intervals"), ids.alias("shots"), F.size("screenshots").alias("n_shots"))
