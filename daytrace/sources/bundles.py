"""Audit bundles and logs: readers with fixed schemas, and the writer of a bundle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daytrace.operators import logs
from daytrace.session import new_folder

SCHEMAS = {
    "summaries": "summary_id BIGINT, job_id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, process_name STRING, window_title STRING, summary_text STRING, screenshot_count INT, text_segment_count INT, prompt_name STRING, model_name STRING, created_at DOUBLE",
    "daily_summaries": "day STRING, daily_summary_id BIGINT, job_id STRING, summary_text STRING, source_summary_count INT, prompt_name STRING, model_name STRING, created_at DOUBLE",
    "coalesced_summaries": "coalesced_id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, summary_text STRING, member_summary_ids ARRAY<BIGINT>, member_count INT, confidence_bucket STRING, merge_score_aggregate DOUBLE, created_at DOUBLE",
    "activity_entities": "activity_entity_id BIGINT, summary_id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, entity_type STRING, entity_value STRING, entity_normalized STRING, source_kind STRING, source_ref STRING, evidence_kind STRING, confidence DOUBLE, attributes_json STRING, created_at DOUBLE",
    "parser_coverage": "summary_id BIGINT, job_id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, process_name STRING, normalized_process_name STRING, window_title STRING, normalized_window_title STRING, matched_parser_names ARRAY<STRING>, used_generic_parser BOOLEAN, used_specialized_parser BOOLEAN, extracted_entity_count INT, unclassified_evidence_count INT, parser_confidence DOUBLE, unknown_app BOOLEAN, created_at DOUBLE",
    "unknown_apps": "process_name STRING, normalized_process_name STRING, occurrence_count BIGINT, first_seen_ts DOUBLE, last_seen_ts DOUBLE, sample_window_title STRING, normalized_title_sample STRING, extracted_entity_count INT, unclassified_evidence_count INT, matched_parser_names ARRAY<STRING>, parser_confidence DOUBLE",
    "evidence_quality": "summary_id BIGINT, summary_kind STRING, day STRING, start_ts DOUBLE, end_ts DOUBLE, score DOUBLE, bucket STRING, degraded_payload BOOLEAN, unknown_app BOOLEAN, has_file_evidence BOOLEAN, has_task_evidence BOOLEAN, has_conversation_evidence BOOLEAN",
    "merge_diagnostics": "day STRING, left_summary_id BIGINT, right_summary_id BIGINT, decision STRING, merge_score DOUBLE, embedding_similarity DOUBLE, temporal_gap_seconds DOUBLE, same_app BOOLEAN, same_window BOOLEAN, reason ARRAY<STRING>, diagnostic_flags ARRAY<STRING>, created_at DOUBLE",
}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a missing file has no rows, lines that hold no object are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path).where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    return text.select(F.from_json("value", schema).alias("r")).select("r.*")


def load_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The frames of a bundle; only the folder must exist."""
    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    return {name: read_jsonl(spark, f"{folder}/{name}.jsonl", schema) for name, schema in SCHEMAS.items()}


def export_bundle(frames: dict[str, DataFrame], folder: str, manifest: dict | None = None) -> dict[str, int]:
    """Each frame as a JSON lines folder, and a manifest with their row counts, which is written last."""
    counts = {}
    for name, df in frames.items():
        path = f"{folder}/{name}.jsonl"
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        counts[name] = df.sparkSession.read.text(path).count()
    spark = next(iter(frames.values())).sparkSession
    told = json.dumps({**(manifest or {}), "row_counts": counts}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return counts


def read_logs(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines of the log files of a folder (source_file, line_no from 1, line).

    A file is read in blocks by several tasks. Lines are numbered within their block, and blocks by the lines before
    them, so no file has to fit one task.
    """
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(where.alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    sizes = lines.groupBy("b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b.file").orderBy("b.start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.select("b", "first", before.alias("before"))
    return lines.join(blocks, "b").select(F.col("b.file").alias("source_file"), (F.col("before") + F.col("i") - F.col("first") + 1).alias("line_no"), "line")


#: Files of a log audit beside the parsed entries (fixed values).
AUDIT_FILES = [
    "event_counts", "error_taxonomy", "lifecycle_timeline", "summary_queue_audit", "lmstudio_audit", "capture_audit", "crash_audit", "lock_unlock_audit", "storage_audit", "config_audit", "anomalies",
]


def log_audit(events: DataFrame) -> dict[str, DataFrame]:
    """The frames of a log audit, of parsed entries."""
    jobs, reqs = logs.job_lifecycles(events), logs.requests(events)
    frames = [
        logs.counters(events, "event_name"), logs.taxonomy(events), logs.timeline(events, logs.FINALIZED), logs.queue_audit(jobs), logs.request_audit(reqs), logs.capture_audit(events), logs.crash_audit(events), logs.lock_audit(events),
        logs.storage_audit(events), logs.config_audit(events), logs.order_violations(events),
    ]
    return {"parsed_events": events, **dict(zip(AUDIT_FILES, frames, strict=True))}


def write_log_audit(events: DataFrame, folder: str) -> dict[str, int]:
    """Parsed entries and the eleven files of a log audit, with a manifest of their rows. Entries are parsed once and stored."""
    spark, parsed = events.sparkSession, f"{new_folder(events.sparkSession, 'parsed')}/rows"
    events.write.parquet(parsed)
    return export_bundle(log_audit(spark.read.schema(events.schema).parquet(parsed)), folder)


def replace_days(df: DataFrame, path: str, day: str = "day") -> None:
    """The rows of each day in ``df`` replace that day's; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Rows join a relation."""
    df.write.mode("append").parquet(path)
