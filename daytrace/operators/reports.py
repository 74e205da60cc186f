"""Reports over audit rows: ranked counts, rollups of unknown apps, parser coverage, bundle metrics, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.config import CoalesceSettings

FILE_TYPES, TASK_HINTS, TALK_TYPES = ["file_path", "file_name", "folder_path"], ["task", "ticket", "jira"], ["conversation_subject", "mail_subject", "web_page_title"]
BUCKETS = ["excellent", "good", "weak", "poor"]
LOW_CONFIDENCE = 0.8
NO_PARSER = "No specialized parser matched; "


def rank(rows: DataFrame, label: Sequence[str], weight: Column | None = None, pos: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """Labels by summed weight (1 at least per row), the first seen first among equals; blank labels don't count."""
    weight = F.lit(1) if weight is None else F.greatest(F.lit(1), F.coalesce(weight, F.lit(1)))
    first = F.min(F.struct(*pos)) if pos else F.min(F.struct(*label))
    named = rows.where(F.col(label[0]).isNotNull() & (F.trim(label[0]) != ""))
    return named.groupBy(*label).agg(F.sum(weight).alias("n"), first.alias("_first")).orderBy(F.desc("n"), "_first").limit(limit).drop("_first")


def occurrences(rows: DataFrame, column: str = "occurrence_count") -> DataFrame:
    """Summed occurrences, 1 at least for each row."""
    return rows.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.coalesce(column, F.lit(1)))), F.lit(0)).alias("n"))


def _first_filled(c: str) -> Column:
    return F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("pos"))), F.lit(""))


def _names(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(c, lambda n: F.trim(n) != "")))))


def unknown_apps(coverage: DataFrame) -> DataFrame:
    """Parser coverage rows (with pos, their order) of unknown apps rolled up by process, most frequent first."""
    key = F.coalesce(F.nullif("normalized_process_name", F.lit("")), "process_name", F.lit(""))
    return coverage.where("unknown_app").groupBy(key.alias("key")).agg(
        F.min_by("process_name", "pos").alias("process_name"), F.min_by("normalized_process_name", "pos").alias("normalized_process_name"), F.count("*").alias("occurrence_count"),
        F.min("start_ts").alias("first_seen_ts"), F.max("end_ts").alias("last_seen_ts"), _first_filled("window_title").alias("sample_window_title"),
        _first_filled("normalized_window_title").alias("normalized_title_sample"), F.max("extracted_entity_count").alias("extracted_entity_count"),
        F.max("unclassified_evidence_count").alias("unclassified_evidence_count"), _names("matched_parser_names").alias("matched_parser_names"), F.round(F.avg("parser_confidence"), 3).alias("parser_confidence"),
    ).drop("key").orderBy(F.desc("occurrence_count"), "normalized_process_name")


def unknown_windows(coverage: DataFrame) -> DataFrame:
    """The same by process and title, with what the general parsers found."""
    out = coverage.where("unknown_app").groupBy("normalized_process_name", "normalized_window_title").agg(
        F.min_by("process_name", "pos").alias("process_name"), _first_filled("window_title").alias("sample_window_title"), F.count("*").alias("occurrence_count"), F.min("start_ts").alias("first_seen_ts"),
        F.max("end_ts").alias("last_seen_ts"), F.max("extracted_entity_count").alias("extracted_entity_count"), _names("matched_parser_names").alias("candidate_patterns"),
    )
    told = F.concat(F.lit(NO_PARSER + "generic parsers extracted "), F.concat_ws(", ", F.slice("candidate_patterns", 1, 6)), F.lit("."))
    plain = F.lit(NO_PARSER + "preserve exact title tokens and consider a dedicated parser.")
    out = out.withColumn("suggested_parser_reason", F.when(F.size("candidate_patterns") > 0, told).otherwise(plain))
    return out.withColumnRenamed("normalized_window_title", "normalized_title_sample").orderBy(F.desc("occurrence_count"), "normalized_process_name", "normalized_title_sample")


def low_confidence(entities: DataFrame) -> DataFrame:
    """Entities under 0.8, the surest first."""
    return entities.where(F.col("confidence") < LOW_CONFIDENCE).orderBy(F.desc("confidence"), "day", "entity_type", "entity_normalized")


def coverage_by_process(coverage: DataFrame, limit: int = 25) -> DataFrame:
    """Rows, unknown ones and parsers used per process."""
    return coverage.groupBy(F.lower(F.trim(F.coalesce("process_name", F.lit("")))).alias("normalized_process_name")).agg(
        F.min_by("process_name", "pos").alias("process_name"), F.count("*").alias("occurrence_count"), F.count_if("unknown_app").alias("unknown_app_count"), F.count_if("used_generic_parser").alias("used_generic_parser_count"),
        F.count_if("used_specialized_parser").alias("used_specialized_parser_count"), F.round(F.avg("parser_confidence"), 3).alias("average_parser_confidence"),
    ).orderBy(F.desc("occurrence_count"), "normalized_process_name").limit(limit)


def top_unknown(unknown: DataFrame, coverage: DataFrame, limit: int = 5) -> DataFrame:
    """Unknown processes by occurrences; from parser coverage where there is no rollup."""
    label = F.coalesce(F.nullif("process_name", F.lit("")), "normalized_process_name").alias("label")
    rolled = unknown.select(label, F.col("occurrence_count").alias("w"), F.lit(0).alias("src"))
    raw = coverage.where("unknown_app").select(label, F.lit(1).cast("bigint").alias("w"), F.lit(1).alias("src"))
    some = rolled.agg(F.count("*").alias("_some"))
    both = rolled.unionByName(raw).crossJoin(F.broadcast(some)).where((F.col("src") == 0) | (F.col("_some") == 0))
    return rank(both, ["label"], F.col("w"), limit=limit)


def bundle_day(df: DataFrame) -> Column:
    """Day of a bundle row: its own, or that of its start."""
    own = F.nullif(F.trim(F.col("day").cast("string")), F.lit("")) if "day" in df.columns else F.lit(None).cast("string")
    start = F.to_date(F.timestamp_seconds("start_ts")).cast("string") if "start_ts" in df.columns else F.lit(None).cast("string")
    return F.coalesce(own, start)


def bundle_days(*frames: DataFrame) -> DataFrame:
    """U4: all days of the frames."""
    out = None
    for df in frames:
        one = df.select(bundle_day(df).alias("day")).where("day is not null")
        out = one if out is None else out.union(one)
    return out.distinct()


def metrics(bundle: dict[str, DataFrame]) -> DataFrame:
    """One row of measures of a bundle."""
    s, d, e, q = bundle["summaries"], bundle["daily_summaries"], bundle["activity_entities"], bundle["evidence_quality"]
    kind = F.col("entity_type")
    task = F.lit(False)
    for hint in TASK_HINTS:
        task = task | F.lower(kind).contains(hint)
    rows = e.agg(F.count("*").alias("activity_entity_count"), F.count_if(kind.isin(FILE_TYPES)).alias("file_entity_count"), F.count_if(task).alias("task_candidate_count"), F.count_if(kind.isin(TALK_TYPES)).alias("conversation_entity_count"))
    event = F.coalesce(F.col("summary_kind"), F.lit("event")) != "daily"
    bare = ~F.coalesce("has_file_evidence", F.lit(False)) & ~F.coalesce("has_task_evidence", F.lit(False)) & ~F.coalesce("has_conversation_evidence", F.lit(False))
    quality = q.agg(
        F.coalesce(F.round(F.avg("score"), 3), F.lit(0.0)).alias("average_score"), *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in BUCKETS], F.count_if("degraded_payload").alias("degraded_payload_count"),
        F.count_if(event & bare).alias("raw_only_event_summary_count"),
    )
    n = s.agg(F.count("*").alias("event_summary_count"))
    days = bundle_days(s, d, q).agg(F.min("day").alias("date_range_start"), F.max("day").alias("date_range_end"))
    missing = bundle_days(s).subtract(bundle_days(d)).agg(F.array_sort(F.collect_set("day")).alias("missing_daily_recap_days"))
    out = n.crossJoin(d.agg(F.count("*").alias("daily_summary_count"))).crossJoin(rows).crossJoin(quality).crossJoin(days).crossJoin(missing)
    per = F.when(F.col("event_summary_count") > 0, F.round(F.col("activity_entity_count") / F.col("event_summary_count"), 2)).otherwise(0.0)
    return out.withColumn("entities_per_summary", per)


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """Change of every number between two one-row metrics."""
    numbers = [c for c, t in now.dtypes if t in ("bigint", "int", "double")]
    b = before.select(*[F.col(c).alias(f"_{c}") for c in numbers])
    return now.select(*numbers).crossJoin(b).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in numbers])


def recommendations(m) -> list[str]:
    """Advice on one row of ``metrics``."""
    out, rows, weak, good = [], max(1, m.event_summary_count + m.daily_summary_count), m.n_weak + m.n_poor, m.n_good + m.n_excellent
    if m.raw_only_event_summary_count / max(1, m.event_summary_count) >= 0.4:
        out.append("Many summaries rest on process and window names alone: extract more files, tasks and conversations.")
    if m.missing_daily_recap_days:
        out.append("Active days lack a daily recap: check how days are reconciled.")
    if m.degraded_payload_count / rows >= 0.15:
        out.append("Many payloads are degraded: tighten the prompt or repair responses.")
    if m.file_entity_count >= 5 and m.task_candidate_count <= max(1, m.file_entity_count // 3):
        out.append("Files are well covered, tasks are not: improve the search for task labels.")
    if good / rows >= 0.7 and not weak:
        out.append("Evidence is mostly good or excellent.")
    return out or ["Nothing stands out."]


def render(m) -> str:
    """A plain-text report of one row of ``metrics``."""
    lines = [f"{k}: {v:,}" if isinstance(v, int) else f"{k}: {v}" for k, v in m.asDict().items()]
    return "\n".join([*lines, "", *[f"- {r}" for r in recommendations(m)]]) + "\n"


def redact(df: DataFrame, **columns: bool) -> DataFrame:
    """Named columns replaced where their flag is set."""
    return df.withColumns({c: F.lit("[REDACTED]") for c, on in columns.items() if on}) if any(columns.values()) else df


def summary_rows(summaries: DataFrame) -> DataFrame:
    """Audit form of event summaries."""
    doc = F.try_parse_json("summary_json")
    get = lambda p, t="string": F.try_variant_get(doc, p, t)
    return summaries.select(
        F.col("id").alias("summary_id"), "job_id", F.to_date(F.timestamp_seconds("start_ts")).cast("string").alias("day"), "start_ts", "end_ts", F.coalesce(get("$.source_context.process_name"), F.lit("")).alias("process_name"),
        F.coalesce(get("$.source_context.window_title"), F.lit("")).alias("window_title"), "summary_text", get("$.metadata.included_counts.screenshots", "int").alias("screenshot_count"),
        get("$.metadata.included_counts.text_segments", "int").alias("text_segment_count"), get("$.metadata.schema").alias("prompt_name"), get("$.model_name").alias("model_name"), F.col("created_ts").alias("created_at"),
    )


def daily_rows(recaps: DataFrame) -> DataFrame:
    """Audit form of recaps."""
    doc = F.try_parse_json("recap_json")
    return recaps.select("day", F.col("id").alias("daily_summary_id"), F.try_variant_get(doc, "$.job_id", "string").alias("job_id"), F.col("recap_text").alias("summary_text"), F.col("source_batch_count").alias("source_summary_count"),
                         F.try_variant_get(doc, "$.metadata.schema", "string").alias("prompt_name"), F.try_variant_get(doc, "$.model_name", "string").alias("model_name"), F.col("created_ts").alias("created_at"))


def coalesced_rows(rows: DataFrame) -> DataFrame:
    """Audit form of coalesced summaries (with summary_ids)."""
    doc = F.try_parse_json("summary_json")
    return rows.select(F.col("id").alias("coalesced_id"), "day", "start_ts", "end_ts", "summary_text", F.col("summary_ids").alias("member_summary_ids"), F.size("summary_ids").alias("member_count"),
                       F.try_variant_get(doc, "$.confidence_bucket", "string").alias("confidence_bucket"), F.try_variant_get(doc, "$.merge_score", "double").alias("merge_score_aggregate"), F.col("created_ts").alias("created_at"))


def diagnostic_rows(rows: DataFrame, s: CoalesceSettings = CoalesceSettings()) -> DataFrame:
    """Audit form of merge diagnostics, with the settings they were made with."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in vars(s).items() if not isinstance(v, tuple)])
    return rows.select("day", "left_summary_id", "right_summary_id", "decision", F.col("final_merge_score").alias("merge_score"), F.col("embedding_cosine_similarity").alias("embedding_similarity"), "temporal_gap_seconds",
                       (F.col("app_similarity_score") > 0).alias("same_app"), (F.col("window_similarity_score") > 0).alias("same_window"), F.col("blockers").alias("reason"), F.col("reasons").alias("diagnostic_flags"),
                       settings.alias("semantic_parameters"), F.col("created_ts").alias("created_at"))


COVERAGE = "array<struct<process_name:string,normalized_process_name:string,window_title:string,normalized_window_title:string,matched_parser_names:array<string>,used_generic_parser:boolean,used_specialized_parser:boolean,extracted_entity_count:int,unclassified_evidence_count:int,parser_confidence:double,unknown_app:boolean,start_ts:double,end_ts:double>>"


def coverage_rows(summaries: DataFrame) -> DataFrame:
    """Parser coverage of the payloads, one row per item, with pos."""
    items = F.from_json(F.get_json_object("summary_json", "$.parser_coverage"), COVERAGE)
    one = summaries.select(F.col("id").alias("summary_id"), "job_id", F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"), F.col("created_ts").alias("created_at"), F.posexplode(items).alias("i", "x")).where("x is not null")
    out = one.select("summary_id", "job_id", F.to_date(F.timestamp_seconds("_s")).cast("string").alias("day"), "x.*", F.struct("summary_id", "i").alias("pos"), "created_at", "_s", "_e")
    return out.withColumns({"start_ts": F.coalesce("start_ts", "_s"), "end_ts": F.coalesce("end_ts", "_e")}).drop("_s", "_e").na.fill(False, ["unknown_app", "used_generic_parser", "used_specialized_parser"])
