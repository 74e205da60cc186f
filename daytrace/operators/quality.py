"""Evidence scores of event summaries and days: sums of weighted flags, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = [
    "degraded", "process_evidence", "title_evidence", "has_file_evidence", "has_task_evidence", "has_conversation_evidence", "has_text_evidence", "has_screenshot_evidence",
    "confident_outcomes", "unknown_app", "blocked", "has_summary_text",
]


def bucket(score: Column) -> Column:
    """A10: excellent from 0.85, good from 0.65, weak from 0.35, else poor."""
    return F.when(score >= 0.85, "excellent").when(score >= 0.65, "good").when(score >= 0.35, "weak").otherwise("poor")


def unit_round(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 3)))


def event_score(df: DataFrame) -> DataFrame:
    """Add score, bucket, strengths and weaknesses from FLAGS, parser_confidence, n_entities and n_low (confidence under 0.8)."""
    c = F.col
    derived = c("has_file_evidence") | c("has_task_evidence") | c("has_conversation_evidence")
    many_low = (c("n_low") > 0) & (c("n_low") >= F.greatest(F.lit(3), F.floor(c("n_entities") / 2) + 1))
    confidence = c("parser_confidence")
    # (condition, points, strength, weakness where it holds, weakness where it doesn't), in the order of the list
    rules: list[tuple[Column, float, str | None, str | None, str | None]] = [
        (~c("degraded"), 0.12, "structured payload validated", None, None),
        (c("degraded"), -0.15, None, "structured payload degraded", None),
        (c("process_evidence"), 0.07, "process evidence present", None, "no process evidence"),
        (c("title_evidence"), 0.06, "window title evidence present", None, "no window title evidence"),
        (c("has_file_evidence"), 0.20, "file evidence present", None, "no file evidence"),
        (c("has_task_evidence"), 0.16, "task evidence present", None, "no task evidence"),
        (c("has_conversation_evidence"), 0.10, "conversation evidence present", None, None),
        (c("has_text_evidence"), 0.07, "text evidence present", None, "no text evidence"),
        (c("has_screenshot_evidence"), 0.05, "screenshot evidence present", None, None),
        (c("confident_outcomes"), 0.05, "confident outcomes present", None, None),
        (confidence >= 0.75, 0.04, "specialized parser coverage strong", None, None),
        ((confidence >= 0.45) & (confidence < 0.75), 0.02, "generic parser coverage usable", None, None),
        (c("unknown_app") & ~derived, -0.12, None, "unknown app with no derived entities", None),
        (c("unknown_app") & derived, 0.0, None, "unknown app handled via generic parsers", None),
        (~derived, -0.10, None, "only raw process/window evidence", None),
        (many_low, -0.06, None, "many low-confidence entities", None),
        (~derived & c("has_summary_text"), -0.05, None, "generic summary text without concrete entities", None),
        (c("blocked"), -0.10, None, "blocked or privacy-heavy interval", None),
    ]
    score = F.lit(0.05)
    for when, points, *_ in rules:
        score = score + F.when(when, points).otherwise(0.0)
    out = df.withColumn("score", unit_round(score)).withColumn("bucket", bucket(c("score")))
    last = {"excellent": "strong evidence for historical reconstruction", "good": "usable evidence for diary reconstruction", "weak": "usable only with caution", "poor": "insufficient evidence for reliable reconstruction"}
    plus = [F.when(w, F.lit(s)) for w, _, s, _, _ in rules if s] + [F.when(c("bucket") == b, F.lit(last[b])) for b in ("excellent", "good")]
    minus = [F.when(w, F.lit(a)) if a else F.when(~w, F.lit(b)) for w, _, _, a, b in rules if a or b] + [F.when(c("bucket") == b, F.lit(last[b])) for b in ("weak", "poor")]
    return out.withColumns({"strengths": F.array_compact(F.array(*plus)), "weaknesses": F.array_compact(F.array(*minus))})


def mean_confidence(items: Column) -> Column:
    """Mean of an array of confidences to three places; 0 of none."""
    total = F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(F.size(items) > 0, F.round(total / F.size(items), 3)).otherwise(0.0)


def any_confident(confidences: Column, least: float = 0.6) -> Column:
    """Any outcome of at least this confidence."""
    return F.coalesce(F.exists(confidences, lambda x: x.try_cast("double") >= least), F.lit(False))


def some_confident(confidence: Column, least: float = 0.6) -> Column:
    """X29 as an aggregate over rows of one outcome each, so that no list of them is made."""
    return F.coalesce(F.bool_or(confidence.try_cast("double") >= least), F.lit(False))


def entity_counts(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A map from entity type to count per key."""
    n = entities.groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_counts_by_type"))


def only_unclassified(counts: Column, unknown_app: Column) -> Column:
    """An unknown app of which there are but its name and titles."""
    rest = F.array_except(F.map_keys(counts), F.array(F.lit("program"), F.lit("window_title"), F.lit("unclassified_window_title")))
    return F.coalesce((F.size(counts) > 0) & (F.size(rest) == 0) & unknown_app, F.lit(False))


#: Points of what a day's recap holds.
RECAP = {
    "has_executive_summary": 0.05, "has_breakdown": 0.04, "has_files": 0.05, "has_tasks": 0.05, "has_conversations": 0.04, "has_decisions": 0.03, "has_follow_ups": 0.03, "has_notes": 0.03,
}


def daily_score(recaps: DataFrame, events: DataFrame) -> DataFrame:
    """Recaps (day, the RECAP flags, degraded) scored with the events of their day (day, score, flags)."""
    flags = ["has_file_evidence", "has_task_evidence", "has_conversation_evidence", "has_text_evidence", "has_screenshot_evidence", "blocked", "unknown_app"]
    days = events.groupBy("day").agg(F.count("*").alias("source_summary_count"), F.avg("score").alias("source_average"), F.bool_or("degraded").alias("_degraded"), *[F.bool_or(f).alias(f) for f in flags])
    both = recaps.join(days, "day", "left").na.fill(False, [*flags, "_degraded"]).na.fill(0, ["source_summary_count"]).na.fill(0.0, ["source_average"])
    recap = F.lit(0.0)
    for name, points in RECAP.items():
        recap = recap + F.when(F.col(name), points).otherwise(0.0)
    recap = recap - F.when(F.col("degraded"), 0.10).otherwise(0.0) - F.when(F.col("blocked"), 0.03).otherwise(0.0)
    recap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), recap))
    score = F.when(F.col("source_average") != 0, F.col("source_average") * 0.78 + recap * 0.22).otherwise(recap)
    out = both.withColumn("score", unit_round(score)).withColumn("bucket", bucket(F.col("score")))
    return out.withColumn("degraded_payload", F.col("degraded") | F.col("_degraded")).withColumn("has_text_evidence", F.col("has_text_evidence") | F.col("has_executive_summary")).drop("_degraded")


def weak_days(events: DataFrame, share: float = 0.5) -> DataFrame:
    """Days on which at least this share of summaries is weak or poor."""
    n = events.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("bucket").isin("weak", "poor")).alias("n_weak"))
    return n.where(F.col("n_weak") >= F.col("n") * share)


def summarize(reports: DataFrame) -> DataFrame:
    """One row over event and daily reports (summary_kind, bucket, score, flags)."""
    event = F.col("summary_kind") == "event"
    return reports.agg(
        F.count("*").alias("summary_count"), F.count_if(event).alias("event_summary_count"), F.count_if(~event).alias("daily_summary_count"),
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("excellent", "good", "weak", "poor")],
        F.coalesce(F.round(F.avg("score"), 3), F.lit(0.0)).alias("average_score"), F.count_if(F.col("bucket").isin("poor", "weak")).alias("poor_or_weak_summary_count"),
        F.count_if(event & ~F.col("has_file_evidence") & ~F.col("has_task_evidence")).alias("summaries_without_file_or_task_entities"),
        F.count_if("degraded").alias("degraded_payload_count"), F.count_if(event & F.col("unknown_app")).alias("unknown_app_count"),
    )
