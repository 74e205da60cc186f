"""Stored rows as records: JSON columns parsed, values typed, orders of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daytrace.schemas import RELATIONS


def json_object(c: Column) -> Column:
    """A JSON object as a variant; null for anything else, as a recap may hold a list or text."""
    parsed = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def string_list(c: Column) -> Column:
    """A JSON list of strings; empty if it isn't one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _typed(df: DataFrame, relation: str, but: Sequence[str] = ()) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RELATIONS[relation]) if f.name in df.columns and f.name not in but]


def summaries(df: DataFrame) -> DataFrame:
    """Event summaries, their payload parsed."""
    return df.select(*_typed(df, "summaries", ["summary_json"]), json_object(F.col("summary_json")).alias("payload"))


def recaps(df: DataFrame) -> DataFrame:
    """Daily recaps; a payload that is no object is null, a day that is no date too."""
    return df.select(*_typed(df, "daily_summaries", ["recap_json", "day"]), F.col("day").try_cast("date").alias("day"), json_object(F.col("recap_json")).alias("payload"))


def diagnostics(df: DataFrame) -> DataFrame:
    """Merge diagnostics with their lists parsed (blockers_json, reasons_json)."""
    return df.select(*_typed(df, "semantic_merge_diagnostics", ["day"]), F.col("day").try_cast("date").alias("day"), string_list(F.col("blockers_json")).alias("blockers"), string_list(F.col("reasons_json")).alias("reasons"))


def entities(df: DataFrame) -> DataFrame:
    """Activity entities with their attributes parsed, under the name that audits give the id."""
    return df.select(F.col("id").cast("bigint").alias("activity_entity_id"), *_typed(df, "activity_entities", ["id", "attributes_json"]), json_object(F.col("attributes_json")).alias("attributes"))


def jobs(df: DataFrame) -> DataFrame:
    """Summary jobs."""
    return df.select(*_typed(df, "summary_jobs"))


def job(df: DataFrame, job_id: int) -> DataFrame:
    """The job with an id."""
    return jobs(df.where(F.col("id") == job_id))


def recap_of(df: DataFrame, day: str) -> DataFrame:
    """The recap of a day."""
    return recaps(df.where(F.col("day") == day))


def report_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Score, bucket and flags of stored quality reports; missing ones are 0, poor and false."""
    return df.withColumns({"score": F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)), "bucket": F.coalesce(F.nullif("bucket", F.lit("")), F.lit("poor")), **{f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags}})


def unclean_runs(states: DataFrame) -> DataFrame:
    """Previous runs that did not end cleanly, of session states as JSON (state); none of a missing state."""
    doc = json_object(F.col("state"))
    clean = F.coalesce(F.try_variant_get(doc, "$.clean_shutdown", "boolean"), F.lit(False))
    return states.where(doc.isNotNull() & ~clean).withColumns({n: F.try_variant_get(doc, f"$.{n}", "string") for n in ("session_id", "pid", "app_version")})


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with its place (1, 2, ...) in an order of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


#: Order of entity drafts; O7: of quality reports, null kinds and days first; O2: of summaries to coalesce; O3: of cards.
DRAFT_ORDER = ["entity_type", "source_kind", "entity_normalized", "source_ref"]
REPORT_ORDER = ["summary_kind", "day", "start_ts", "end_ts", "summary_id"]
SUMMARY_ORDER = ["start_ts", "end_ts", "id"]


def card_order() -> list[Column]:
    return [F.desc("end_ts"), F.desc("start_ts"), F.desc("id")]
