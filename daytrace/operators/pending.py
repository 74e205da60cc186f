"""Pending rows: scans with a limit, the expansion of limits before exclusion, and whether work is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.operators.segments import without_reserved

#: Rows that count as backlog (fixed values).
BACKLOG = ["intervals", "key_events", "processed_key_events", "text_segments", "screenshots"]


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int) -> DataFrame:
    """Of each key the first rows in order, one at least."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(1, limit)).drop("_k")


def pending_intervals(intervals: DataFrame, keys: Sequence[str], limit: int = 10_000) -> DataFrame:
    """Closed intervals that no summary has, by start."""
    return first_rows(intervals.where(F.col("end_ts").isNotNull() & ~F.coalesce("summarized", F.lit(False))), keys, ["start_ts", "id"], limit)


def pending_texts(texts: DataFrame, keys: Sequence[str], limit: int = 200) -> DataFrame:
    """Text segments that no summary has, by start."""
    return first_rows(texts.where(~F.coalesce("summarized", F.lit(False))), keys, ["start_ts", "id"], limit)


def pending_screenshots(shots: DataFrame, keys: Sequence[str], limit: int = 20) -> DataFrame:
    """Screenshots that no summary has, oldest first."""
    return first_rows(shots.where(~F.coalesce("summarized", F.lit(False))), keys, ["ts", "id"], limit)


def fetch_limit(limit: int, ranges: int, deduped: bool = False) -> int:
    """How many rows to fetch so that ``limit`` may be left when reserved ranges and duplicates go."""
    return 0 if limit <= 0 else limit * (ranges + 1) * (5 if deduped else 1)


def unreserved(rows: DataFrame, keys: Sequence[str], ranges: DataFrame, limit: int, deduped: bool = False) -> DataFrame:
    """Of each key's first rows by start, as many as ``fetch_limit`` says, the first ``limit`` that overlap no range."""
    some = first_rows(rows, keys, ["start_ts", "id"], fetch_limit(limit, ranges.count(), deduped))
    return first_rows(without_reserved(some, ranges, F.col("start_ts"), F.coalesce("end_ts", "start_ts")), keys, ["start_ts", "id"], limit)


def has_backlog(counts: DataFrame) -> DataFrame:
    """Whether any kind of pending row is left."""
    left = F.lit(False)
    for name in BACKLOG:
        left = left | (F.coalesce(name, F.lit(0)) > 0)
    return counts.withColumn("backlog", left)
