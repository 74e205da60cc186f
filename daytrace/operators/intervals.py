"""Intervals and segments from point observations: gaps and islands by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idle_segments(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], gap_s: float, end: str | None = None) -> DataFrame:
    """Add ``segment`` (1, 2, ...): a new one starts where ts is ``gap_s`` or more after the largest end before it.

    Rows without a time sort first and never open a gap.
    """
    w = Window.partitionBy(*keys).orderBy(ts, *tie)
    before = F.max(end or ts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col(ts) - before >= gap_s), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn("segment", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def runs(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], context: Sequence[str]) -> DataFrame:
    """One row per run of equal ``context``: run number, start_ts, end_ts (start of the next run, null while open), n."""
    w = Window.partitionBy(*keys).orderBy(ts, *tie)
    row = F.struct(*context)
    changed = F.when(F.lag(row).over(w).isNull() | ~F.lag(row).over(w).eqNullSafe(row), 1).otherwise(0)
    numbered = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy(*keys, "run").agg(*[F.first(c).alias(c) for c in context], F.min(ts).alias("start_ts"), F.count("*").alias("n"))
    return spans.withColumn("end_ts", F.lead("start_ts").over(Window.partitionBy(*keys).orderBy("run")))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals share a point."""
    return (a0 <= b1) & (b0 <= a1)
