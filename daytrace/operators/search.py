"""Searches of summaries and diagnostics: literal substrings, day scopes, unions of hits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(c: Column, query: str) -> Column:
    """Holds the query literally, in any case."""
    return F.lower(c).contains(query.lower())


def scope_days(scope: str, anchor: date) -> tuple[date | None, date | None]:
    """First day and the day after the last of day, month, year or all."""
    if scope == "all":
        return None, None
    if scope == "day":
        return anchor, anchor + timedelta(days=1)
    if scope == "month":
        first = anchor.replace(day=1)
        return first, (first + timedelta(days=32)).replace(day=1)
    if scope == "year":
        return date(anchor.year, 1, 1), date(anchor.year + 1, 1, 1)
    raise ValueError(f"no such scope: {scope}")


def day_start(day: date) -> float:
    """Epoch seconds at which a day begins; days are those of UTC sessions."""
    return datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp()


def in_range(c: Column, low, high) -> Column:
    """Half-open; None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low))
    if high is not None:
        out = out & (c < F.lit(high))
    return out


def _latest(hits: DataFrame, at: str, limit: int | None) -> DataFrame:
    """The latest hits in order; without a limit all of them, in no order."""
    return hits if limit is None else hits.orderBy(F.desc(at), F.desc("id")).limit(limit)


def search_events(events: DataFrame, query: str, start_ts: float | None = None, end_ts: float | None = None, limit: int | None = 1000) -> DataFrame:
    """Event summaries, latest first; all of them, unordered, if the limit is None."""
    return _latest(events.where(contains(F.col("summary_text"), query) & in_range(F.col("start_ts"), start_ts, end_ts)), "start_ts", limit)


def search_days(recaps: DataFrame, query: str, first: date | None = None, after: date | None = None, limit: int | None = 1000) -> DataFrame:
    """Daily recaps, latest day first; all of them, unordered, if the limit is None."""
    iso = lambda d: None if d is None else d.isoformat()
    return _latest(recaps.where(contains(F.col("recap_text"), query) & in_range(F.col("day"), iso(first), iso(after))), "day", limit)


def search_all(events: DataFrame, recaps: DataFrame, query: str, scope: str, anchor: date, limit: int | None = 2000) -> DataFrame:
    """Hits of both kinds (summary_type, source_id, timestamp, day, text), latest first; a blank query has none.

    ``limit`` is per kind. If it is None, the one sort is that of the union, over ranges of all tasks.
    """
    query = query.strip()
    first, after = scope_days(scope, anchor)
    at = lambda d: None if d is None else day_start(d)
    e = search_events(events, query, at(first), at(after), limit).select(
        F.lit("event").alias("summary_type"), F.col("id").alias("source_id"), F.col("start_ts").alias("timestamp"), F.to_date(F.timestamp_seconds("start_ts")).cast("string").alias("day"), F.trim("summary_text").alias("text"))
    d = search_days(recaps, query, first, after, limit).select(F.lit("day").alias("summary_type"), F.col("id").alias("source_id"), F.col("created_ts").alias("timestamp"), "day", F.trim("recap_text").alias("text"))
    hits = e.unionByName(d).where(F.lit(bool(query)))
    return hits.orderBy(F.desc("timestamp"), F.desc("summary_type"), F.desc("source_id"))


def filter_diagnostics(diagnostics: DataFrame, day: str | None = None, decision: str | None = None, text: str | None = None, ids: Sequence[int] = (), below: float | None = None, sort: str = "id", limit: int = 500) -> DataFrame:
    """By day, decision, text in blockers or reasons, ids on either side, score below."""
    out = diagnostics
    if day:
        out = out.where(F.col("day") == day)
    if decision:
        out = out.where(F.col("decision") == decision)
    if text and text.strip():
        out = out.where(contains(F.array_join("blockers", " "), text.strip()) | contains(F.array_join("reasons", " "), text.strip()))
    if ids:
        out = out.where(F.col("left_summary_id").isin(*ids) | F.col("right_summary_id").isin(*ids))
    if below is not None:
        out = out.where(F.col("final_merge_score") < below)
    return out.orderBy(*([F.desc(sort)] if sort != "id" else []), "id").limit(max(1, limit))


def effective_summaries(raw: DataFrame, coalesced: DataFrame) -> DataFrame:
    """A day's coalesced summaries where it has any, else its raw ones; both have day."""
    return coalesced.unionByName(raw.join(coalesced.select("day").distinct(), "day", "left_anti"), allowMissingColumns=True)


def cards(rows: DataFrame) -> DataFrame:
    """O3: order of a day view, latest first."""
    return rows.orderBy(F.desc("end_ts"), F.desc("start_ts"), F.desc("id"))


def day_signature(rows: DataFrame, day: str = "day") -> DataFrame:
    """A number per day that changes with any of its rows."""
    return rows.groupBy(day).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns if c != day])))).alias("signature"))
