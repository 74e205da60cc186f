"""Activity segments: observations of four kinds, folded by context; batches of closed segments.

Only the full segmenter is order-dependent (its context is the running mode of a segment). It folds islands that an idle
gap separates anyway, so a key's history is cut into groups of some islands that run in parallel.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.config import SegmentSettings
from daytrace.functions.similarity import known_ratio
from daytrace.functions.text import normalize_title
from daytrace.operators.folds import fold_sorted
from daytrace.operators.intervals import idle_segments

OBSERVATION = "start_ts DOUBLE, end_ts DOUBLE, kind STRING, process_name STRING, window_title STRING, blocked BOOLEAN, active_interval_id BIGINT, screenshot_id BIGINT, fingerprint STRING, text STRING, hotkeys ARRAY<STRING>"
SEGMENT = (
    "segment_id STRING, start_ts DOUBLE, end_ts DOUBLE, process_names ARRAY<STRING>, window_titles ARRAY<STRING>, blocked BOOLEAN, active_interval_ids ARRAY<BIGINT>, "
    "screenshot_ids ARRAY<BIGINT>, text_snippets ARRAY<STRING>, hotkeys ARRAY<STRING>, observation_count INT, screenshot_count INT, text_segment_count INT, duration_s DOUBLE, "
    "idle_gap_s DOUBLE, closure_reason STRING, is_closed BOOLEAN, process_name STRING, window_title STRING, visual_similarity DOUBLE"
)


def observations(intervals: DataFrame, blocked: DataFrame, texts: DataFrame, shots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The four relations as observations; an open interval ends where it starts."""
    end = F.coalesce("end_ts", "start_ts").alias("end_ts")
    part = lambda df, kind, *cols: df.select(*keys, *cols, F.lit(kind).alias("kind"))
    parts = [
        part(intervals, "active_interval", "start_ts", end, "process_name", "window_title", "blocked", F.col("id").alias("active_interval_id")),
        part(blocked, "blocked_interval", "start_ts", end, "process_name", "window_title", F.lit(True).alias("blocked"), "active_interval_id"),
        part(texts, "text_segment", "start_ts", "end_ts", "process_name", "window_title", F.lit(False).alias("blocked"), "text", "hotkeys"),
        part(shots, "screenshot", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), "process_name", "window_title", F.lit(False).alias("blocked"), "active_interval_id",
             F.col("id").alias("screenshot_id"), F.coalesce(F.nullif("perceptual_hash", F.lit("")), "fingerprint").alias("fingerprint")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dominant(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """Most frequent non-empty value per key; the one seen first among equals."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_first")).alias(out))


def segment_id(start_ts: float, end_ts: float, processes: Sequence[str], titles: Sequence[str]) -> str:
    """Sixteen hex digits of a SHA-1 over times and names."""
    return hashlib.sha1(f"{start_ts:.3f}|{end_ts:.3f}|{','.join(processes)}|{','.join(titles)}".encode()).hexdigest()[:16]


def _mode(counts: Counter) -> str:
    return max(counts, key=counts.__getitem__) if counts else ""


class Open:
    """The segment being built: what its end needs of the observations so far."""

    def __init__(self, row):
        self.start, self.end, self.gap, self.blocked, self.visual, self.shot = row.start_ts, row.end_ts, 0.0, bool(row.blocked), None, None
        self.count = self.shots = 0
        # names in order of appearance with their frequency, and titles in normal form
        self.processes, self.titles, self.norms = Counter(), Counter(), {}
        # ordered sets, and the texts
        self.interval_ids, self.screenshot_ids, self.hotkeys, self.texts = {}, {}, {}, []
        self.add(row, None)

    def add(self, row, visual: float | None) -> None:
        self.gap = max(self.gap, row.start_ts - self.end)
        self.end = max(self.end, row.end_ts)
        self.visual = self.visual if visual is None else visual
        self.count += 1
        if row.process_name:
            self.processes[row.process_name] += 1
        if row.window_title:
            self.titles[row.window_title] += 1
            self.norms.setdefault(row.window_title, row.norm_title or "")
        if pd.notna(row.active_interval_id):
            self.interval_ids[int(row.active_interval_id)] = None
        if pd.notna(row.screenshot_id):
            self.screenshot_ids[int(row.screenshot_id)] = None
            self.shots += 1
        if row.text:
            self.texts.append(row.text)
        if row.hotkeys is not None:
            self.hotkeys.update(dict.fromkeys(row.hotkeys))
        self.shot = row.fingerprint or self.shot

    def closes(self, row, s: SegmentSettings) -> tuple[str | None, float | None]:
        """Reason to close before ``row``, and how alike the last two screenshots are."""
        if max(0.0, row.start_ts - self.end) >= s.idle_gap_s:
            return "idle_gap", None
        if 0 < s.max_duration_s <= self.end - self.start:
            return "max_duration_reached", None
        if bool(row.blocked) != self.blocked:
            return "lock_state_changed", None
        other = (row.process_name or "") != _mode(self.processes)
        title = known_ratio(row.norm_title or "", self.norms.get(_mode(self.titles), ""))
        if other and title < s.title_similarity:
            return "app_changed", None
        visual = _bits_alike(self.shot, row.fingerprint)
        if visual is not None and visual < s.screenshot_similarity and title < 0.9:
            return "visual_context_changed", visual
        if other and title < 0.45:
            return "window_changed_significantly", visual
        return None, visual

    def done(self, reason: str, visual: float | None, closed: bool) -> dict:
        processes, titles = list(self.processes), list(self.titles)
        return {
            "segment_id": segment_id(self.start, self.end, processes, titles), "start_ts": self.start, "end_ts": self.end, "process_names": processes, "window_titles": titles,
            "blocked": self.blocked, "active_interval_ids": list(self.interval_ids), "screenshot_ids": list(self.screenshot_ids), "text_snippets": list(self.texts), "hotkeys": list(self.hotkeys),
            "observation_count": self.count, "screenshot_count": self.shots, "text_segment_count": len(self.texts), "duration_s": self.end - self.start,
            "idle_gap_s": self.gap if self.gap > 0 else None, "closure_reason": reason, "is_closed": closed, "process_name": _mode(self.processes), "window_title": _mode(self.titles),
            "visual_similarity": self.visual if visual is None else visual,
        }


def _bits_alike(a, b) -> float | None:
    try:
        return max(0.0, 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (len(a) * 4)) if a and b else None
    except (TypeError, ValueError):
        return None


def fold(rows: pd.DataFrame, settings: SegmentSettings, last: str, closed: bool) -> list[dict]:
    """Segments of observations in order; the last one ends for ``last``."""
    out: list[dict] = []
    now: Open | None = None
    for row in rows.itertuples(index=False):
        if now is None:
            now = Open(row)
            continue
        reason, visual = now.closes(row, settings)
        if reason:
            out.append(now.done(reason, visual, True))
            now = Open(row)
        else:
            now.add(row, visual)
    if now is not None:
        out.append(now.done(last, None, closed))
    return out


#: Islands of a group: enough to outweigh the cost of a group, few enough to bound it.
ISLANDS = 256


def segments(obs: DataFrame, keys: Sequence[str], settings: SegmentSettings = SegmentSettings(), force_flush: bool = False) -> DataFrame:
    """Segments of each key's observations. An island's last segment closes for its idle gap, the key's last is open or flushed."""
    keys = list(keys)
    kinds = dict(obs.dtypes)
    tie = ["end_ts", "kind", F.coalesce("active_interval_id", "screenshot_id", F.lit(0).cast("bigint"))]
    gap = settings.idle_gap_s or 1e-9
    cut = idle_segments(obs, keys, "start_ts", tie, gap, "end_ts").withColumn("norm_title", normalize_title(F.coalesce("window_title", F.lit(""))))
    cut = cut.withColumn("island_group", F.floor((F.col("segment") - 1) / ISLANDS))
    cut = cut.withColumn("last_group", F.max("island_group").over(Window.partitionBy(*keys)))
    cut = cut.withColumn("tie_id", F.coalesce("active_interval_id", "screenshot_id", F.lit(0).cast("bigint")))
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def told(key: tuple, segment: dict) -> tuple:
        return *key[: len(keys)], *(segment[n] for n in names)

    def step(state: list, row) -> list[tuple]:
        # the open segment, and whether the group is its key's last
        state[1] = row.island_group == row.last_group
        now, reason, visual = state[0], None, None
        if now is not None:
            reason, visual = now.closes(row, settings)
        if now is None or reason:
            state[0] = Open(row)
        else:
            now.add(row, visual)
        return [told(tuple(getattr(row, k) for k in keys), now.done(reason, visual, True))] if reason else []

    def end(key: tuple, state: list) -> list[tuple]:
        now, final = state
        reason = ("manual_flush" if force_flush else "open") if final else "idle_gap"
        return [told(key, now.done(reason, None, force_flush or not final))]

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [SEGMENT])
    return fold_sorted(cut, [*keys, "island_group"], ["start_ts", "end_ts", "kind", "tie_id"], schema, lambda: [None, False], step, end)


def batch_prefix(segs: DataFrame, keys: Sequence[str], duration: str, order: Sequence[str], minimum_s: float) -> DataFrame:
    """Per key, the shortest prefix of segments that lasts at least ``minimum_s`` together; keys that never do have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(duration).over(Window.partitionBy(*keys))
    out = segs.withColumn("accumulated_s", total).withColumn("_whole", whole)
    return out.where((F.col("accumulated_s") - F.col(duration) < minimum_s) & (F.col("_whole") >= minimum_s)).drop("_whole")


def pending_batches(segs: DataFrame, rows: DataFrame, keys: Sequence[str], minimum_s: float, force_flush: bool = False) -> DataFrame:
    """All pending ``rows`` (with end_ts) that end by the end of the key's chosen segments, with that end as ``batch_end``.

    Chosen is the prefix of closed segments; a forced flush without one takes the key's last segment.
    """
    closed = batch_prefix(segs.where("is_closed"), keys, "duration_s", ["start_ts", "end_ts"], minimum_s)
    ends = closed.groupBy(*keys).agg(F.max_by("end_ts", F.struct("start_ts", "end_ts")).alias("batch_end"))
    if force_flush:
        last = segs.groupBy(*keys).agg(F.max_by("end_ts", F.struct("start_ts", "end_ts")).alias("_last"))
        ends = last.join(ends, list(keys), "left").select(*keys, F.coalesce("batch_end", "_last").alias("batch_end"))
    return rows.join(ends, list(keys)).where(F.col("end_ts") <= F.col("batch_end"))


def batch_span(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earliest start and latest end of a batch's rows of all kinds."""
    return rows.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"), F.max(F.coalesce("end_ts", "start_ts")).alias("end_ts"), F.count("*").alias("n"))


#: Reserved ranges that rows are compared with.
MOST_RANGES = 10_000


def without_reserved(rows: DataFrame, ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that overlap no reserved range (from_ts, to_ts; closed).

    Ranges are as many as jobs in flight, which is checked: a comparison with each of them is only for few.
    """
    n = ranges.count()
    if n > MOST_RANGES:
        raise ValueError(f"{n} reserved ranges; {MOST_RANGES} are the most")
    r = F.broadcast(ranges.select(F.col("from_ts").alias("_from"), F.col("to_ts").alias("_to")))
    return rows.join(r, (start <= F.col("_to")) & (F.col("_from") <= end), "left_anti")


#: Columns of a batch's parts, as they are serialized (fixed values), and how many rows of a part a batch takes at most.
BATCH_PARTS = {
    "activity_segments": [c.split()[0] for c in SEGMENT.split(", ")],
    "active_intervals": ["start_ts", "end_ts", "process_name", "window_title", "blocked"],
    "blocked_intervals": ["start_ts", "end_ts", "process_name", "window_title"],
    "text_segments": ["start_ts", "end_ts", "process_name", "window_title", "text", "hotkeys", "raw_key_count"],
    "screenshots": ["ts", "file_path", "process_name", "window_title", "fingerprint", "exact_hash", "perceptual_hash", "nearest_phash_distance", "nearest_ssim", "dedup_reason", "visual_context_streak"],
}
BATCH_ROWS = {"text_segments": 400, "screenshots": 3}


def serialized_batches(parts: dict[str, DataFrame], keys: Sequence[str], most: dict[str, int] | None = None) -> DataFrame:
    """Per key one batch: start_ts, end_ts and, for each part, the JSON objects of its rows in order of time, with every field.

    Columns that a part lacks are null. Of a part with a limit only the first rows are gathered. A batch spans the rows
    that it has; a key without rows has no batch, a part without rows no members.
    """
    keys, most = list(keys), BATCH_ROWS if most is None else most
    told = []
    for name, df in parts.items():
        time = "ts" if "ts" in df.columns else "start_ts"
        end = F.coalesce(F.col("end_ts"), F.col(time)) if "end_ts" in df.columns else F.col(time)
        fields = F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in BATCH_PARTS[name]])
        row = F.to_json(fields, {"ignoreNullFields": "false"})
        one = df.select(*keys, F.lit(name).alias("part"), F.col(time).alias("from_ts"), end.alias("to_ts"), row.alias("json"))
        if name in most:
            w = Window.partitionBy(*keys).orderBy("from_ts", "to_ts", "json")
            one = one.withColumn("_nr", F.row_number().over(w)).where(F.col("_nr") <= most[name]).drop("_nr")
        told.append(one)
    every = reduce(DataFrame.unionByName, told)
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("from_ts", "to_ts", "json")))), lambda x: x["json"])
    return every.groupBy(*keys).agg(F.min("from_ts").alias("start_ts"), F.max("to_ts").alias("end_ts"), *[ordered(name).alias(name) for name in parts])
