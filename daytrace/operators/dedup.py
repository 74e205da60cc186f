"""Deduplication of screenshots (folds over the kept ones) and of summaries against the last few."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrace.config import ScreenshotDedupSettings, SummaryDedupSettings
from daytrace.functions.similarity import add_text_similarity, context_similarity, ratio
from daytrace.functions.text import normalize_title
from daytrace.operators.folds import fold_sorted


def _bits(a, b) -> int | None:
    try:
        return (int(a, 16) ^ int(b, 16)).bit_count() if a and b else None
    except (TypeError, ValueError):
        return None


def _clash(a, b) -> bool:
    """Both known and different."""
    return pd.notna(a) and pd.notna(b) and a != b


def selection_context_changed(a, b) -> bool:
    """By window handle if both have one, else by interval; then title and process."""
    if pd.notna(a.window_hwnd) and pd.notna(b.window_hwnd):
        if a.window_hwnd != b.window_hwnd:
            return True
    elif _clash(a.active_interval_id, b.active_interval_id):
        return True
    return a.window_title != b.window_title or a.process_name != b.process_name


def capture_context_matches(a, b) -> bool:
    """Neither window handle nor interval conflicts, and title and process are equal."""
    same = not _clash(a.window_hwnd, b.window_hwnd) and not _clash(a.active_interval_id, b.active_interval_id)
    return same and a.window_title == b.window_title and a.process_name == b.process_name


def _worth_keeping(shot, kept: Iterable, s: ScreenshotDedupSettings) -> bool:
    for old in kept:
        if selection_context_changed(shot, old):
            continue
        if 0 < s.min_interval_s <= shot.ts - old.ts:
            return True
        exact = shot.exact_hash or shot.fingerprint, old.exact_hash or old.fingerprint
        if exact[0] and exact[0] == exact[1]:
            return False
        bits = _bits(shot.perceptual_hash or shot.fingerprint, old.perceptual_hash or old.fingerprint)
        if bits is None or bits <= s.phash_distance:
            return bits is None
    return True


class Picker:
    """The first ones, in order, that differ from the last ``recent`` picked."""

    def __init__(self, settings: ScreenshotDedupSettings):
        self.s, self.recent, self.n = settings, deque(maxlen=settings.recent), 0

    def takes(self, shot) -> bool:
        if self.n >= self.s.max_selected or not _worth_keeping(shot, self.recent, self.s):
            return False
        self.recent.appendleft(shot)
        self.n += 1
        return True


def pick(shots: Iterable, s: ScreenshotDedupSettings) -> Iterator:
    """W11 over shots in order."""
    picker = Picker(s)
    return (shot for shot in shots if picker.takes(shot))


def representative_screenshots(shots: DataFrame, keys: Sequence[str], settings: ScreenshotDedupSettings = ScreenshotDedupSettings()) -> DataFrame:
    """W11 per key; rows are ordered by ts and id."""
    schema = ", ".join(f"{c} {t}" for c, t in shots.dtypes)
    take = lambda picker, shot: [tuple(shot)] if picker.takes(shot) else []
    return fold_sorted(shots, keys, ["ts", "id"], schema, lambda: Picker(settings), take)


def thumbnail_similarity(a: Sequence[int] | None, b: Sequence[int] | None) -> float | None:
    """M4 of two thumbnails' gray values, within 0..1; null if either is missing or lengths differ."""
    if a is None or b is None or len(a) != len(b) or not len(a):
        return None
    x, y = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = x.mean(), y.mean()
    found = ((2 * mx * my + c1) * (2 * ((x - mx) * (y - my)).mean() + c2)) / ((mx * mx + my * my + c1) * (x.var() + y.var() + c2))
    return float(min(1.0, max(0.0, found)))


class CaptureDedup:
    """Whether to keep each screenshot as it comes; the state is the last kept ones, the latest first.

    It may start from stored ones, which have hashes but no thumbnail.
    """

    def __init__(self, settings: ScreenshotDedupSettings = ScreenshotDedupSettings(), seed: Iterable = ()):
        self.s, self.recent, self.streak, self.last = settings, deque(seed, maxlen=settings.recent), 0, None

    def judge(self, shot) -> tuple[bool, str, int | None, float | None]:
        """(keep, reason, bits to the nearest, likeness to its thumbnail); a kept one joins the state."""
        found = self._judge(shot)
        if found[0]:
            near = self.last is not None and shot.ts - self.last < self.s.min_interval_s
            self.streak, self.last = self.streak + 1 if near else 1, shot.ts
            self.recent.appendleft(shot)
        return found

    def _judge(self, shot) -> tuple[bool, str, int | None, float | None]:
        alike = [old for old in self.recent if capture_context_matches(shot, old)]
        if not alike:
            return True, "new_context", None, None
        known = [(b, i) for i, old in enumerate(alike) if (b := _bits(shot.perceptual_hash or shot.fingerprint, old.perceptual_hash or old.fingerprint)) is not None]
        if not known:
            return True, "unmatched_context", None, None
        bits, at = min(known)
        old, s = alike[at], self.s
        soon = max(0.0, shot.ts - old.ts) < s.min_interval_s
        looks = thumbnail_similarity(getattr(shot, "thumbnail", None), getattr(old, "thumbnail", None))
        if s.exact and shot.exact_hash and shot.exact_hash == old.exact_hash:
            return not soon, "exact_duplicate" if soon else "exact_duplicate_heartbeat", bits, looks
        close = s.perceptual and bits <= s.phash_distance
        if close and s.structural and looks is not None and looks >= s.min_similarity:
            return not soon, "high_ssim_duplicate" if soon else "visual_context_heartbeat", bits, looks
        if close and soon:
            return False, "perceptual_duplicate", bits, looks
        return True, "visual_context_changed", bits, looks


DECISION = "id BIGINT, ts DOUBLE, keep BOOLEAN, reason STRING, distance INT, similarity DOUBLE, streak INT"
#: What the state keeps of a screenshot.
KEPT = "ts DOUBLE, process_name STRING, window_title STRING, window_hwnd BIGINT, active_interval_id BIGINT, exact_hash STRING, perceptual_hash STRING, fingerprint STRING, thumbnail ARRAY<INT>"


def last_stored(stored: DataFrame, keys: Sequence[str], recent: int) -> DataFrame:
    """The ``recent`` latest stored screenshots (ts, id) of each key, the state that a run starts from."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id"))
    return stored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= recent).drop("_k")


def capture_decisions(shots: DataFrame, keys: Sequence[str], settings: ScreenshotDedupSettings = ScreenshotDedupSettings(), stored: DataFrame | None = None) -> DataFrame:
    """W12 per key over a batch, in order of ts and id: keys, id, ts, keep, reason, distance, similarity, streak.

    A key's state starts from its last ``stored`` screenshots, whose thumbnails are not read.
    """
    kinds, keys = dict(shots.dtypes), list(keys)

    def judged(state: CaptureDedup, shot) -> list[tuple]:
        if not shot.is_new:
            state.recent.appendleft(shot)
            return []
        keep, reason, bits, looks = state.judge(shot)
        return [(*[getattr(shot, k) for k in keys], shot.id, shot.ts, keep, reason, bits, looks, state.streak)]

    every = shots.withColumn("is_new", F.lit(True))
    if stored is not None:
        every = every.unionByName(last_stored(stored.drop("thumbnail"), keys, settings.recent).withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    return fold_sorted(every, keys, ["is_new", "ts", "id"], ", ".join([f"{k} {kinds[k]}" for k in keys] + [DECISION]), lambda: CaptureDedup(settings), judged)


def summary_pairs(summaries: DataFrame, keys: Sequence[str], recent: int) -> DataFrame:
    """Each summary with those at most ``recent`` places before it (by created_ts, id), as columns n_* and o_*, and back (1, 2, ...)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("created_ts", "id")
    cols = [c for c in summaries.columns if c not in keys]
    row = F.struct(*cols)
    both = summaries.select(*keys, row.alias("n"), F.array(*[F.lag(row, k).over(w) for k in range(1, recent + 1)]).alias("_old"))
    one = both.select(*keys, "n", F.posexplode("_old").alias("back", "o")).where("o is not null")
    return one.select(*keys, (F.col("back") + 1).alias("back"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "no" for c in cols])


def judge_summaries(summaries: DataFrame, keys: Sequence[str], s: SummaryDedupSettings = SummaryDedupSettings()) -> DataFrame:
    """Per summary (id, summary_text, context columns) action, reason, similarity and matched id against its last few.

    The best match has the highest of text and context similarity, the latest among equals.
    """
    keys = list(keys)
    pairs = add_text_similarity(summary_pairs(summaries, keys, s.recent), "n_summary_text", "o_summary_text", "_text")
    pairs = add_text_similarity(pairs, "n_window_title", "o_window_title", "_title")
    same = lambda c: F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}"))
    pairs = pairs.withColumn("_context", context_similarity(same("process_name"), F.col("_title"), same("blocked"), same("closure_reason")))
    pairs = pairs.withColumn("similarity", F.greatest("_text", "_context")).where("similarity > 0")
    best = pairs.groupBy(*keys, F.col("n_id").alias("id")).agg(
        F.max_by(F.struct("similarity", "_context", F.greatest(F.lit(0.0), F.col("n_start_ts") - F.col("o_end_ts")).alias("gap"), F.col("o_id").alias("matched")), F.struct("similarity", (-F.col("back")).alias("b"))).alias("m")
    )
    soon, close = F.col("m.gap") <= s.cooldown_s, F.col("m._context") >= 0.8
    joined = summaries.select(*keys, "id").join(best, [*keys, "id"], "left")
    action = F.when(close & soon & (F.col("m.similarity") >= s.merge), "merge_previous").when(soon & (F.col("m.similarity") >= s.suppress), "suppress").otherwise("store")
    reason = F.when(F.col("m").isNull(), "no_recent_summary").when(action == "merge_previous", "same_activity_continuation").when(action == "suppress", "too_similar_recent_summary").otherwise("distinct_activity")
    return joined.select(*keys, "id", F.when(F.col("m").isNull(), "store").otherwise(action).alias("action"), reason.alias("reason"), F.coalesce("m.similarity", F.lit(0.0)).alias("similarity"), F.col("m.matched").alias("matched_id"))


class _Stored:
    """A stored summary as later ones are compared with it."""

    def __init__(self, row):
        self.id, self.end_ts, self.row = row.id, row.end_ts, row
        self.text, self.title = row.norm_text or "", row.norm_title or ""


@lru_cache(maxsize=1_000)
def _parts(text: str) -> tuple[frozenset, Counter]:
    """A text's words and letters."""
    return frozenset(text.split()), Counter(text)


#: Texts up to so many characters are compared once and remembered (a fixed value).
SHORT_TEXT = 200


def _alike(a: _Stored, b: _Stored, least: float) -> float:
    """F4; ``least`` or less stands for anything up to it, as letters bound what runs can match."""
    if not a.text or not b.text:
        return float(not a.text and not b.text)
    if a.text == b.text:
        return 1.0
    if len(a.text) <= SHORT_TEXT and len(b.text) <= SHORT_TEXT:
        return _titles_alike(a.text, b.text)
    (words, letters), (old_words, old_letters) = _parts(a.text), _parts(b.text)
    shared = len(words & old_words) / len(words | old_words)
    most = 2 * (letters & old_letters).total() / (len(a.text) + len(b.text))
    return max(shared, ratio(a.text, b.text)) if most > max(shared, least) else shared


@lru_cache(maxsize=10_000)
def _titles_alike(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    x, y = set(a.split()), set(b.split())
    return max(ratio(a, b), len(x & y) / len(x | y))


def _context_alike(a, b, title: float) -> float:
    """F5."""
    process, blocked, closure = ((getattr(a, c) or None) == (getattr(b, c) or None) for c in ("process_name", "blocked", "closure_reason"))
    return max(process * 0.6 + title * 0.3 + blocked * 0.1, process * 0.5 + title * 0.4 + closure * 0.1)


class SummaryDedup:
    """What becomes of each summary as it comes; the state is the last stored ones, the latest first."""

    def __init__(self, settings: SummaryDedupSettings = SummaryDedupSettings()):
        self.s, self.recent = settings, deque(maxlen=settings.recent)

    def judge(self, row) -> tuple[str, str, float, int | None]:
        """(action, reason, similarity, matched id). A merge moves the end of the summary that it joins."""
        new = _Stored(row)
        best, near, context = 0.0, None, 0.0
        for old in self.recent:
            about = _context_alike(row, old.row, _titles_alike(new.title, old.title))
            found = max(_alike(new, old, max(best, about)), about)
            if found > best:
                best, near, context = found, old, about
        action, reason = "store", "no_recent_summary" if near is None else "distinct_activity"
        if near is not None and max(0.0, row.start_ts - near.end_ts) <= self.s.cooldown_s:
            if context >= 0.8 and best >= self.s.merge:
                action, reason = "merge_previous", "same_activity_continuation"
                near.end_ts = max(near.end_ts, row.end_ts)
            elif best >= self.s.suppress:
                action, reason = "suppress", "too_similar_recent_summary"
        if action == "store":
            self.recent.appendleft(new)
        return action, reason, best, near.id if near is not None else None


def merge_summaries(summaries: DataFrame, keys: Sequence[str], settings: SummaryDedupSettings = SummaryDedupSettings()) -> DataFrame:
    """W13 with its writes: per summary (id, start_ts, end_ts, created_ts, summary_text, context columns), in order of created_ts and id, action, reason, similarity, matched_id.

    Compared are the last stored ones: a suppressed summary is none, and one that was merged into has the later end.
    """
    kinds, keys = dict(summaries.dtypes), list(keys)
    told = summaries.withColumns({"norm_text": normalize_title(F.coalesce("summary_text", F.lit(""))), "norm_title": normalize_title(F.coalesce("window_title", F.lit("")))})
    judged = lambda state, row: [(*[getattr(row, k) for k in keys], row.id, row.start_ts, row.end_ts, *state.judge(row))]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"id {kinds['id']}", "start_ts DOUBLE", "end_ts DOUBLE", "action STRING", "reason STRING", "similarity DOUBLE", f"matched_id {kinds['id']}"])
    return fold_sorted(told, keys, ["created_ts", "id"], schema, lambda: SummaryDedup(settings), judged)


def stored_summaries(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summaries that ``merge_summaries`` leaves stored, with the end that merges gave them and how many there were."""
    target = F.when(F.col("action") == "store", F.col("id")).when(F.col("action") == "merge_previous", F.col("matched_id"))
    one = judged.where("action <> 'suppress'").withColumn("_id", target)
    return one.groupBy(*keys, F.col("_id").alias("id")).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count_if(F.col("action") == "merge_previous").alias("merged"))
