"""Keyed stateful streams with timers: capture dedup, typed text, segments, and states joined as of an event.

Each is a processor of transformWithStateInPandas, or of transformWithState for the few rows of texts, over state variables in RocksDB. It loads a key's state, folds the rows
of a batch in order by the rules that the batch operators use, and stores it. What is open at the end of the input is
flushed by a processing-time timer or by a row that asks for it; event-time timers wait for a watermark.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import os
from collections import Counter, namedtuple
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daytrace.config import ScreenshotDedupSettings, SegmentSettings
from daytrace.functions.text import normalize_title
from daytrace.operators import dedup, segments, typed_text
from daytrace.session import ship

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: In the column that names a row's kind: end what is open.
FLUSH = "flush"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _plain(v):
    """A value of a frame as one of a state: null for what pandas has for it, lists for arrays."""
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) == 1:
        return [x.item() if hasattr(x, "item") else x for x in v]
    if v is None or pd.isna(v):
        return None
    return v.item() if hasattr(v, "item") else v


def _ordered(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> Iterator:
    """Rows of a batch in order, as objects."""
    parts = [p for p in batches if len(p)]
    if parts:
        rows = (pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]).sort_values(list(order), kind="stable")
        yield from map(namedtuple("Row", rows.columns)._make, zip(*(_values(rows[c]) for c in rows.columns), strict=True))


def _values(column: pd.Series) -> list:
    """A column's values as ``_plain`` gives them; only lists are gone through one by one."""
    if column.dtype == object and any(hasattr(v, "__len__") and not isinstance(v, str) for v in column):
        return [_plain(v) for v in column]
    return [None if v is None or v != v else v for v in column.tolist()]


def _frame(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=_names(schema))


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str, start: DataFrame | None = None, by_rows: bool = False) -> DataFrame:
    spark = stream.sparkSession
    ship(spark)
    # a Python process beside the driver reads the processor too, and added files don't reach it
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    first = start.groupBy(key) if start is not None else None
    grouped = stream.groupBy(key)
    return (grouped.transformWithState if by_rows else grouped.transformWithStateInPandas)(processor, outputStructType=schema, outputMode="Append", timeMode=time, initialState=first)


# --- capture dedup


class _Captures(StatefulProcessor):
    def __init__(self, settings: ScreenshotDedupSettings, schema: str):
        self.settings, self.schema = settings, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", dedup.KEPT)
        self.run = handle.getValueState("run", "streak INT, last DOUBLE")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        names = _names(dedup.KEPT)
        self.recent.put([tuple(_plain(r[n]) for n in names) for r in initialState.kept.iloc[0]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        names = _names(dedup.KEPT)
        state = dedup.CaptureDedup(self.settings, [SimpleNamespace(**{n: _plain(v) for n, v in zip(names, r, strict=True)}) for r in self.recent.get()])
        if self.run.exists():
            state.streak, state.last = self.run.get()
        out = []
        for row in _ordered(rows, ["ts", "id"]):
            found = state.judge(row)
            out.append((key[0], row.id, row.ts, *found, state.streak))
        self.recent.put([tuple(getattr(r, n, None) for n in names) for r in state.recent])
        self.run.update((state.streak, state.last))
        yield from _frame(out, self.schema)

    def close(self) -> None:
        pass


def screenshot_stream(shots: DataFrame, key: str, settings: ScreenshotDedupSettings = ScreenshotDedupSettings(), stored: DataFrame | None = None) -> DataFrame:
    """Keep or drop each screenshot of a key as it comes; a new query's state starts from the last stored ones.

    The state holds the last kept ones with their thumbnails; the nearest one's decides likeness. Stored ones have none.
    """
    schema = f"{key} {dict(shots.dtypes)[key]}, {dedup.DECISION}"
    start = None
    if stored is not None:
        kept = dedup.last_stored(stored, [key], settings.recent).withColumn("thumbnail", F.lit(None).cast("array<int>"))
        at = F.struct((-F.col("ts")).alias("_ts"), (-F.col("id")).alias("_id"), *_names(dedup.KEPT))
        start = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: F.struct(*[x[n].alias(n) for n in _names(dedup.KEPT)])).alias("kept"))
    return _run(shots, key, _Captures(settings, schema), schema, "None", start)


# --- typed text


#: Events of a key that follow each other in a task's batch, in one context: the places of the first and the last, their
#: tokens joined, tokens' sizes in code points unless each is one (0: types nothing, -1: a backspace), their number, and the
#: times and ids of all, as 8-byte numbers, which only runs that overlap need.
_RUN = "ts DOUBLE, id BIGINT, end_ts DOUBLE, end_id BIGINT, event_type STRING, process_name STRING, window_title STRING, hwnd BIGINT, hot BOOLEAN, name STRING, text STRING, sizes ARRAY<INT>, n INT, times BINARY, ids BINARY"

#: Most events of a run: bounds what a batch of runs holds.
RUN_EVENTS = 1000


def _packed(batches: Iterator[pa.RecordBatch], key: str, gap_s: float) -> Iterator[pa.RecordBatch]:
    """Events as runs. A run ends where the text might: before another key or context, a gap, a flush or a hotkey."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = {n: batch[n].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for n in (key, "process_name", "window_title", "hwnd")}
        order = np.lexsort((batch["id"].to_numpy(zero_copy_only=False), batch["ts"].to_numpy(zero_copy_only=False), codes[key]))
        batch = batch.take(pa.array(order))
        ts = batch["ts"].to_numpy(zero_copy_only=False)
        alone = pc.or_kleene(batch["hot"], pc.equal(batch["event_type"], FLUSH)).fill_null(False).to_numpy(zero_copy_only=False)
        starts = np.ones(len(ts), dtype=bool)
        starts[1:] = alone[1:] | alone[:-1] | ~(ts[1:] - ts[:-1] <= gap_s)
        for code in codes.values():
            code = code[order]
            starts[1:] |= code[1:] != code[:-1]
        first = np.flatnonzero(starts)
        place = np.arange(len(ts)) - np.repeat(first, np.diff(np.append(first, len(ts))))
        first = np.flatnonzero(place % RUN_EVENTS == 0)
        edges = np.append(first, len(ts)).astype(np.int32)
        ends = pa.array(edges[1:] - 1)
        back = pc.equal(batch["token"], typed_text.BACKSPACE).fill_null(False)
        tokens = pc.if_else(back, "", batch["token"].fill_null(""))
        sizes = pc.if_else(back, -1, pc.utf8_length(tokens)).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(sizes != 1, first)
        heads = batch.take(pa.array(first))
        # without an id, an event stands behind the others of its time
        ids = batch["id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        bytes_ = lambda values: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges * 8), pa.py_buffer(np.ascontiguousarray(values))])  # noqa: B023, E731
        columns = {n: heads[n] for n in (key, "ts", "id", "event_type", "process_name", "window_title", "hwnd", "hot", "name")}
        columns |= {"end_ts": batch["ts"].take(ends), "end_id": batch["id"].take(ends), "text": pc.binary_join(pa.ListArray.from_arrays(edges, tokens), ""), "n": pa.array(np.diff(edges)), "times": bytes_(ts), "ids": bytes_(ids)}
        columns["sizes"] = pa.array([sizes[a:b] if o else None for a, b, o in zip(edges, edges[1:], odd, strict=False)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([columns[n] for n in (key, *_names(_RUN))], [key, *_names(_RUN)])


def _tokens(run) -> list:
    """The tokens of a run's events."""
    if run.sizes is None:
        return list(run.text)
    out, at = [], 0
    for n in run.sizes:
        out.append(typed_text.BACKSPACE if n < 0 else run.text[at : at + n] if n else None)
        at += max(n, 0)
    return out


def _place(ts: float | None, i: int | None) -> tuple:
    return ts is None or ts != ts, ts, i is None, i


def _events(run: Row) -> Iterator[Row]:
    """A run's events as runs of their own."""
    for ts, i, token in zip(np.frombuffer(run.times).tolist(), np.frombuffer(run.ids, np.int64).tolist(), _tokens(run), strict=True):
        text, size = ("", -1) if token == typed_text.BACKSPACE else ("", 0) if token is None else (token, len(token))
        yield Row(**run.asDict() | {"ts": ts, "id": i, "end_ts": ts, "end_id": i, "text": text, "sizes": [size], "n": 1})


def _runs(rows: Iterator[Row]) -> list[Row]:
    """Runs of a batch in order. If tasks had events of the same time, runs overlap, and all are cut into their events."""
    runs = sorted(rows, key=lambda r: _place(r.ts, r.id))
    if any(_place(a.end_ts, a.end_id) > _place(b.ts, b.id) for a, b in itertools.pairwise(runs)):
        runs = sorted(itertools.chain.from_iterable(map(_events, runs)), key=lambda r: _place(r.ts, r.id))
    return runs


class _Texts(StatefulProcessor):
    OPEN = "start_ts DOUBLE, end_ts DOUBLE, process_name STRING, window_title STRING, hwnd BIGINT, chars ARRAY<STRING>, n INT"

    def __init__(self, gap_s: float, schema: str):
        self.gap_s, self.schema = gap_s, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.OPEN)

    def _told(self, key, now, out: list[tuple]) -> None:
        if now is not None and now[5]:
            out.append((key[0], *now[:4], "".join(now[5]), [], now[6]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        now = list(self.open.get()) if self.open.exists() else None
        if was_open := now is not None:
            now[5] = list(now[5])
        out: list[tuple] = []
        for r in _runs(rows):
            if now is not None and (r.event_type == FLUSH or r.hot or (r.process_name, r.window_title, r.hwnd) != (now[2], now[3], now[4]) or r.ts is None or now[1] is None or not r.ts - now[1] <= self.gap_s):
                self._told(key, now, out)
                now = None
            if r.event_type == FLUSH:
                continue
            if r.hot:
                out.append((key[0], r.ts, r.ts, r.process_name, r.window_title, "", [r.name], 1))
                continue
            if now is None:
                now = [r.ts, r.ts, r.process_name, r.window_title, r.hwnd, [], 0]
            now[1], now[6] = r.end_ts, now[6] + r.n
            if r.sizes is None:
                now[5].extend(r.text)
                continue
            for token in _tokens(r):
                if token == typed_text.BACKSPACE:
                    del now[5][-1:]
                elif token is not None:
                    now[5].append(token)
        # the open text is flushed when nothing has come for the gap; a key has a timer only while its text is open
        if was_open:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if now is not None:
            self.open.update(tuple(now))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.gap_s) + 1)
        elif was_open:
            self.open.clear()
        yield from itertools.starmap(Row(*_names(self.schema)), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        out: list[tuple] = []
        if self.open.exists():
            self._told(key, self.open.get(), out)
            self.open.clear()
        yield from itertools.starmap(Row(*_names(self.schema)), out)

    def close(self) -> None:
        pass


def text_stream(events: DataFrame, key: str, gap_s: float = typed_text.GAP_S) -> DataFrame:
    """Text segments of a stream of key events (ts, id, event_type, key, modifiers, process_name, window_title, hwnd).

    A segment is given out when the next key ends it, when a row of the type ``flush`` comes, or when no row has come for
    ``gap_s`` by the clock. Rows must come in order from batch to batch; within one they are sorted. Tasks pack their events
    into runs before these are dealt by key.
    """
    mine = events.where((F.col("event_type") == FLUSH) | (F.col("event_type") == "down") & ~typed_text.is_modifier(F.col("key")))
    pressed, held = F.col("key"), F.col("modifiers")
    told = mine.select(
        F.col(key), "ts", "id", "event_type", "process_name", "window_title", F.col("hwnd").cast("bigint").alias("hwnd"), F.coalesce(typed_text.is_hotkey(pressed, held), F.lit(False)).alias("hot"),
        typed_text.token_of(pressed, held).alias("token"), F.when(typed_text.is_hotkey(pressed, held), typed_text.format_hotkey(pressed, held)).alias("name"),
    )
    ship(events.sparkSession)
    kind = dict(events.dtypes)[key]
    runs = told.mapInArrow(functools.partial(_packed, key=key, gap_s=gap_s), f"{key} {kind}, {_RUN}")
    schema = f"{key} {kind}, start_ts DOUBLE, end_ts DOUBLE, process_name STRING, window_title STRING, text STRING, hotkeys ARRAY<STRING>, raw_key_count INT"
    return _run(runs, key, _Texts(gap_s, schema), schema, "ProcessingTime", by_rows=True)


# --- segments


class _Segments(StatefulProcessor):
    HEAD = "start DOUBLE, end DOUBLE, gap DOUBLE, blocked BOOLEAN, visual DOUBLE, shot STRING, count INT, shots INT"
    COUNTS, LISTS = ("processes", "titles"), ("interval_ids", "screenshot_ids", "hotkeys", "texts")

    def __init__(self, settings: SegmentSettings, flush_s: float | None, schema: str):
        self.settings, self.flush_s, self.schema = settings, flush_s, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.counts = {n: handle.getMapState(n, "name STRING", "n INT, place INT, norm STRING") for n in self.COUNTS}
        self.lists = {n: handle.getListState(n, f"v {'BIGINT' if n.endswith('ids') else 'STRING'}") for n in self.LISTS}

    def _load(self) -> segments.Open | None:
        if not self.head.exists():
            return None
        now = segments.Open.__new__(segments.Open)
        for name, value in zip(_names(self.HEAD), self.head.get(), strict=True):
            setattr(now, name, _plain(value))
        for name, state in self.counts.items():
            rows = sorted(((v[1], k[0], v[0], v[2]) for k, v in state.iterator()), key=lambda x: x[0])
            setattr(now, name, Counter({k: n for _, k, n, _ in rows}))
            if name == "titles":
                now.norms = {k: norm for _, k, _, norm in rows}
        for name, state in self.lists.items():
            values = [v[0] for v in state.get()] if state.exists() else []
            setattr(now, name, values if name == "texts" else dict.fromkeys(values))
        return now

    def _store(self, now: segments.Open | None) -> None:
        for state in (self.head, *self.counts.values(), *self.lists.values()):
            state.clear()
        if now is None:
            return
        self.head.update(tuple(getattr(now, n) for n in _names(self.HEAD)))
        for name, state in self.counts.items():
            for place, (value, n) in enumerate(getattr(now, name).items()):
                state.updateValue((value,), (n, place, now.norms.get(value)))
        for name, state in self.lists.items():
            if values := list(getattr(now, name)):
                state.put([(v,) for v in values])

    def _told(self, key, segment: dict) -> tuple:
        return key[0], *(segment[n] for n in _names(segments.SEGMENT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        now, out = self._load(), []
        for row in _ordered(rows, ["start_ts", "end_ts", "kind", "tie"]):
            if row.kind == FLUSH:
                if now is not None:
                    out.append(self._told(key, now.done("manual_flush", None, True)))
                now = None
            elif now is None:
                now = segments.Open(row)
            else:
                reason, visual = now.closes(row, self.settings)
                if reason:
                    out.append(self._told(key, now.done(reason, visual, True)))
                    now = segments.Open(row)
                else:
                    now.add(row, visual)
        self._store(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is not None and self.flush_s is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.flush_s))
        yield from _frame(out, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = self._load()
        self._store(None)
        yield from _frame([] if now is None else [self._told(key, now.done("manual_flush", None, True))], self.schema)

    def close(self) -> None:
        pass


def segment_stream(obs: DataFrame, key: str, settings: SegmentSettings = SegmentSettings(), flush_s: float | None = None) -> DataFrame:
    """Closed segments of a stream of observations, given out at once.

    The running modes are maps of names to frequencies. An open segment is flushed by a row of the kind ``flush``, or by a
    timer ``flush_s`` seconds after the key's last batch. Rows must come in order from batch to batch.
    """
    told = obs.withColumns({"norm_title": normalize_title(F.coalesce("window_title", F.lit(""))), "tie": F.coalesce("active_interval_id", "screenshot_id", F.lit(0).cast("bigint"))})
    schema = f"{key} {dict(obs.dtypes)[key]}, {segments.SEGMENT}"
    return _run(told, key, _Segments(settings, flush_s, schema), schema, "ProcessingTime")


# --- states as of events


class _AsOf(StatefulProcessor):
    def __init__(self, tick_ms: int, schema: str):
        self.tick_ms, self.schema = tick_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "id BIGINT, ts DOUBLE")
        self.states = handle.getListState("states", "ts DOUBLE, id BIGINT, state STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        events, states = [], []
        for r in _ordered(rows, ["ts", "id"]):
            if r.state is not None:
                states.append((r.ts, r.id, r.state))
            else:
                events.append((r.id, r.ts))
        if states:
            self.states.appendList(states)
        if events:
            self.events.appendList(events)
            # one timer per key, for its earliest event
            first, set_ = min(self._due(ts) for _, ts in events), list(self.handle.listTimers())
            if not set_ or first < min(set_):
                for timer in set_:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
        return iter(())

    def _due(self, ts: float) -> int:
        """When the tick of a time ends."""
        return math.ceil(ts * 1000 / self.tick_ms) * self.tick_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        # all ticks that the watermark has passed are told at once
        tick = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() // self.tick_ms * self.tick_ms)
        end = tick / 1000
        states = sorted(self.states.get())
        places = [s[0] for s in states]
        out, wait = [], []
        for i, ts in self.events.get():
            if self._due(ts) > tick:
                wait.append((i, ts))
                continue
            at = bisect.bisect_right(places, ts)
            out.append((key[0], i, ts, states[at - 1][2] if at else None))
        if wait:
            self.events.put(wait)
            self.handle.registerTimer(min(self._due(ts) for _, ts in wait))
        else:
            self.events.clear()
        # events to come are later than the tick: of the states before it only the last one matters
        old = bisect.bisect_right(places, end)
        if old > 1:
            self.states.put(states[old - 1 :])
        yield from _frame(out, self.schema)

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, states: DataFrame, key: str, delay: str = "1 hour", tick: int = 3600) -> DataFrame:
    """The state in force at each event, of two streams: events (key, id, ts) and states (key, id, ts, state).

    An event waits until the watermark, ``delay`` behind the latest row, has passed the end of its tick of ``tick``
    seconds; then the states before it are known, and the latest of them (by ts, id) is its own. Later rows are dropped.
    """
    both = events.select(key, "id", "ts", F.lit(None).cast("string").alias("state")).unionByName(states.select(key, "id", "ts", "state"))
    both = both.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    schema = f"{key} {dict(events.dtypes)[key]}, id BIGINT, ts DOUBLE, state STRING"
    return _run(both, key, _AsOf(tick * 1000, schema), schema, "EventTime")
