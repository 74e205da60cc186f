"""Stateful streams against their batch forms in any cut into batches, their timers, ticks, stored tables, images, recaps and merges."""

import hashlib
import os
import tempfile
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.config import SegmentSettings, SummaryDedupSettings
from daytrace.operators import dedup, responses, segments, typed_text
from daytrace.plans import catalog, recaps
from daytrace.plans.activity import _activity
from daytrace.plans.sessions import IDLE_S
from daytrace.sources import images, stored
from daytrace.streaming import sessions, stateful

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def stream_of(spark, folder, parts, schema):
    """A stream of one batch per part."""
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, schema) if isinstance(part, list) else part
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k + 1 < len(parts):
            time.sleep(0.02)  # files are read by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def ticked(spark, stream, folder, every="1 second"):
    assert sessions.run_ticks(stream, sessions.once_per_batch(f"{folder}/out"), f"{folder}/checkpoint", every) == sessions.EMPTY
    return spark.read.parquet(f"{folder}/out").drop("batch")


def rows_until(spark, stream, folder, n):
    """What a running stream has written once it has ``n`` rows."""
    running = stream.writeStream.foreachBatch(sessions.once_per_batch(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        end, got = time.time() + 90, []
        while len(got) < n and time.time() < end:
            time.sleep(0.5)
            assert running.isActive
            done = [d for d in os.listdir(f"{folder}/out") if d.startswith("batch=")] if os.path.isdir(f"{folder}/out") else []
            got = spark.read.parquet(*[f"{folder}/out/{d}" for d in done]).collect() if done else []
        return got
    finally:
        running.stop()


# --- capture dedup

SHOT = f"k BIGINT, id BIGINT, {dedup.KEPT}"


def shot(k, i, ts, title="t", exact=None, bits="00", thumbnail=None, hwnd=None, interval=None):
    return (k, i, float(ts), "p", title, hwnd, interval, exact, bits, None, thumbnail)


def test_captures_resume_from_stored_ones_and_across_batches(spark, folder):
    flat, other = [10, 200] * 8, [200, 10] * 8
    old = [shot(1, -i, -i, "t", "x", "ff") for i in range(1, 12)] + [shot(2, -1, -5, "u")]
    new = [shot(1, 1, 10, exact="x", bits="ff"), shot(1, 2, 20, thumbnail=flat), shot(1, 3, 30, thumbnail=flat), shot(1, 4, 40, thumbnail=other), shot(1, 5, 500, thumbnail=flat), shot(1, 6, 510, bits=None), shot(2, 7, 1, "u", bits="0f"), shot(3, 8, 1)]
    batch = dedup.capture_decisions(spark.createDataFrame(new, SHOT), ["k"], stored=spark.createDataFrame(old, SHOT))
    wanted = sorted(tuple(r) for r in batch.select("k", "id", "keep", "reason", "distance", "similarity", "streak").collect())
    assert [w[3] for w in wanted] == ["exact_duplicate", "visual_context_changed", "high_ssim_duplicate", "perceptual_duplicate", "visual_context_heartbeat", "unmatched_context", "perceptual_duplicate", "new_context"]
    found = stateful.screenshot_stream(stream_of(spark, folder, [new[:3], new[3:5], new[5:]], SHOT), "k", stored=spark.createDataFrame(old, SHOT))
    sessions.drain(found, sessions.once_per_batch(f"{folder}/out"), f"{folder}/checkpoint")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("k", "id", "keep", "reason", "distance", "similarity", "streak").collect()) == wanted


@has_data
def test_all_capture_outcomes_occur(spark):
    reasons = {r.reason for r in catalog.QUERIES["capture_outcomes"](spark, DATA).select("reason").distinct().collect()}
    assert reasons == {"new_context", "unmatched_context", "exact_duplicate", "exact_duplicate_heartbeat", "high_ssim_duplicate", "visual_context_heartbeat", "perceptual_duplicate", "visual_context_changed"}


# --- typed text

KEYS = "k BIGINT, ts DOUBLE, id BIGINT, event_type STRING, key STRING, modifiers ARRAY<STRING>, process_name STRING, window_title STRING, hwnd BIGINT"


def key(ts, ch, title="t", kind="down", held=(), k=1):
    return (k, float(ts), int(ts * 100), kind, ch, list(held), "p", title, 1)


TYPED = [key(0, "a"), key(1, "b", held=["shift"]), key(2, "Key.backspace"), key(3, "c"), key(3.5, "Key.shift"), key(4, "s", held=["ctrl"]), key(5, "d"), key(20, "e"), key(21, "f", "u"), key(22, "f", "u", kind="up"), key(23, "Key.up", "u"), key(40, "Key.up", "u"), key(1, "z", k=2)]


@pytest.mark.parametrize("cuts", [[], [4, 5], [1, 2, 3, 6, 7, 8]])
def test_text_stream_equals_batch(spark, folder, cuts):
    ends = [key(60, "", kind=stateful.FLUSH), key(60, "", kind=stateful.FLUSH, k=2)]
    edges = [0, *cuts, len(TYPED)]
    stream = stream_of(spark, folder, [*(TYPED[a:b] for a, b in zip(edges, edges[1:], strict=False)), ends], KEYS)
    cols = ["k", "start_ts", "end_ts", "process_name", "window_title", "text", "hotkeys", "raw_key_count"]
    got = ticked(spark, stateful.text_stream(stream, "k"), folder).select(*cols).collect()
    wanted = typed_text.reconstruct(spark.createDataFrame(TYPED, KEYS), ["k"]).select(*cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and {r.text for r in wanted} == {"ac", "", "d", "e", "f", "z"}


def test_an_open_text_is_flushed_by_the_clock(spark, folder):
    stream = stateful.text_stream(stream_of(spark, folder, [[key(0, "a"), key(0.5, "b")]], KEYS), "k", 1.0)
    assert [(r.text, r.start_ts, r.end_ts) for r in rows_until(spark, stream, folder, 1)] == [("ab", 0.0, 0.5)]


# --- segments


@has_data
@pytest.mark.parametrize("parts", [1, 4])
def test_segment_stream_equals_batch(spark, folder, parts):
    obs = _activity(spark, DATA)
    edges = obs.approxQuantile("start_ts", [k / parts for k in range(1, parts)], 0.0) if parts > 1 else []
    edges = [-1e18, *edges, 1e18]
    stream = stream_of(spark, folder, [obs.where((F.col("start_ts") >= a) & (F.col("start_ts") < b)) for a, b in zip(edges, edges[1:], strict=False)], obs.schema)
    settings = SegmentSettings(idle_gap_s=IDLE_S, max_duration_s=86400.0)
    got = ticked(spark, stateful.segment_stream(stream, "machine", settings), folder)
    cols = ["machine", *(c.split()[0] for c in segments.SEGMENT.split(", "))]
    plain = lambda df: sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert plain(got) == plain(segments.segments(obs, ["machine"], settings).where("is_closed"))


def test_segments_are_flushed_by_a_row_and_by_the_clock(spark, folder):
    schema = f"k BIGINT, {segments.OBSERVATION}"
    row = lambda k, ts, kind="active_interval": (k, float(ts), ts + 1.0, kind, "p", "t", False, ts, None, None, "x", ["CTRL+S"])
    stream = stateful.segment_stream(stream_of(spark, folder, [[row(1, 0), row(1, 2), row(1, 3, stateful.FLUSH), row(1, 5), row(2, 0)]], schema), "k", flush_s=2.0)
    got = rows_until(spark, stream, folder, 3)
    assert sorted((r.k, r.start_ts, r.observation_count, r.closure_reason, r.is_closed) for r in got) == [(1, 0.0, 2, "manual_flush", True), (1, 5.0, 1, "manual_flush", True), (2, 0.0, 1, "manual_flush", True)]


# --- states


def test_states_as_of_events_wait_for_the_watermark(spark, folder):
    schema = "k BIGINT, id BIGINT, ts DOUBLE, state STRING"
    rows = [[(1, 1, 100.0, None), (1, 2, 50.0, "locked")], [(1, 3, 90.0, "open"), (1, 4, 80.0, None), (2, 5, 95.0, None)], [(1, 6, 300.0, None), (1, 7, 301.0, "locked")], [(1, 8, 2000.0, "open")]]
    stream = stream_of(spark, folder, rows, schema)
    found = stateful.state_stream(stream.where("state is null").drop("state"), stream.where("state is not null"), "k", "100 seconds", 10)
    sessions.drain(found, sessions.once_per_batch(f"{folder}/out"), f"{folder}/checkpoint")
    got = {r.id: r.state for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: "open", 4: "locked", 5: None, 6: "open"}


# --- ticks


def test_four_ends_of_a_run_and_restarts(spark, folder):
    schema = "v BIGINT"
    stream = stream_of(spark, folder, [[(i,)] for i in range(6)], schema)
    write = sessions.once_per_batch(f"{folder}/out")
    seen = []

    def fails(batch, number):
        seen.append(number)
        if len(seen) == 3:
            raise ValueError("no")
        write(batch, number)

    run = lambda sink, mark=lambda: None: sessions.run_ticks(stream, sink, f"{folder}/checkpoint", "200 milliseconds", mark)
    assert run(fails) == sessions.ERROR and seen == [0, 1, 2]
    marks = iter([None] * 3 + [sessions.PAUSED] * 1000)
    assert run(write, lambda: next(marks)) == sessions.PAUSED
    assert run(write, lambda: sessions.CANCELLED) == sessions.CANCELLED
    assert run(write) == sessions.EMPTY and run(write) == sessions.EMPTY
    assert sorted(r.v for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(6))


# --- stored tables


def test_stored_table_versions_and_dead_writers(spark, folder, monkeypatch):
    store = stored.StoredTable(spark, f"{folder}/t", "k BIGINT, made BIGINT, v STRING", ["k"], 4)
    assert store.read().count() == 0 and store.versions() == []
    store.upsert(spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 30, "c")], store.schema))
    out = store.upsert(spark.createDataFrame([(1, 11, "A"), (3, 31, None), (None, 33, "C")], store.schema), keep=["made"])
    assert {(r.k, r.made, r.v, r.replaced) for r in out.collect()} == {(1, 10, "A", True), (3, 31, None, False), (None, 30, "C", True)}
    wanted = {(1, 10, "A"), (2, 20, "b"), (3, 31, None), (None, 30, "C")}
    assert {tuple(r) for r in store.read().collect()} == wanted
    # a null replaces a value
    store.upsert(spark.createDataFrame([(2, 21, None)], store.schema))
    assert {tuple(r) for r in store.read().collect()} == wanted - {(2, 20, "b")} | {(2, 21, None)}
    before = store.versions()
    assert {tuple(r) for r in store.read(before[-2]).collect()} == wanted

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame([(9, 9, "z")], store.schema))
    assert store.versions() == before and store.read().where("k = 9").count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(before[-2], {})
    assert store.upsert(spark.createDataFrame([], store.schema)).count() == 0


# --- images


def test_images(spark, folder):
    rng = np.random.default_rng(3)
    wanted = {}
    for name, (w, h), text in (("a.ppm", (5, 7), False), ("b.ppm", (64, 40), True), ("c.ppm", (1, 1), False)):
        px = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        head = f"P{3 if text else 6}\n# made by a test\n{w} {h}\n255\n".encode()
        with open(f"{folder}/{name}", "wb") as f:
            f.write(head + (" ".join(map(str, px.reshape(-1))).encode() if text else px.tobytes()))
        cell = lambda n, k, size: min(n - 1, int((k + 0.5) * n / size))
        gray = lambda size: [int(sum(int(px[cell(h, y, size), cell(w, x, size)][c]) * m for c, m in enumerate((299, 587, 114))) // 1000) for y in range(size) for x in range(size)]  # noqa: B023, E731
        g = gray(8)
        bits = int("".join(str(int(v >= sum(g) / 64)) for v in g), 2)
        wanted[name] = (w, h, hashlib.sha256(px.tobytes() + f"{w}x{h}".encode()).hexdigest(), f"{bits:016x}", gray(32))
    for name, body in (("d.ppm", b"no image"), ("e.ppm", b"P6 2 2 255 short"), ("g.ppm", b"P3 1 1 255 1 2 x")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
        wanted[name] = (None,) * 5
    open(f"{folder}/f.ppm", "wb").close()  # has no row
    got = {os.path.basename(r.path): tuple(r[1:]) for r in images.read_images(spark, folder).collect()}
    assert got == wanted


# --- recaps, payloads, merges


def test_nested_texts_are_cut(spark):
    df = spark.sql("select 1 as k, named_struct('a', 'longtext', 'b', array(named_struct('c', map('key of any length', 'abcdef'), 'n', 1), null), 'd', cast(null as string)) as v")
    kind = df.schema["v"].dataType
    r = df.select(responses.cut_texts(F.col("v"), kind, 4).alias("v"), responses.has_long_text(F.col("v"), kind, 4).alias("cut"), responses.has_long_text(F.col("v"), kind, 8).alias("not_cut")).first()
    assert r.v.a == "long..." and r.v.b[0].c == {"key of any length": "abcd..."} and r.v.b[0].n == 1 and r.v.b[1] is None and r.v.d is None and r.cut and not r.not_cut


def test_recaps_reduce_until_one_or_merge(spark):
    rows = [(1, i, "x" * 50, ["a"]) for i in range(30)] + [(2, i, "y" * 90, ["b"]) for i in range(5)] + [(3, 0, "z", None)]
    df = spark.createDataFrame(rows, "k long, at long, summary_text string, tags array<string>")
    answer = lambda merged: merged.withColumn("summary_text", F.when(F.col("k") == 1, F.substring("summary_text", 1, 30)).otherwise(F.col("summary_text")))
    got = {r.k: r for r in responses.reduce_recaps(df, ["k"], ["tags"], "at", F.char_length("summary_text"), 100, answer).collect()}
    assert set(got) == {1, 2, 3}
    # thirty rows make fifteen chunks of two; of their answers of 30 characters three fill a chunk: 5, then 2, then 1
    assert (got[1].chunk_count, got[1].rounds, got[1].merged_locally, len(got[1].summary_text)) == (15, 3, False, 30) and len(got[1].tags) == 20
    assert (got[2].chunk_count, got[2].rounds, got[2].merged_locally, got[2].summary_text) == (5, 0, True, " ".join(["y" * 90] * 5))
    assert (got[3].chunk_count, got[3].rounds, got[3].merged_locally, got[3].summary_text, got[3].tags) == (1, 0, False, "z", [])


@has_data
def test_merged_summaries_equal_a_plain_loop(spark):
    rows = recaps._summaries(spark, DATA).orderBy("machine", "created_ts", "id").collect()
    settings, wanted, kept, actions = recaps.SUMMARIES, {}, {}, set()
    norm = lambda t: " ".join(t.lower().split())
    like = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())))
    for r in rows:
        mine, best = kept.setdefault(r.machine, []), (0.0, 0.0, None)
        for old in mine[::-1][: settings.recent]:
            o = old["row"]
            title, p, b = like(norm(r.window_title), norm(o.window_title)), float(r.process_name == o.process_name), float(r.blocked == o.blocked)
            context = max(p * 0.6 + title * 0.3 + b * 0.1, p * 0.5 + title * 0.4 + 0.1)
            found = max(like(norm(r.summary_text), norm(o.summary_text)), context)
            if found > best[0]:
                best = (found, context, old)
        action = "store"
        if best[2] is not None and max(0.0, r.start_ts - best[2]["end"]) <= settings.cooldown_s:
            action = "merge" if best[1] >= 0.8 and best[0] >= settings.merge else "suppress" if best[0] >= settings.suppress else "store"
        actions.add(action)
        if action == "store":
            mine.append({"row": r, "end": r.end_ts})
            wanted[r.machine, r.id] = [r.end_ts, 0]
        elif action == "merge":
            best[2]["end"] = max(best[2]["end"], r.end_ts)
            mark = wanted[r.machine, best[2]["row"].id]
            mark[:] = best[2]["end"], mark[1] + 1
    assert actions == {"store", "merge", "suppress"}
    assert {(r.machine, r.id): [r.end_ts, r.merged] for r in catalog.QUERIES["merged_summaries"](spark, DATA).collect()} == wanted


def test_a_merge_moves_the_end_that_later_ones_are_compared_with(spark):
    row = lambda i, start, end: ("m", i, float(start), float(end), float(i), "same words here", "p", "t", False, "")
    df = spark.createDataFrame([row(1, 0, 10), row(2, 200, 220), row(3, 450, 460), row(4, 900, 910)], "k string, id long, start_ts double, end_ts double, created_ts double, summary_text string, process_name string, window_title string, blocked boolean, closure_reason string")
    judged = dedup.merge_summaries(df, ["k"], SummaryDedupSettings())
    assert [(r.id, r.action, r.matched_id) for r in judged.orderBy("id").collect()] == [(1, "store", None), (2, "merge_previous", 1), (3, "merge_previous", 1), (4, "store", 1)]
    assert sorted((r.id, r.end_ts, r.merged) for r in dedup.stored_summaries(judged, ["k"]).collect()) == [(1, 460.0, 2), (4, 910.0, 0)]


# --- timers of states, tokens taken back


class _Kept:
    """A list state and a handle in memory."""

    def __init__(self):
        self.rows, self.timers = [], []

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.expiry


def test_states_have_one_timer_per_key():
    import pandas as pd

    p, handle = stateful._AsOf(10_000, "k BIGINT, id BIGINT, ts DOUBLE, state STRING"), _Kept()
    p.handle, p.events, p.states = handle, _Kept(), _Kept()
    rows = pd.DataFrame([(1, 5.0, "a"), (2, 7.0, None), (3, 12.0, None), (4, 15.0, "b"), (5, 28.0, None), (6, 33.0, None)], columns=["id", "ts", "state"])
    list(p.handleInputRows((9,), iter([rows]), None))
    assert handle.timers == [10_000]
    handle.timers, handle.watermark, handle.expiry = [], 31_000, 10_000
    (out,) = p.handleExpiredTimer((9,), handle, handle)
    assert [tuple(r[1:]) for r in out.itertuples(index=False)] == [(2, 7.0, "a"), (3, 12.0, "a"), (5, 28.0, "b")]
    assert handle.timers == [40_000] and p.events.rows == [(6, 33.0)] and p.states.rows == [(15.0, 4, "b")]


def test_typed_text_folds_only_what_is_taken_back(spark):
    keys = [*"aXb"]
    rows = [("k", float(i), i, "down", c, [], "p", w, 1) for w in ("one", "two") for i, c in enumerate(keys)]
    rows = [(*r[:1], r[1] + 100 * (r[7] == "two"), r[2] + 10 * (r[7] == "two"), *r[3:]) for r in rows] + [("k", 103.0, 13, "down", "Key.backspace", [], "p", "two", 1)]
    df = spark.createDataFrame(rows, "k string, ts double, id bigint, event_type string, key string, modifiers array<string>, process_name string, window_title string, hwnd bigint")
    got = typed_text.reconstruct(df, ["k"])
    assert sorted((r.window_title, r.text) for r in got.collect()) == [("one", "axb"), ("two", "ax")]
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


# --- key events packed into runs


def packed(rows, gap_s=8.0, key="k"):
    import pyarrow as pa

    names = ["k", "ts", "id", "event_type", "process_name", "window_title", "hwnd", "hot", "token", "name"]
    types = [pa.int64(), pa.float64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.bool_(), pa.string(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    return [r for out in stateful._packed(iter([batch]), key, gap_s) for r in out.to_pylist()]


def test_tasks_pack_events_into_runs(monkeypatch):
    event = lambda ts, token="a", k=1, title="t", hot=False, kind="down": (k, ts, None if ts is None else int(ts * 10), kind, "p", title, None, hot, token, "N" if hot else None)
    back = typed_text.BACKSPACE
    # not in order; a null key; an upper-case letter of two code points, a backspace, keys that type nothing
    got = packed([event(2.0, "SS"), event(1.0), event(3.0, back), event(4.0, None), event(12.5), event(13.0, title=None), event(13.5, title=None), event(14.0, hot=True), event(15.0), event(16.0, "", kind=stateful.FLUSH), event(17.0), event(1.5, "z", None), event(1.7, "y", None)])
    assert [(r["k"], r["ts"], r["end_ts"], r["window_title"], r["hot"], r["text"], r["sizes"], r["n"]) for r in got if r["k"]] == [
        (1, 1.0, 4.0, "t", False, "aSS", [1, 2, -1, 0], 4), (1, 12.5, 12.5, "t", False, "a", None, 1), (1, 13.0, 13.5, None, False, "aa", None, 2), (1, 14.0, 14.0, "t", True, "a", None, 1),
        (1, 15.0, 15.0, "t", False, "a", None, 1), (1, 16.0, 16.0, "t", False, "", [0], 1), (1, 17.0, 17.0, "t", False, "a", None, 1)]
    assert [(r["text"], r["n"]) for r in got if r["k"] is None] == [("zy", 2)]
    assert np.frombuffer(got[[r["ts"] for r in got].index(1.0)]["times"]).tolist() == [1.0, 2.0, 3.0, 4.0]
    monkeypatch.setattr(stateful, "RUN_EVENTS", 3)
    assert [r["n"] for r in packed([event(i / 10) for i in range(7)])] == [3, 3, 1]


def test_the_state_gets_a_row_per_run_and_not_per_key(spark, folder, monkeypatch):
    seen = {}
    monkeypatch.setattr(stateful, "_run", lambda rows, *_, **__: seen.setdefault("rows", rows))
    keys = [key(i / 10, "ab"[i % 2]) for i in range(2000)]
    stateful.text_stream(spark.createDataFrame(keys, KEYS).coalesce(1), "k")
    assert sorted(r.n for r in seen["rows"].collect()) == [1000, 1000]


def test_events_of_one_text_over_several_tasks(spark, folder):
    # ß in upper case is two code points, which one backspace takes back
    keys = [key(i / 10, ch, held=["shift"] if ch == "ß" else ()) for i, ch in enumerate([*"abcß", "Key.backspace", "Key.up", *"dßef", "Key.space", *"gh"])]
    keys += [key(2, "i", "u"), key(2.1, "j", "u"), key(2.2, "s", "u", held=["ctrl"]), key(2.3, "k", "u"), key(11, "l", "u"), key(0.5, "z", k=2), key(0.6, "y", k=2)]
    for i in range(3):
        spark.createDataFrame(keys[i::3], KEYS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ends = [key(60, "", kind=stateful.FLUSH), key(60, "", kind=stateful.FLUSH, k=2)]
    spark.createDataFrame(ends, KEYS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(KEYS).parquet(f"{folder}/in")
    cols = ["k", "start_ts", "end_ts", "window_title", "text", "hotkeys", "raw_key_count"]
    got = ticked(spark, stateful.text_stream(stream, "k"), folder).select(*cols).collect()
    wanted = typed_text.reconstruct(spark.createDataFrame(keys, KEYS), ["k"]).select(*cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and {r.text for r in wanted} == {"abcdSSef gh", "ij", "", "k", "l", "zy"}


def test_settings_of_a_run_end_with_its_start(spark, folder):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    stream = stream_of(spark, folder, [[(1,)]], "v BIGINT")

    def sink(batch, number):
        seen.append((batch.sparkSession.conf.get(name), spark.conf.get(name)))

    assert sessions.run_ticks(stream, sink, f"{folder}/checkpoint", "200 milliseconds", conf={name: "12345"}) == sessions.EMPTY
    assert seen[0] == ("12345", before) and spark.conf.get(name) == before
