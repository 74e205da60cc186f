"""Operators on small relations with known results."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daytrace.config import CoalesceSettings, ScreenshotDedupSettings, SegmentSettings, SummaryDedupSettings
from daytrace.operators import coalesce, dedup, entities, intervals, jobs, quality, reports, responses, search, segments, typed_text
from daytrace.schemas import RELATIONS


def keys(spark, *rows):
    """Key events (ts, key[, modifiers[, title]])."""
    full = [(i, float(r[0]), r[1], "down", list(r[2]) if len(r) > 2 else [], "app", r[3] if len(r) > 3 else "w", 1, 1, False) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RELATIONS["key_events"])


def typed(spark, *rows, **how):
    return [(r.text, r.hotkeys) for r in typed_text.reconstruct(keys(spark, *rows), **how).orderBy("start_ts", "segment").collect()]


@pytest.mark.parametrize(
    "rows, wanted, how",
    [
        ([(1 + i / 10, c) for i, c in enumerate("hello")], [("hello", [])], {}),
        ([(1, "h"), (1.1, "e"), (1.2, "x"), (1.3, "Key.backspace"), (1.4, "l"), (1.5, "l"), (1.6, "o")], [("hello", [])], {}),
        ([(1, "a"), (1.1, "Key.enter"), (1.2, "b")], [("a\nb", [])], {}),
        ([(1, "a"), (1.1, "c", ["ctrl"]), (1.2, "d")], [("a", []), ("", ["CTRL+C"]), ("d", [])], {}),
        ([(1, "a"), (1.1, "b"), (1.2, "c", [], "other")], [("ab", []), ("c", [])], {}),
        ([(1.0, "a"), (1.4, "b"), (3.0, "c")], [("ab", []), ("c", [])], {"gap_s": 1.0}),
        ([(1.0, "a"), (9.0, "b"), (17.1, "c")], [("ab", []), ("c", [])], {}),
        ([(1, "h", ["shift"]), (1.1, "e"), (1.2, "Key.backspace"), (1.3, "e"), (1.4, "s", ["ctrl"]), (1.5, "y")], [("He", []), ("", ["CTRL+S"]), ("y", [])], {}),
        ([(1, "x"), (1.1, "Key.backspace")], [], {}),
        ([(1, "1", ["shift"]), (1.1, "Key.shift"), (1.2, "Key.space"), (1.3, "Key.f5")], [("! ", [])], {}),
        ([], [], {}),
    ],
)
def test_typed_text(spark, rows, wanted, how):
    assert typed(spark, *rows, **how) == wanted


def test_held_modifiers(spark):
    rows = [(0, 1.0, "Key.ctrl_l", "down"), (1, 2.0, "a", "down"), (2, 3.0, "Key.ctrl_l", "up"), (3, 4.0, "b", "down")]
    got = typed_text.held_modifiers(spark.createDataFrame(rows, "id long, ts double, key string, event_type string"), []).orderBy("id").collect()
    assert [r.modifiers for r in got] == [[], ["ctrl"], ["ctrl"], []]


def test_idle_gap_boundaries(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (1, 5.0, 1), (1, 15.0, 2), (1, 24.9, 3)], "k int, ts double, i int")
    assert [r.segment for r in intervals.idle_segments(df, ["k"], "ts", ["i"], 10.0).orderBy("i").collect()] == [1, 1, 2, 2]


def test_runs(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "a"), (2, 3.0, "b"), (3, 4.0, None), (4, 5.0, None), (5, 6.0, "a")], "i int, ts double, app string").withColumn("k", F.lit(1))
    got = intervals.runs(df, ["k"], "ts", ["i"], ["app"]).orderBy("run").collect()
    assert [(r.app, r.start_ts, r.end_ts, r.n) for r in got] == [("a", 1, 3, 2), ("b", 3, 4, 1), (None, 4, 6, 2), ("a", 6, None, 1)]


def observed(spark, *rows):
    """Observations (start, end, app, title[, blocked[, fingerprint]])."""
    full = [(1, float(r[0]), float(r[1]), "active_interval", r[2], r[3], bool(r[4]) if len(r) > 4 else False, i, None, r[5] if len(r) > 5 else None, None, []) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "machine int, " + segments.OBSERVATION)


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(0, 5, "a", "x"), (25, 30, "a", "x")], ["idle_gap", "open"]),
        ([(0, 5, "a", "x"), (24.9, 30, "a", "x")], ["open"]),
        ([(0, 5, "a", "doc one"), (5, 9, "b", "mail")], ["app_changed", "open"]),
        ([(0, 5, "a", "doc one"), (5, 9, "b", "doc one")], ["open"]),
        ([(0, 5, "a", "x"), (5, 9, "a", "x", True)], ["lock_state_changed", "open"]),
        ([(0, 900, "a", "x"), (900, 901, "a", "x")], ["max_duration_reached", "open"]),
        ([(0, 899, "a", "x"), (899, 2000, "a", "x"), (2000, 2001, "a", "x")], ["max_duration_reached", "open"]),
        ([(0, 1, "a", "x", False, "ffff"), (1, 2, "a", "other", False, "0000")], ["visual_context_changed", "open"]),
        ([(0, 1, "a", "x", False, "ffff"), (1, 2, "a", "other", False, "ffff")], ["open"]),
    ],
)
def test_segment_closures(spark, rows, wanted):
    got = segments.segments(observed(spark, *rows), ["machine"]).orderBy("start_ts").collect()
    assert [r.closure_reason for r in got] == wanted and got[-1].is_closed is False


def test_segments_do_not_depend_on_the_cut(spark, monkeypatch):
    """Islands folded apart give what one fold over all gives."""
    rng = random.Random(4)
    rows, t = [], 0.0
    for _ in range(300):
        t += rng.choice([0, 1, 5, 19.9, 20, 40])
        rows.append((t, t + rng.choice([0, 3, 10]), rng.choice("ab"), rng.choice(["one two", "one three", "zz"]), rng.random() < 0.1))
    df = observed(spark, *rows)
    monkeypatch.setattr(segments, "ISLANDS", 1)
    cut = segments.segments(df, ["machine"]).orderBy("start_ts", "end_ts").collect()
    pdf = df.toPandas().sort_values(["start_ts", "end_ts", "kind", "active_interval_id"], kind="stable").assign(norm_title=lambda d: d.window_title)
    whole = segments.fold(pdf, SegmentSettings(), "open", False)
    assert [(r.segment_id, r.closure_reason, r.observation_count) for r in cut] == [(w["segment_id"], w["closure_reason"], w["observation_count"]) for w in sorted(whole, key=lambda w: (w["start_ts"], w["end_ts"]))]


def test_dominant_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "", 4)], "k int, v string, i int")
    assert segments.dominant(df, ["k"], "v", ["i"], "d").first().d == "b"


def test_batch_prefix(spark):
    rows = [(1, 0.0, 50.0), (1, 51.0, 49.0), (1, 101.0, 49.0), (1, 151.0, 39.0), (2, 0.0, 30.0)]
    df = spark.createDataFrame(rows, "k int, start_ts double, d double")
    assert [r.start_ts for r in segments.batch_prefix(df, ["k"], "d", ["start_ts"], 120.0).orderBy("start_ts").collect()] == [0.0, 51.0, 101.0]


def test_pending_batches(spark):
    segs = spark.createDataFrame([(1, 0.0, 10.0, 10.0, True), (1, 10.0, 40.0, 30.0, False)], "k int, start_ts double, end_ts double, duration_s double, is_closed boolean")
    rows = spark.createDataFrame([(1, 5.0), (1, 30.0)], "k int, end_ts double")
    assert segments.pending_batches(segs, rows, ["k"], 60.0).count() == 0
    assert segments.pending_batches(segs, rows, ["k"], 60.0, force_flush=True).count() == 2
    assert segments.pending_batches(segs, rows, ["k"], 5.0).count() == 1


def test_reserved_ranges_are_closed(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 11.0, 12.0), (3, 10.0, 10.0)], "i int, a double, b double")
    left = segments.without_reserved(rows, spark.createDataFrame([(5.0, 10.0)], "from_ts double, to_ts double"), F.col("a"), F.col("b"))
    assert [r.i for r in left.collect()] == [2]


def summaries(spark, *rows):
    """(id, start, end, text, app, closure, vector)"""
    full = [(1, r[0], float(r[1]), float(r[2]), r[3], r[4], "w", r[5], False, r[6]) for r in rows]
    return spark.createDataFrame(full, "k int, id long, start_ts double, end_ts double, summary_text string, process_name string, window_title string, closure_reason string, forced boolean, embedding array<double>")


@pytest.mark.parametrize(
    "right, blockers",
    [
        ((2, 1600, 1700, "b", "app", "", [1.0, 0.0]), ["gap_too_large"]),
        ((2, 200, 300, "b", "app", "lock_state_changed", [1.0, 0.0]), ["lock_boundary"]),
        ((2, 200, 300, "b", "app", "idle_gap", [1.0, 0.0]), ["pause_boundary"]),
        ((2, 200, 300, "then b", "app", "", [1.0, 0.0]), ["transition_keyword"]),
        ((2, 200, 300, "a", "app", "", [1.0, 0.0]), []),
    ],
)
def test_pair_blockers(spark, right, blockers):
    s = summaries(spark, (1, 100, 200, "a", "app", "", [1.0, 0.0]), right)
    r = coalesce.score_pairs(coalesce.adjacent_pairs(s, ["k"]), CoalesceSettings(min_score=0.55)).first()
    assert r.blockers == blockers and r.decision == ("no_merge" if blockers else "merge")
    assert r.reasons == (blockers or ["score_threshold_met"])


def test_default_score_needs_everything_equal(spark):
    s = summaries(spark, (1, 100, 200, "a", "app", "", [1.0, 0.0]), (2, 200, 300, "a", "app", "", [1.0, 0.0]))
    r = coalesce.score_pairs(coalesce.adjacent_pairs(s, ["k"])).first()
    assert r.merge_score == 0.85 and r.decision == "merge"


def test_clusters_compose_and_trace(spark):
    v = [1.0, 0.0]
    s = summaries(spark, (1, 0, 10, "a", "app", "", v), (2, 10, 20, "b", "app", "", v), (3, 20, 30, "a", "app", "", v), (4, 5000, 5010, "c", "app", "", None))
    d = coalesce.score_pairs(coalesce.adjacent_pairs(s, ["k"]), CoalesceSettings(min_score=0.3))
    c = coalesce.compose(coalesce.clusters(s, d, ["k"]), ["k"]).orderBy("cluster").collect()
    assert [(r.summary_ids, r.summary_text, r.process_name) for r in c] == [([1, 2, 3], "a Then b", "app"), ([4], "c", "app")]
    t = coalesce.traceability(coalesce.members(coalesce.compose(coalesce.clusters(s, d, ["k"]), ["k"]), ["k"]), d, ["cluster"]).collect()
    assert len(t) == 1 and t[0].diagnostics == 2 and t[0].confidence == "Low"
    assert "embedding_unavailable" in d.where("r_id = 4").first().reasons


def test_summary_context(spark):
    df = spark.createDataFrame([('{"source_context": {"process_name": " App ", "blocked": true}, "source_batch": {"force_flush": true}}',), ("[1]",), (None,)], "summary_json string")
    a, b, c = coalesce.summary_context(df).collect()
    assert (a.process_name, a.blocked, a.forced) == ("app", True, True) and (b.process_name, b.forced) == ("", False) and c.process_name == ""


def test_member_lists(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    bridge = spark.createDataFrame([(1, 12, 1), (1, 11, 0)], "coalesced_summary_id long, summary_id long, member_index int")
    assert {r.id: r.summary_ids for r in coalesce.member_lists(rows, bridge).collect()} == {1: [11, 12], 2: []}


def shots(spark, *rows):
    """(id, ts, title, hash)"""
    full = [(1, r[0], float(r[1]), "p", r[2], None, None, r[3], None, None) for r in rows]
    return spark.createDataFrame(full, "k int, id long, ts double, process_name string, window_title string, window_hwnd long, active_interval_id long, perceptual_hash string, fingerprint string, exact_hash string")


def test_screenshots(spark):
    df = shots(spark, (1, 0, "a", "00"), (2, 1, "a", "01"), (3, 2, "b", "01"), (4, 3, "a", "ff"), (5, 100, "a", "00"))
    got = dedup.representative_screenshots(df, ["k"], ScreenshotDedupSettings(max_selected=9, min_interval_s=60))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]
    reasons = {r.id: r.reason for r in dedup.capture_decisions(df, ["k"], ScreenshotDedupSettings(min_interval_s=60)).collect()}
    assert reasons == {1: "new_context", 2: "perceptual_duplicate", 3: "new_context", 4: "visual_context_changed", 5: "visual_context_changed"}


def test_summary_decisions(spark):
    rows = [(1, 1, 0.0, 10.0, 1.0, "wrote the report", "app", "w"), (1, 2, 20.0, 30.0, 2.0, "wrote the report", "app", "w"), (1, 3, 40.0, 50.0, 3.0, "wrote the report", "other", "zzz"), (1, 4, 900.0, 950.0, 4.0, "lunch", "third", "qqq")]
    df = spark.createDataFrame(rows, "k int, id long, start_ts double, end_ts double, created_ts double, summary_text string, process_name string, window_title string").withColumns({"blocked": F.lit(False), "closure_reason": F.lit("")})
    got = {r.id: (r.action, r.matched_id) for r in dedup.judge_summaries(df, ["k"], SummaryDedupSettings()).collect()}
    assert got == {1: ("store", None), 2: ("merge_previous", 1), 3: ("suppress", 2), 4: ("store", got[4][1])}


def test_entities(spark):
    rows = [(1, "matlab.exe", r"Editor - U:\PROJ1\XXX\data\Input_cases.m *", ["Working on ABC-1234 and DEF-4421"]), (2, "OUTLOOK.EXE", "RE: Project Phoenix - Outlook", []), (3, "chrome.exe", "Daily build notes - Google Chrome", []), (4, "FooTool", "FooTool - Analysis for ABC-1234 - run_042.log", None), (5, None, None, [])]
    df = spark.createDataFrame(rows, "i int, process_name string, window_title string, text_snippets array<string>")
    found = entities.drafts(df, ["i"]).cache()
    merged = entities.merge(found, ["i"])
    got = {(r.i, r.entity_type, r.entity_value): r for r in merged.collect()}
    for key in [(1, "file_path", r"U:\PROJ1\XXX\data\Input_cases.m"), (1, "file_name", "Input_cases.m"), (1, "folder_path", r"U:\PROJ1\XXX\data"), (1, "project_candidate", "PROJ1"), (1, "task_candidate", "DEF-4421"), (2, "mail_subject", "RE: Project Phoenix"), (3, "web_page_title", "Daily build notes"), (4, "file_name", "run_042.log"), (4, "unclassified_window_title", rows[3][2])]:
        assert key in got
    assert got[(1, "project_candidate", "PROJ1")].evidence_kind == "likely" and not any(k[0] == 5 for k in got)
    cover = {r.i: r for r in entities.coverage(found, merged, ["i"]).collect()}
    assert cover[4].unknown_app and cover[4].unclassified_evidence_count == 1 and not cover[4].used_specialized_parser and cover[3].parser_confidence == 0.9
    assert cover[4].matched_parser_names == ["explicit_task_label", "file_token", "ticket_label"]


def test_entity_precedence(spark):
    rows = [(1, "t", "x", "X", "text_segment", "r1", "inferred", 0.9, 0), (1, "t", "x", "x", "window_title", "r2", "observed", 0.5, 1), (1, "t", "x", "xx", "window_title", "r3", "observed", 0.7, 2)]
    df = spark.createDataFrame(rows, "k int, entity_type string, entity_normalized string, entity_value string, source_kind string, source_ref string, evidence_kind string, confidence double, pos int")
    r = entities.merge(df, ["k"]).first()
    assert (r.entity_value, r.source_kind, r.source_ref, r.evidence_kind, r.confidence) == ("X", "window_title", "r3", "observed", 0.9)


def flags(spark, **over):
    base = {f: False for f in quality.FLAGS} | {"parser_confidence": 0.0, "n_entities": 0, "n_low": 0} | over
    return spark.createDataFrame(pd.DataFrame([base]))


def test_event_scores(spark):
    rich = quality.event_score(flags(spark, **{f: True for f in ["process_evidence", "title_evidence", "has_file_evidence", "has_task_evidence", "has_conversation_evidence", "has_text_evidence", "has_screenshot_evidence", "confident_outcomes"]}, parser_confidence=0.9)).first()
    raw = quality.event_score(flags(spark, process_evidence=True, title_evidence=True, has_summary_text=True)).first()
    bad = quality.event_score(flags(spark, process_evidence=True, title_evidence=True, has_summary_text=True, degraded=True)).first()
    assert rich.bucket == "excellent" and rich.score >= 0.85 and raw.score <= 0.35 and bad.score < raw.score
    assert "structured payload degraded" in bad.weaknesses and rich.strengths[-1] == "strong evidence for historical reconstruction"


def test_daily_scores(spark):
    e = spark.createDataFrame([("d", 0.5, "weak", False), ("d", 0.9, "excellent", True)], "day string, score double, bucket string, has_file_evidence boolean")
    e = e.withColumns({f: F.lit(False) for f in ["degraded", "has_task_evidence", "has_conversation_evidence", "has_text_evidence", "has_screenshot_evidence", "blocked", "unknown_app"]})
    r = spark.createDataFrame([("d",), ("none",)], "day string").withColumns({k: F.lit(k == "has_files") for k in quality.RECAP}).withColumn("degraded", F.lit(False))
    got = {x.day: x for x in quality.daily_score(r, e).collect()}
    assert got["d"].score == pytest.approx(0.7 * 0.78 + 0.05 * 0.22, abs=1e-3) and got["none"].score == 0.05 and got["d"].has_file_evidence
    assert quality.weak_days(e).count() == 1


def test_title_similarity_reads_whole_texts(spark, tmp_path):
    from daytrace.functions.similarity import ratio
    from daytrace.plans import catalog

    opening = "these are the same sixty characters at the start of each turn "
    turns = [opening + "alpha beta gamma delta " * 9, opening + "one two three four " * 9, "x" + opening + "one two three four " * 9]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r for r in catalog.QUERIES["title_similarity"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1].ratio < 0.9 and got[1].similarity < 0.9
    for i in (1, 2):
        assert got[i].ratio == pytest.approx(ratio(turns[i], turns[i - 1]), abs=1e-6)


def test_search_without_a_limit_sorts_once(spark, tmp_path):
    from daytrace.plans import catalog

    folder = str(tmp_path)
    ids = [1, 2, 8_783, 8_784, 5_000_000, 90_000_000_000]
    spark.createDataFrame([(i, " The one ") for i in ids], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 3, "in the end") for i in ids], "conv_id long, turn int, text string").write.parquet(f"{folder}/conversations.parquet")
    for name, n in (("search_union_scoped", 5), ("search_union_whole", 12)):
        df = catalog.QUERIES[name](spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan and "SinglePartition" not in plan, name
        found = df.collect()
        assert len(found) == n and all(r.day.startswith("2024") for r in found)
        assert [r.timestamp for r in found] == sorted((r.timestamp for r in found), reverse=True)
    assert {r.source_id for r in found if r.summary_type == "event"} == set(ids)


def test_search(spark):
    e = spark.createDataFrame([(1, 1775779200.0, "Alpha 100%"), (2, 1776643200.0, "new ALPHA"), (3, 1775779300.0, "x_id")], "id long, start_ts double, summary_text string")
    d = spark.createDataFrame([(9, "2026-04-10", "alpha day", 1775779201.0)], "id long, day string, recap_text string, created_ts double")
    from datetime import date

    n = lambda q, scope: search.search_all(e, d, q, scope, date(2026, 4, 10)).count()
    assert [n(" alpha ", s) for s in ("day", "month", "year", "all")] == [2, 3, 3, 3]
    assert n("100%", "all") == 1 and n("_id", "all") == 1 and n("  ", "all") == 0
    assert search.scope_days("month", date(2025, 12, 5)) == (date(2025, 12, 1), date(2026, 1, 1))
    with pytest.raises(ValueError):
        search.scope_days("week", date(2025, 1, 1))


def test_effective_summaries(spark):
    raw = spark.createDataFrame([("a", 1), ("b", 2)], "day string, id long")
    assert sorted((r.day, r.id) for r in search.effective_summaries(raw, spark.createDataFrame([("a", 7)], "day string, id long")).collect()) == [("a", 7), ("b", 2)]


def test_jobs(spark):
    j = spark.createDataFrame([(1, "day_summary", "d", "failed", 2, None, None)], "id long, job_type string, target_day string, status string, attempt int, finished_at double, updated_ts double")
    assert jobs.day_job_action(j, "d") == ("requeue", 3) and jobs.day_job_action(j, "e") == ("create", 1)
    assert jobs.day_job_action(j.withColumn("status", F.lit("running")), "d") == ("reuse", 2)
    counts = {r.status: r.n for r in jobs.status_counts(spark.createDataFrame([("completed",), ("succeeded",), ("queued",)], "status string")).collect()}
    assert counts["completed"] == counts["succeeded"] == 2 and counts["failed"] == 0 and counts["queued"] == 1
    rec = jobs.recover(spark.createDataFrame([("running", None, None), ("queued", None, None), ("failed", 5.0, 5.0)], "status string, finished_at double, updated_ts double"), 9.0)
    assert sorted((r.status, r.finished_at) for r in rec.collect()) == [("abandoned", 9.0), ("cancelled", 9.0), ("failed", 5.0)]


def test_storage(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, True), (2, 3.0, None, True), (1, 1.0, 2.0, True), (4, 1.0, 9.0, False)], "id long, start_ts double, end_ts double, blocked boolean").withColumns({"process_name": F.lit("p"), "window_title": F.lit("w")})
    assert [r.active_interval_id for r in jobs.blocked_rows(rows).collect()] == [1]
    assert jobs.close_open(rows, 2.0).where("id = 2").first().end_ts == 3.0
    assert jobs.purged(rows, "start_ts", "end_ts", 0.0, 3.0).count() == 1
    files = spark.createDataFrame([("C:/a/x.png",), (r"C:\A\y.png",)], "path string")
    assert [r.path for r in jobs.orphans(files, spark.createDataFrame([(r"c:\a\X.png",), (None,)], "file_path string")).collect()] == [r"C:\A\y.png"]
    marked = jobs.mark_processed(spark.createDataFrame([(1, False), (2, None)], "id long, processed boolean"), spark.createDataFrame([(2,), (2,)], "id long"))
    assert {r.id: r.processed for r in marked.collect()} == {1: False, 2: True}


def test_admission(spark):
    df = spark.createDataFrame([(True, False, 1, 1, 1, 1, 1), (False, False, 1, 1, 1, 1, 1), (True, True, 1, 1, 1, 1, 1), (True, False, None, 1, 1, 1, 1), (True, False, 1, 1, 2, 1, 1)], "monitoring boolean, blocked boolean, interval_id int, hwnd int, interval_hwnd int, pid int, interval_pid int")
    assert [r.skip_reason for r in jobs.admission(df).collect()] == [None, "monitoring_inactive", "blocked", "no_active_interval", "foreground_mismatch"]


def test_reports(spark):
    cov = spark.createDataFrame(
        [(1, "Foo", "foo", "", "", ["b"], 0.3, True, 5.0, 6.0), (2, "Foo", "foo", "T", "t", ["a", " "], 0.5, True, 1.0, 9.0), (3, "Bar", "bar", "U", "u", [], 0.9, False, 0.0, 1.0)],
        "pos int, process_name string, normalized_process_name string, window_title string, normalized_window_title string, matched_parser_names array<string>, parser_confidence double, unknown_app boolean, start_ts double, end_ts double",
    ).withColumns({"extracted_entity_count": F.lit(2), "unclassified_evidence_count": F.lit(1), "used_generic_parser": F.lit(True), "used_specialized_parser": F.lit(False)})
    (r,) = reports.unknown_apps(cov).collect()
    assert (r.occurrence_count, r.first_seen_ts, r.last_seen_ts, r.sample_window_title, r.matched_parser_names, r.parser_confidence) == (2, 1.0, 9.0, "T", ["a", "b"], 0.4)
    assert reports.unknown_windows(cov).count() == 2 and "a." in reports.unknown_windows(cov).where("sample_window_title = 'T'").first().suggested_parser_reason
    assert [x.n for x in reports.rank(cov.select(F.col("process_name").alias("label"), "pos"), ["label"], None, ["pos"]).collect()] == [2, 1]
    none = spark.createDataFrame([], "process_name string, normalized_process_name string, occurrence_count long")
    assert reports.top_unknown(none, cov).first().label == "Foo"
    assert reports.coverage_by_process(cov).first().unknown_app_count == 2


def test_responses(spark):
    rows = [("```json\n{\"summary\": \"did it\", \"files\": [\"a\"], \"key_points\": [\"k\"], \"evidence_quality\": {\"overall_confidence\": 0.9}}\n```",), ("plain",), ("[1]",), ("",), (None,)]
    got = responses.parse_events(spark.createDataFrame(rows, "raw_response string")).collect()
    a = got[0]
    assert (a.summary_text, a.files, a.outcomes, a.parse_status, a.overall_confidence, a.unknowns) == ("did it", ["a"], ["k"], "validated", 0.9, [])
    assert [g.parse_status for g in got[1:]] == ["degraded"] * 4 and got[1].summary_text == "plain" and got[3].summary_text == "Unavailable." and got[1].unknowns == ["insufficient evidence"]
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 30, 1])], "k int, i int, n int")
    assert [r.chunk for r in responses.chunks(sizes, ["k"], "i", "n", 10).orderBy("i").collect()] == [1, 1, 2, 3, 4]


def test_a_fold_over_a_join_deals_its_keys_itself(spark):
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 50).alias("k"), F.col("id").alias("place"))
    joined = rows.hint("merge").join(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]).withColumn("taken", F.lit(90))
    told = responses.chunks(joined, ["k"], "place", "taken", 600)
    got = told.collect()
    assert len(got) == 4000 and all(r.chunk == r.place // 50 // 6 + 1 for r in got)
    # the join's own shuffle may be read in other parts than keys
    assert "REPARTITION_BY_COL" in told._jdf.queryExecution().executedPlan().toString()


def test_segments_pass_one_fold_per_task(spark):
    from daytrace.plans import activity

    told = activity.full_segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in told and "FlatMapGroupsInPandas" not in told


def test_stored_summaries_compare_equal_texts_once(monkeypatch):
    from types import SimpleNamespace

    calls = []
    monkeypatch.setattr(dedup, "ratio", lambda a, b: calls.append((a, b)) or 0.1)
    state = dedup.SummaryDedup(SummaryDedupSettings())
    for i in range(300):
        text = f"only in this test {'ab'[i % 2]}"
        state.judge(SimpleNamespace(id=i, start_ts=i * 1e5, end_ts=i * 1e5, norm_text=text, norm_title=f"title {i % 2} of this test", process_name="p", blocked=False, closure_reason=""))
    assert len(calls) == len(set(calls)) <= 8
