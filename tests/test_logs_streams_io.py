"""Logs, bundles and streams end to end on small files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from daytrace import session
from daytrace.operators import logs, reports
from daytrace.operators.intervals import runs
from daytrace.sources import bundles
from daytrace.streaming import sessions

LOG = """2024-01-01 10:00:00 [ERROR] app.core.services: event=job_failed job_id=7 error_type=
Traceback (most recent call last):
  File "a.py", line 3, in f
    x()
ValueError: bad 42
2024-01-01 10:00:01 [INFO] app.lmstudio: [LLM] stage=job_created job_id=1 job_type=day_summary target_day=2024-01-01
2024-01-01 10:00:02 [INFO] app.lmstudio: [LLM] stage=request_submit job_id=1 endpoint=http://h/v1 timeout_s=1.0
2024-01-01 10:00:03 [INFO] app.lmstudio: [LLM] stage=http_response job_id=1 status=ok elapsed_s=1.25 http_status=200
2024-01-01 10:00:04 [INFO] app.lmstudio: [LLM] stage=job_completed job_id=1 attempt=2
2024-01-01 09:00:04 [WARNING] app.storage: took 3.25 s for 0f8fad5b-d9cb-469f-a165-70867728950e in C:\\tmp\\x.db session_id=s1
2024-01-01 10:30:00 [INFO] app.main: event=storage_closed
2024-01-01 10:30:01 [INFO] app.main: event=summary_flush_triggered
2024-01-01 10:30:02 [INFO] app.main: event=shutdown_complete
"""
DUMP = """session_id=s1 pid=12
Windows fatal exception: access violation

Thread 0x0000a1 (most recent call first):
  File "b.py", line 160 in run
  File "c.py", line 2 in go

Current thread 0x0000b2 (most recent call first):
  File "d.py", line 9 in main
"""


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def put(folder, name, body):
    with open(os.path.join(folder, name), "w") as f:
        f.write(body)


def test_logs(spark, folder):
    put(folder, "a.log", LOG)
    put(folder, "b.txt", "not a log")
    lines = bundles.read_logs(spark, folder)
    e = logs.parse(logs.records(lines)).cache()
    rows = e.orderBy("pos").collect()
    assert len(rows) == 9 and (rows[0].line_start, rows[0].line_end, rows[0].error_class, rows[0].severity) == (1, 5, "ValueError", "High")
    assert rows[1].event_name == "job_created" and rows[1].category == "lmstudio" and rows[5].fields == {"session_id": "s1"}
    job = {r.job_id: r for r in logs.job_lifecycles(e).collect()}["1"]
    assert job.terminal_status == "completed" and job.attempts == 2 and job.job_type == "day_summary" and job.target_day == "2024-01-01"
    req = logs.requests(e).where("job_id = '1'").collect()
    assert len(req) == 1 and req[0].outcome == "success" and req[0].elapsed_s == 1.25 and logs.long_running(logs.requests(e)).count() == 1
    assert logs.queue_audit(logs.job_lifecycles(e)).first().terminal == 2
    signatures = [r.signature for r in logs.taxonomy(e).collect()]
    warned = next(s for s in signatures if "<uuid>" in s)
    assert "<path>" in warned and "3.25" not in warned and "<num>" in warned and not any("42" in s for s in signatures)
    odd = logs.time_anomalies(e.withColumn("t", F.col("ts").cast("double")), "t", ["pos"], ["source_file"]).collect()
    assert [r.anomaly for r in odd] == ["negative_delta", "large_gap"]
    line = logs.timeline(e, ["storage_closed", "summary_flush_triggered", "shutdown_complete"])
    assert {r.type for r in logs.order_violations(line).collect()} == {"shutdown_storage_ordering_violation", "missing_summary_workers_joined", "missing_crash_finalization_marker"}
    assert logs.class_spans(e).first().error_class == "ValueError"


def test_fields(spark):
    df = spark.createDataFrame([("event=x a=1 b=two words c= a=3",), ("nothing",), ("",)], "m string")
    assert [r.f for r in df.select(logs.fields_of(F.col("m")).alias("f")).collect()] == [{"event": "x", "b": "two words", "c": "", "a": "3"}, {}, {}]


def test_crash_dumps(spark, folder):
    put(folder, "a.log", LOG)
    put(folder, "crash.log", DUMP)
    lines = bundles.read_logs(spark, folder)
    (d,) = logs.correlate_crashes(logs.crash_dumps(lines), logs.parse(logs.records(lines))).collect()
    assert d.thread_count == 2 and d.top_frame.line == 160 and d.confidence == "High" and d.matched_by == "session_id" and d.pid == 12


def test_latency(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "k int, v double")
    r = logs.latency(df, ["k"], "v").first()
    assert (r.n, r.min, r.median, r.p90, r.max, r.mean) == (10, 1, 5.5, 9, 10, 5.5)


def test_bundles(spark, folder):
    frames = {
        "summaries": spark.createDataFrame([(1, "2026-04-20", 5.0), (2, "2026-04-21", 6.0)], "summary_id long, day string, start_ts double"),
        "daily_summaries": spark.createDataFrame([("2026-04-20",)], "day string"),
        "activity_entities": spark.createDataFrame([("program", "x"), ("file_path", "y"), ("task_candidate", "z")], "entity_type string, entity_value string"),
        "evidence_quality": spark.createDataFrame([("event", "2026-04-20", 0.9, "excellent", True), ("event", "2026-04-21", 0.1, "poor", False)], "summary_kind string, day string, score double, bucket string, has_file_evidence boolean"),
    }
    counts = bundles.export_bundle(frames, folder)
    assert counts == {"summaries": 2, "daily_summaries": 1, "activity_entities": 3, "evidence_quality": 2}
    b = bundles.load_bundle(spark, folder)
    m = reports.metrics(b).first()
    assert m.event_summary_count == 2 and m.entities_per_summary == 1.5 and m.average_score == 0.5 and m.missing_daily_recap_days == ["2026-04-21"] and m.raw_only_event_summary_count == 1
    assert "- " in reports.render(m) and b["unknown_apps"].count() == 0
    assert reports.compare(reports.metrics(b), reports.metrics(b)).first().event_summary_count == 0
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, folder + "/none")


def test_jsonl_drops_what_is_no_object(spark, folder):
    put(folder, "x.jsonl", '{"day": "a"}\n[1]\nnope\n\n{"day": "b", "odd": 1}\n')
    assert sorted(r.day for r in bundles.read_jsonl(spark, f"{folder}/x.jsonl", "day string").collect()) == ["a", "b"]


def test_replace_days(spark, folder):
    path = folder + "/t"
    bundles.replace_days(spark.createDataFrame([("a", 1), ("b", 2)], "day string, v int"), path)
    bundles.replace_days(spark.createDataFrame([("b", 3)], "day string, v int"), path)
    assert sorted((r.day, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_interval_stream_equals_batch(spark, folder):
    rows = [(i, 1 + i % 2, "ab"[(i // 4) % 2], float(i)) for i in range(20)]
    schema = "event_id long, machine long, app string, ts double"
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    sessions.drain(sessions.interval_stream(stream), sessions.once_per_batch(folder + "/out"), folder + "/ckpt")
    got = sorted((r.machine, r.start_ts, r.end_ts, r.app) for r in spark.read.parquet(folder + "/out").collect())
    batch = runs(spark.createDataFrame(rows, schema), ["machine"], "ts", ["event_id"], ["app"]).where("end_ts is not null").collect()
    assert got == sorted((r.machine, r.start_ts, r.end_ts, r.app) for r in batch)


def test_idle_sessions_merge_at_the_gap(spark, folder):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:08"), (1, "2024-01-01 00:00:17")]
    df = spark.createDataFrame(rows, "k int, s string").select("k", F.to_timestamp("s").alias("ts"))
    assert sessions.idle_sessions(df, "k", "ts", "8 seconds").count() == 2


def test_manifest(spark, folder):
    bundles.export_bundle({"summaries": spark.range(3)}, folder, {"from": "a"})
    assert json.loads(spark.read.text(folder + "/manifest.json").first().value) == {"from": "a", "row_counts": {"summaries": 3}}


def test_shared_folder_is_the_cluster_s(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == given if given else session.shared_folder(spark).startswith("file:")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_a_filter_on_entries_reads_their_fields_twice_at_most(spark):
    said = "2024-01-01 00:00:00 [ERROR] app.crash: event=crash_exception stage=main a=1 a=2 b"
    found = logs.parse(logs.records(spark.createDataFrame([("f", 1, said)], "source_file string, line_no int, line string")))
    assert found.first().fields == {"event": "crash_exception", "stage": "main", "a": "2 b"}
    got = logs.crash_stages(found)
    assert got.collect() == [("main", 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 4  # fields, traceback


def test_a_log_audit_parses_its_entries_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def line(i):
        seen.add(1)
        return "f", i, f"2024-01-01 00:00:00 [INFO] app.client: event=job_created job_id=j{i}"

    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(50), 2).map(line), "source_file string, line_no int, line string")
    counts = bundles.write_log_audit(logs.parse(logs.records(rows)), tempfile.mkdtemp(prefix="spark-"))
    assert counts["parsed_events"] == 50 and counts["event_counts"] == 1
    assert seen.value == 50
