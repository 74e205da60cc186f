"""Queries of stateful streams, each over files that Spark writes from the tables, and of the batch forms that they equal."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.config import ScreenshotDedupSettings, SegmentSettings
from daytrace.functions.numeric import average_hash
from daytrace.operators import dedup
from daytrace.plans.activity import _activity
from daytrace.plans.files import _drained
from daytrace.plans.registry import query, table
from daytrace.plans.sessions import IDLE_S, observations
from daytrace.session import new_folder
from daytrace.streaming import sessions, stateful

#: Of the eight shots of a vector: seconds after the first, and what is done to the picture.
SHOTS = [(0, "same"), (30, "same"), (60, "one"), (90, "half"), (130, "same"), (260, "one"), (270, "none"), (280, "inverse")]
CAPTURE = ScreenshotDedupSettings(min_interval_s=120.0)

#: Events are small, so rows alone bound an Arrow batch; to bound its bytes Spark measures all of it again for each row.
BY_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


def as_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` as a stream, from files in a folder of their own."""
    folder = new_folder(spark, "stream-in")
    rows.write.parquet(f"{folder}/rows")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/rows").schema).parquet(f"{folder}/rows")


def _ticked(spark: SparkSession, stream: DataFrame, conf: Mapping[str, str] = {}) -> DataFrame:
    """What a stream with processing-time timers gives until its input is read."""
    folder = new_folder(spark, "stream-out")
    if (why := sessions.run_ticks(stream, sessions.once_per_batch(f"{folder}/rows"), f"{folder}/checkpoint", "1 second", conf=conf)) != sessions.EMPTY:
        raise RuntimeError(f"the stream ended: {why}")
    return spark.read.parquet(f"{folder}/rows")


def _screens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight shots of each vector as a picture of gray values, and those of every tenth that were stored before."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("machine"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int")).alias("base"))
    change = {"same": lambda x, i: x, "one": lambda x, i: x + (i == 0).cast("int"), "half": lambda x, i: F.floor(x / 2).cast("int"), "none": lambda x, i: x, "inverse": lambda x, i: F.lit(255) - x}
    kinds = [F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("s"), F.lit(kind == "none").alias("blank"), F.transform("base", f).alias("thumbnail")) for k, (s, kind) in enumerate(SHOTS) for f in [change[kind]]]
    none = F.lit(None)

    def shots(of: DataFrame, ts, i, picture, blank) -> DataFrame:
        return of.select(
            "machine", i.cast("bigint").alias("id"), ts.cast("double").alias("ts"), F.lit("viewer").alias("process_name"), F.concat(F.lit("vec "), (F.col("vec_id") % 3).cast("string")).alias("window_title"), none.cast("bigint").alias("window_hwnd"),
            none.cast("bigint").alias("active_interval_id"), F.when(~blank, F.sha2(F.array_join(picture, ","), 256)).alias("exact_hash"), F.when(~blank, average_hash(picture)).alias("perceptual_hash"), none.cast("string").alias("fingerprint"), picture.alias("thumbnail"))

    each = v.select("vec_id", "machine", F.explode(F.array(*kinds)).alias("x"))
    new = shots(each, F.col("vec_id") * 600 + F.col("x.s"), F.col("vec_id") * 8 + F.col("x.k"), F.col("x.thumbnail"), F.col("x.blank"))
    return new, shots(v.where("vec_id % 10 = 0"), F.col("vec_id") - 1_000_000, -F.col("vec_id") - 1, F.col("base"), F.lit(False))


CAPTURES_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label AS machine, list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1) * 127) AS INT)) AS b FROM embeddings),
k(k, s, kind) AS (VALUES {", ".join(f"({k}, {s}::DOUBLE, '{kind}')" for k, (s, kind) in enumerate(SHOTS))}),
p AS (SELECT machine, vec_id * 8 + k AS id, vec_id * 600 + s AS ts, 'vec ' || (vec_id % 3) AS title, kind = 'none' AS blank,
      CASE kind WHEN 'one' THEN list_concat([b[1] + 1], b[2:]) WHEN 'half' THEN list_transform(b, lambda x: x // 2) WHEN 'inverse' THEN list_transform(b, lambda x: 255 - x) ELSE b END AS th FROM v, k),
h AS (SELECT * EXCLUDE (blank), CASE WHEN NOT blank THEN array_to_string(th, ',') END AS eh, CASE WHEN NOT blank THEN array_to_string(list_transform(th, lambda x: CASE WHEN x >= list_avg(th) THEN 1 ELSE 0 END), '') END AS ph FROM p),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts, id) AS nr FROM h),
o AS (SELECT machine, vec_id - 1000000.0::DOUBLE AS ts, 'vec ' || (vec_id % 3) AS title, array_to_string(b, ',') AS eh, array_to_string(list_transform(b, lambda x: CASE WHEN x >= list_avg(b) THEN 1 ELSE 0 END), '') AS ph, NULL::INT[] AS th,
      row_number() OVER (PARTITION BY machine ORDER BY vec_id DESC, -vec_id - 1 DESC) AS back FROM v WHERE vec_id % 10 = 0),
seed AS (SELECT m.machine, coalesce(list({{'ts': ts, 'title': title, 'eh': eh, 'ph': ph, 'th': th}} ORDER BY back) FILTER (back <= 8), []) AS kept FROM (SELECT DISTINCT machine FROM v) m LEFT JOIN o ON o.machine IS NOT DISTINCT FROM m.machine GROUP BY m.machine),
r AS (SELECT machine, 0::BIGINT AS nr, NULL::BIGINT AS id, NULL::BOOLEAN AS keep, NULL::VARCHAR AS reason, NULL::INT AS distance, NULL::DOUBLE AS similarity, kept FROM seed
UNION ALL SELECT machine, nr, id, keep, reason, distance, similarity, CASE WHEN keep THEN list_concat([{{'ts': ts, 'title': title, 'eh': eh, 'ph': ph, 'th': th}}], kept)[1:8] ELSE kept END FROM (
  SELECT *, CASE WHEN alike = 0 THEN 'new_context' WHEN near IS NULL THEN 'unmatched_context' WHEN eh = near.eh THEN CASE WHEN soon THEN 'exact_duplicate' ELSE 'exact_duplicate_heartbeat' END
             WHEN distance <= 6 AND similarity >= 0.985 THEN CASE WHEN soon THEN 'high_ssim_duplicate' ELSE 'visual_context_heartbeat' END WHEN distance <= 6 AND soon THEN 'perceptual_duplicate' ELSE 'visual_context_changed' END AS reason,
         NOT (near IS NOT NULL AND soon AND (eh = near.eh OR distance <= 6)) AS keep FROM (
    SELECT *, greatest(0, ts - near.ts) < 120 AS soon, CAST(hamming(ph, near.ph) AS INT) AS distance, CASE WHEN near.th IS NOT NULL THEN greatest(0, least(1, (2 * mx * my + 6.5025) * (2 * cov + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)))) END AS similarity FROM (
      SELECT *, list_avg(th) AS mx, list_avg(near.th) AS my, list_avg(list_transform(range(1, len(th) + 1), lambda i: (th[i] - list_avg(th)) * (near.th[i] - list_avg(near.th)))) AS cov,
             list_avg(list_transform(th, lambda x: (x - list_avg(th)) * (x - list_avg(th)))) AS vx, list_avg(list_transform(near.th, lambda x: (x - list_avg(near.th)) * (x - list_avg(near.th)))) AS vy FROM (
        SELECT n.*, r.kept, len(list_filter(kept, lambda x: x.title = n.title)) AS alike,
               list_filter(kept, lambda x: x.title = n.title AND x.ph IS NOT NULL AND n.ph IS NOT NULL)[list_position(list_transform(list_filter(kept, lambda x: x.title = n.title AND x.ph IS NOT NULL AND n.ph IS NOT NULL), lambda x: hamming(n.ph, x.ph)),
                 list_min(list_transform(list_filter(kept, lambda x: x.title = n.title AND x.ph IS NOT NULL AND n.ph IS NOT NULL), lambda x: hamming(n.ph, x.ph))))] AS near
        FROM r JOIN n ON n.machine IS NOT DISTINCT FROM r.machine AND n.nr = r.nr + 1)))))
SELECT machine, id, keep, reason, distance, round(similarity, 6) AS similarity FROM r WHERE nr > 0"""


@query("capture_outcomes", CAPTURES_SQL)
def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight outcomes of capture dedup, with thumbnails, from stored screenshots on."""
    new, stored = _screens(spark, sf_dir)
    return dedup.capture_decisions(new, ["machine"], CAPTURE, stored).select("machine", "id", "keep", "reason", "distance", F.round("similarity", 6).alias("similarity"))


@query("streamed_captures", CAPTURES_SQL)
def streamed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream, whose state starts from the stored screenshots."""
    new, stored = _screens(spark, sf_dir)
    found = _drained(spark, stateful.screenshot_stream(as_stream(spark, new), "machine", CAPTURE, stored))
    return found.select("machine", "id", "keep", "reason", "distance", F.round("similarity", 6).alias("similarity"))


@query("streamed_texts", """
WITH t AS (SELECT conv_id, turn, lower(text) AS text, length(text) AS n FROM conversations WHERE text <> '')
SELECT conv_id, 'turn ' || turn AS window_title, text, CAST(n AS INT) AS raw_key_count FROM t""")
def streamed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns typed key by key, rebuilt by a stream; a flush ends each conversation's last text.

    The stream's files hold turns and ends; it types their keys itself.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ends = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("text", F.lit(None).cast("string"))
    # dealt evenly, as a turn makes hundreds of keys and a table may be a few files
    turns = c.where("text <> ''").unionByName(ends).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = F.col("text").isNull()
    key = F.when(F.col("ch") == " ", "Key.space").when(F.col("ch") == "\n", "Key.enter").otherwise(F.col("ch"))
    typed = as_stream(spark, turns).select("conv_id", "turn", end.alias("end"), F.posexplode(F.when(end, F.array(F.lit(""))).otherwise(F.split("text", ""))).alias("i", "ch")).where("ch <> '' or end")
    keys = typed.select(
        "conv_id", (F.col("turn") * 1e6 + F.col("i") / 10).alias("ts"), F.col("i").cast("bigint").alias("id"), F.when(F.col("end"), stateful.FLUSH).otherwise("down").alias("event_type"), key.alias("key"), F.array().cast("array<string>").alias("modifiers"),
        F.lit("chat").alias("process_name"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("window_title"), F.lit(1).cast("bigint").alias("hwnd"))
    return _ticked(spark, stateful.text_stream(keys, "conv_id"), BY_ROWS).select("conv_id", "window_title", "text", "raw_key_count")


@query("streamed_segments")
def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed segments of a stream of observations; each machine's last one stays open in the state."""
    found = _ticked(spark, stateful.segment_stream(as_stream(spark, _activity(spark, sf_dir)), "machine", SegmentSettings(idle_gap_s=IDLE_S, max_duration_s=86400.0)))
    return found.select("machine", "segment_id", "start_ts", "end_ts", "observation_count", "closure_reason", "process_name", "is_closed")


@query("streamed_states", """
WITH o AS (SELECT event_id, user_id AS machine, event_type AS app, epoch_us(ts) / 1e6 AS ts FROM events), s AS (SELECT machine, ts, event_id, app AS state FROM o WHERE app IN ('error', 'purchase')),
m AS (SELECT max(ts) AS last FROM o), e AS (SELECT * FROM o, m WHERE app NOT IN ('error', 'purchase') AND ceil(ts / 3600) * 3600 <= floor(last * 1000) / 1000 - 3600)
SELECT e.event_id, s.state FROM e ASOF LEFT JOIN (SELECT machine, ts, arg_max(state, event_id) AS state FROM s GROUP BY machine, ts) s ON e.machine = s.machine AND e.ts >= s.ts""")
def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control state in force at each event of a stream, once the watermark has passed it."""
    o = as_stream(spark, observations(spark, sf_dir).select("machine", F.col("event_id").alias("id"), "ts", F.col("app").alias("state")))
    control = F.col("state").isin("error", "purchase")
    return _drained(spark, stateful.state_stream(o.where(~control).drop("state"), o.where(control), "machine")).select(F.col("id").alias("event_id"), "state")
