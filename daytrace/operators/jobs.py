"""Jobs, storage state and admission: latest-wins tables, counts and decision tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
STATUSES = ["queued", "running", "completed", "succeeded", "failed", "cancelled", "abandoned"]
ACTIVE, TERMINAL = ["queued", "running"], ["completed", "succeeded", "failed", "cancelled", "abandoned"]


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key of an append-only table."""
    state = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``new`` replaces ``old`` by key, but for the columns ``keep``, which a replaced row passes on."""
    cols = old.columns
    both = old.withColumn("_v", F.lit(0)).unionByName(new.select(*cols).withColumn("_v", F.lit(1)))
    pick = [F.min_by(c, "_v").alias(c) if c in keep else F.max_by(c, "_v").alias(c) for c in cols if c not in keys]
    return both.groupBy(*keys).agg(*pick).select(*cols)


def status_counts(jobs: DataFrame, statuses: Sequence[str] = STATUSES, status: str = "status") -> DataFrame:
    """A1: rows of every status, zero where there are none; completed and succeeded stand for each other."""
    names = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    n = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    done = F.col("status").isin("completed", "succeeded")
    counts = F.broadcast(names).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("n", F.when(done, F.sum(F.when(done, F.col("n")).otherwise(0)).over(Window.partitionBy(done))).otherwise(F.col("n")))


def ranges(tables: Mapping[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Table, rows, first and last time of each (frame, start column, end column)."""
    out = None
    for name, (df, start, end) in tables.items():
        last = F.coalesce(F.col(end), F.col(start)) if end else F.col(start)
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.min(start).alias("first_ts"), F.max(last).alias("last_ts"))
        out = one if out is None else out.unionByName(one)
    return out


def recover(jobs: DataFrame, now: float) -> DataFrame:
    """Running jobs were abandoned, queued ones cancelled."""
    status = F.when(F.col("status") == "running", "abandoned").when(F.col("status") == "queued", "cancelled").otherwise(F.col("status"))
    ended = F.col("status").isin(ACTIVE)
    return jobs.withColumns({"status": status, "finished_at": F.when(ended, F.lit(now)).otherwise(F.col("finished_at")), "updated_ts": F.when(ended, F.lit(now)).otherwise(F.col("updated_ts"))})


def close_open(intervals: DataFrame, now: float) -> DataFrame:
    """Open intervals end now."""
    return intervals.withColumn("end_ts", F.coalesce("end_ts", F.greatest(F.col("start_ts"), F.lit(now))))


def mark_contained(intervals: DataFrame, low: float, high: float) -> DataFrame:
    """K4: intervals inside the range are summarized; an open one counts where it starts."""
    inside = (F.col("start_ts") >= low) & (F.coalesce("end_ts", "start_ts") <= high)
    return intervals.withColumn("summarized", F.coalesce("summarized", F.lit(False)) | inside)


def purged(rows: DataFrame, start: str, end: str | None, low: float, high: float, also: Column | None = None) -> DataFrame:
    """K5: what remains when rows inside the range (and for which ``also`` holds) go."""
    last = F.coalesce(F.col(end), F.col(start)) if end else F.col(start)
    gone = (F.col(start) >= low) & (last <= high)
    return rows.where(~F.coalesce(gone & also if also is not None else gone, F.lit(False)))


def mark_processed(events: DataFrame, ids: DataFrame) -> DataFrame:
    """K3: events whose id is in ``ids`` are processed."""
    done = ids.select(F.col("id").alias("_done")).distinct()
    return events.join(done, F.col("id") == F.col("_done"), "left").withColumn("processed", F.coalesce("processed", F.lit(False)) | F.col("_done").isNotNull()).drop("_done")


def blocked_rows(intervals: DataFrame) -> DataFrame:
    """K1: one blocked row per closed blocked interval."""
    cols = [F.col("id").alias("active_interval_id"), "start_ts", "end_ts", "process_name", "window_title", F.lit(False).alias("summarized")]
    return intervals.where(F.col("blocked") & F.col("end_ts").isNotNull()).select(*cols).dropDuplicates(["active_interval_id"])


def is_blocked(process: Column, names: Sequence[str]) -> Column:
    """Privacy list, in any case."""
    return F.lower(process).isin([n.lower() for n in names])


def path_key(c: Column) -> Column:
    """Windows paths compare in lower case with backslashes."""
    return F.lower(F.replace(c, F.lit("/"), F.lit("\\")))


def orphans(files: DataFrame, shots: DataFrame) -> DataFrame:
    """K6: files (path) that no screenshot refers to."""
    used = shots.select(path_key(F.col("file_path")).alias("_key")).where("_key is not null").distinct()
    return files.withColumn("_key", path_key(F.col("path"))).join(used, "_key", "left_anti").drop("_key")


def admission(capture: DataFrame) -> DataFrame:
    """Reason to skip a capture, null to admit it: monitoring, blocked, interval_id, hwnd, pid against the interval's."""
    c = F.col
    return capture.withColumn("skip_reason", F.when(~c("monitoring"), "monitoring_inactive").when(c("blocked"), "blocked").when(c("interval_id").isNull(), "no_active_interval").when(
        ~c("hwnd").eqNullSafe(c("interval_hwnd")) | ~c("pid").eqNullSafe(c("interval_pid")), "foreground_mismatch"))


def may_start(state: DataFrame) -> DataFrame:
    """may_start and its reason from bypass, gate_enabled and locked (null: not known, which admits)."""
    c = F.col
    reason = F.when(c("bypass"), "bypass").when(~c("gate_enabled"), "gate_disabled").when(c("locked").isNull(), "unknown_admits").when(c("locked"), "locked").otherwise("not_locked")
    return state.withColumns({"admission": reason, "may_start": reason != "not_locked"})


def as_of_state(events: DataFrame, states: DataFrame, keys: Sequence[str], ts: str = "ts", state: str = "state") -> DataFrame:
    """Each event with the last state at or before it; null before the first."""
    keys = list(keys)
    cols = [c for c in events.columns]
    both = events.withColumn("_o", F.lit(1)).unionByName(states.select(*keys, ts, F.col(state).alias("_state")).withColumn("_o", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(ts, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(state, F.last("_state", ignorenulls=True).over(w)).where("_o = 1").select(*cols, state)


def missing_recaps(summaries: DataFrame, recaps: DataFrame, jobs: DataFrame, today: str, cutoff: str) -> DataFrame:
    """Days before today and the cutoff with summaries, but neither recap nor active day job."""
    days = summaries.select("day").distinct().where((F.col("day") < today) & (F.col("day") < cutoff))
    busy = jobs.where((F.col("job_type") == "day_summary") & F.col("status").isin(ACTIVE)).select(F.col("target_day").alias("day"))
    return days.join(recaps.select("day").distinct(), "day", "left_anti").join(busy.distinct(), "day", "left_anti").orderBy("day")


def day_job_action(jobs: DataFrame, day: str) -> tuple[str, int]:
    """K8: ("reuse", attempt) of a day's active job, ("requeue", attempt + 1) after a finished one, else ("create", 1)."""
    last = jobs.where((F.col("job_type") == "day_summary") & (F.col("target_day") == day)).orderBy(F.desc("id")).select("status", "attempt").first()
    if last is None:
        return "create", 1
    attempt = last.attempt or 1
    return ("reuse", attempt) if last.status in ACTIVE else ("requeue", attempt + 1)


def day_job_actions(jobs: DataFrame) -> DataFrame:
    """K8 for every day with a day job: day, action, attempt."""
    last = jobs.where("job_type = 'day_summary'").groupBy(F.col("target_day").alias("day")).agg(F.max_by(F.struct("status", "attempt"), "id").alias("j"))
    active, attempt = F.col("j.status").isin(ACTIVE), F.coalesce("j.attempt", F.lit(1)).cast("int")
    return last.select("day", F.when(active, "reuse").otherwise("requeue").alias("action"), F.when(active, attempt).otherwise(attempt + 1).alias("attempt"))


def write_rate(writes: DataFrame, ts: str, seconds: str = "1 second") -> DataFrame:
    """Rows per tumbling window."""
    return writes.groupBy(F.window(ts, seconds).alias("w")).agg(F.count("*").alias("writes")).select(F.col("w.start").alias("window_start"), "writes")


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each status count between two snapshots."""
    return after.join(before.withColumnRenamed("n", "_b"), "status", "full").select("status", (F.coalesce("n", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("change"))
