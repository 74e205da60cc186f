"""Merging adjacent summaries that continue each other, and tracing merged ones back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.config import CoalesceSettings
from daytrace.functions.numeric import cosine
from daytrace.functions.similarity import add_ratio
from daytrace.functions.text import collapse, has_transition, jaccard, strip, word_set

LOCKS, PAUSES = ["lock_state_changed", "session_locked", "session_unlocked"], ["idle_gap", "manual_pause", "paused"]
_SIDE = ["id", "start_ts", "end_ts", "summary_text", "process_name", "window_title", "closure_reason", "forced", "embedding"]


def summary_context(df: DataFrame, payload: str = "summary_json") -> DataFrame:
    """Add process_name, window_title, closure_reason, blocked and forced of a JSON payload; null members where it isn't one."""
    doc = F.try_parse_json(F.col(payload))
    get = lambda path, kind="string": F.try_variant_get(doc, path, kind)
    low = lambda c: F.coalesce(F.lower(strip(c)), F.lit(""))
    truthy = lambda c: F.coalesce(c.isNotNull() & ~c.isin("", "false", "null", "0", "[]", "{}"), F.lit(False))
    return df.withColumns({
        "process_name": low(get("$.source_context.process_name")), "window_title": low(get("$.source_context.window_title")),
        "closure_reason": low(get("$.source_context.closure_reason")), "blocked": F.coalesce(get("$.source_context.blocked", "boolean"), F.lit(False)),
        "forced": truthy(get("$.boundary")) | F.coalesce(get("$.source_batch.force_flush", "boolean"), F.lit(False)),
    })


def adjacent_pairs(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each summary with the one before it: keys, columns l_* and r_*; order is start, end, id."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts", "id")
    row = F.struct(*_SIDE)
    both = summaries.select(*keys, row.alias("r"), F.lag(row).over(w).alias("l")).where("l is not null")
    return both.select(*keys, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in _SIDE])


def score_pairs(pairs: DataFrame, s: CoalesceSettings = CoalesceSettings(), window_ratio: bool = True) -> DataFrame:
    """Features, blockers, score, decision and reasons of adjacent pairs.

    Without ``window_ratio`` titles are only compared for equality (then everything is a built-in expression).
    """
    c, lit = F.col, F.lit
    if window_ratio:
        pairs = add_ratio(pairs, "l_window_title", "r_window_title", "window_similarity")
    else:
        pairs = pairs.withColumn("window_similarity", c("l_window_title").eqNullSafe(c("r_window_title")).cast("double"))
    either = lambda name, values: c(f"l_{name}").isin(values) | c(f"r_{name}").isin(values)
    have = (F.size("l_embedding") > 0) & (F.size("r_embedding") > 0)
    out = pairs.withColumns({
        "gap_s": F.greatest(lit(0.0), c("r_start_ts") - c("l_end_ts")),
        "app_similarity": F.when((c("l_process_name") != "") & (c("l_process_name") == c("r_process_name")), 1.0).otherwise(0.0),
        "keyword_overlap": jaccard(word_set(c("l_summary_text")), word_set(c("r_summary_text"))),
        "cosine_similarity": F.when(have, cosine(c("l_embedding"), c("r_embedding"))).otherwise(0.0), "_have": F.coalesce(have, lit(False)),
    })
    out = out.withColumn("blockers", F.array_compact(F.array(
        F.when(c("gap_s") > s.max_gap_s, "gap_too_large"),
        F.when(has_transition(c("l_summary_text"), s.transitions) | has_transition(c("r_summary_text"), s.transitions), "transition_keyword"),
        F.when(lit(s.lock_blocks) & either("closure_reason", LOCKS), "lock_boundary"),
        F.when(lit(s.pause_blocks) & either("closure_reason", PAUSES), "pause_boundary"),
        F.when(c("l_forced") | c("r_forced"), "forced_boundary"),
    )))
    # the order of terms is the rule's: sums at the threshold depend on it
    score = (
        s.semantic_weight * c("cosine_similarity") + s.app_weight * c("app_similarity") + s.window_weight * c("window_similarity") + s.keyword_weight * c("keyword_overlap")
        - s.gap_penalty * F.least(lit(1.0), c("gap_s") / max(1.0, s.max_gap_s)) - s.switch_penalty * F.when(c("app_similarity") == 0, 1.0).otherwise(0.0)
    )
    out = out.withColumn("merge_score", score)
    low, good = c("cosine_similarity") < s.min_cosine, c("merge_score") >= s.min_score
    free = F.size("blockers") == 0
    out = out.withColumn("decision", F.when(free & ~low & good, "merge").otherwise("no_merge"))
    verdict = F.when(free & ~low, F.when(good, "score_threshold_met").otherwise("score_below_threshold"))
    head = F.array_compact(F.array(F.when(~c("_have"), "embedding_unavailable"), F.when(low, "below_min_cosine")))
    return out.withColumn("reasons", F.array_compact(F.concat(head, "blockers", F.array(verdict)))).drop("_have")


def clusters(summaries: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``summaries`` with ``cluster`` (1, 2, ...): a new one wherever the pair with the previous summary does not merge."""
    keys = list(keys)
    merged = scored.where("decision = 'merge'").select(*keys, F.col("r_id").alias("id"), F.lit(0).alias("_new"))
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return summaries.join(merged, [*keys, "id"], "left").withColumn("cluster", F.sum(F.coalesce("_new", F.lit(1))).over(w)).drop("_new")


def compose(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cluster: span, texts joined by " Then ", common or "mixed" context, member ids in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start_ts", "end_ts", "id", "summary_text", "process_name", "window_title")))
    one = clustered.groupBy(*keys, "cluster").agg(ordered.alias("m"))
    texts = F.array_distinct(F.filter(F.transform("m", lambda x: strip(x["summary_text"])), lambda t: t != ""))

    def common(name: str) -> Column:
        values = F.array_distinct(F.filter(F.transform("m", lambda x: x[name]), lambda v: v.isNotNull() & (v != "")))
        return F.when(F.size(values) == 0, "").when(F.size(values) == 1, values[0]).otherwise("mixed")

    alone = F.size("m") == 1
    return one.select(
        *keys, "cluster", F.array_min(F.transform("m", lambda x: x["start_ts"])).alias("start_ts"), F.array_max(F.transform("m", lambda x: x["end_ts"])).alias("end_ts"),
        F.when(alone, F.col("m")[0]["summary_text"]).otherwise(collapse(F.array_join(texts, " Then "))).alias("summary_text"),
        common("process_name").alias("process_name"), common("window_title").alias("window_title"),
        F.transform("m", lambda x: x["id"]).alias("summary_ids"), F.size("m").alias("member_count"),
    )


def members(composed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bridge rows (keys, cluster, summary_id, member_index from 0)."""
    return composed.select(*keys, "cluster", F.posexplode("summary_ids").alias("member_index", "summary_id"))


def member_lists(coalesced: DataFrame, bridge: DataFrame) -> DataFrame:
    """Coalesced rows (id) with their summary ids in order; none is an empty list."""
    lists = bridge.groupBy("coalesced_summary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_index", "summary_id"))), lambda x: x["summary_id"]).alias("summary_ids"))
    joined = coalesced.join(lists, F.col("id") == F.col("coalesced_summary_id"), "left").drop("coalesced_summary_id")
    return joined.withColumn("summary_ids", F.coalesce("summary_ids", F.array().cast("array<bigint>")))


def confidence_bucket(score: Column) -> Column:
    """High from 0.92, Medium from 0.85, else Low."""
    return F.when(score >= 0.92, "High").when(score >= 0.85, "Medium").otherwise("Low")


def traceability(bridge: DataFrame, diagnostics: DataFrame, cluster: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Clusters of two or more with the best score and number of diagnostics between two of their members."""
    cluster, on = list(cluster), list(on)
    many = bridge.groupBy(*cluster).agg(F.count("*").alias("member_count")).where("member_count >= 2")
    left = bridge.select(*cluster, F.col("summary_id").alias("l_id"))
    right = bridge.select(*cluster, F.col("summary_id").alias("r_id"))
    hits = diagnostics.select(*on, "l_id", "r_id", "merge_score").join(left, [*on, "l_id"] if set(on) <= set(cluster) else "l_id").join(right, [*cluster, "r_id"])
    best = hits.groupBy(*cluster).agg(F.max("merge_score").alias("merge_score"), F.count("*").alias("diagnostics"))
    out = many.join(best, cluster, "left").na.fill(0.0, ["merge_score"]).na.fill(0, ["diagnostics"])
    return out.withColumn("confidence", confidence_bucket(F.col("merge_score")))


def stale_embeddings(summaries: DataFrame, cache: DataFrame, model: str, base_url: str) -> DataFrame:
    """Summaries (id, canonical_hash) whose cached vector is missing or of another text, model or server."""
    good = cache.where((F.col("embedding_model") == model) & (F.col("embedding_base_url") == base_url)).select(F.col("summary_id").alias("id"), "canonical_hash")
    return summaries.join(good, ["id", "canonical_hash"], "left_anti")
