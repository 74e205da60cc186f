"""Queries on documents, conversations, pages, labels and embeddings: search, entities, scores, coalescing, logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.config import CoalesceSettings, SummaryDedupSettings
from daytrace.functions import numeric, text
from daytrace.functions.similarity import add_ratio, add_text_similarity
from daytrace.operators import coalesce, dedup, entities, logs, quality, reports, responses, search
from daytrace.plans.registry import query, table


@query("search_union_scoped", """
WITH e AS (SELECT 'event' AS summary_type, doc_id AS source_id, 1704067200 + doc_id * 3600 AS ts, trim(text, ' ') AS text FROM documents WHERE contains(lower(text), 'the ')),
d AS (SELECT 'day' AS summary_type, conv_id * 100 + turn AS source_id, 1704067200 + conv_id * 86400 AS ts, trim(text, ' ') AS text FROM conversations WHERE contains(lower(text), 'the '))
SELECT summary_type, source_id, CAST(ts AS DOUBLE) AS "timestamp", strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%Y-%m-%d') AS day, text FROM e WHERE ts >= 1704067200 AND ts < 1735689600
UNION ALL SELECT summary_type, source_id, CAST(ts AS DOUBLE), strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%Y-%m-%d') AS day, text FROM d WHERE ts >= 1704067200 AND ts < 1735689600""")
def search_union_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a literal in a year, of both kinds."""
    return _searched(spark, sf_dir, F.col("doc_id"), F.col("conv_id"))


@query("search_union_whole", """
WITH e AS (SELECT 'event' AS summary_type, doc_id AS source_id, 1704067200 + doc_id % 8784 * 3600 AS ts, trim(text, ' ') AS text FROM documents WHERE contains(lower(text), 'the ')),
d AS (SELECT 'day' AS summary_type, conv_id * 100 + turn AS source_id, 1704067200 + conv_id % 366 * 86400 AS ts, trim(text, ' ') AS text FROM conversations WHERE contains(lower(text), 'the '))
SELECT summary_type, source_id, CAST(ts AS DOUBLE) AS "timestamp", strftime(make_timestamp(CAST(ts AS BIGINT) * 1000000), '%Y-%m-%d') AS day, text FROM (SELECT * FROM e UNION ALL SELECT * FROM d)""")
def search_union_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As search_union_scoped, but with hours and days of the year that every id falls into."""
    return _searched(spark, sf_dir, F.col("doc_id") % 8784, F.col("conv_id") % 366)


def _searched(spark: SparkSession, sf_dir: str, hour: Column, day: Column) -> DataFrame:
    """Documents and turns with a literal in 2024, dated by hours and days from its start."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (1704067200 + hour * 3600).cast("double").alias("start_ts"), F.col("text").alias("summary_text"))
    c = table(spark, sf_dir, "conversations")
    at = (1704067200 + day * 86400).cast("double")
    d = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), at.alias("created_ts"), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd").alias("day"), F.col("text").alias("recap_text"))
    return search.search_all(e, d, "the ".strip() + " ", "year", date(2024, 6, 1), None).where(F.lower("text").contains("the "))


TICKETS = "'Working on abc-' || doc_id || ' and DEF-' || (doc_id % 7) || ', see ABC-' || doc_id"


@query("entity_tickets", f"SELECT doc_id, upper(t) AS ticket FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all({TICKETS}, '(?i)\\b[A-Z][A-Z0-9]+-[0-9]+\\b'), lambda x: upper(x)))) AS t FROM documents)")
def entity_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue keys."""
    said = F.expr("'Working on abc-' || doc_id || ' and DEF-' || (doc_id % 7) || ', see ABC-' || doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tickets(said)).alias("ticket"))


@query("entity_file_tokens", r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
SELECT DISTINCT doc_id, lower(w) AS token FROM w WHERE regexp_full_match(w, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}\.[A-Za-z0-9]{1,10}')""")
def entity_file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: file-like tokens among the words of a text."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"(?U)\s+")).alias("w"))
    found = words.where(F.col("w").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\.[A-Za-z0-9]{1,10}$")).select("doc_id", F.explode(text.file_tokens(F.col("w"))).alias("t"))
    return found.select("doc_id", F.lower("t").alias("token")).distinct()


@query("entity_merge", r"""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part),
d AS (SELECT p_brand AS k, lower(p_type) AS norm, p_type AS v, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'window_title' WHEN 1 THEN 'text_segment' ELSE 'process_name' END AS src, p_size % 3 AS r, (p_size % 10) / 10.0::DOUBLE AS conf FROM p)
SELECT k, norm AS entity_normalized, arg_min(v, pos) AS entity_value, arg_min(src, (r, pos)) AS source_kind, max(conf) AS confidence FROM d GROUP BY k, norm""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of a type and value merged by precedence of their source."""
    r = F.col("p_size") % 3
    d = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("k"), F.lit("t").alias("entity_type"), F.lower("p_type").alias("entity_normalized"), F.col("p_type").alias("entity_value"), F.col("p_partkey").alias("pos"),
        F.when(r == 0, "window_title").when(r == 1, "text_segment").otherwise("process_name").alias("source_kind"), F.lit("").alias("source_ref"), F.lit("observed").alias("evidence_kind"), ((F.col("p_size") % 10) / 10.0).alias("confidence"))
    return entities.merge(d, ["k"]).select("k", "entity_normalized", "entity_value", "source_kind", "confidence")


@query("page_entities")
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of page urls as window titles of a browser."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("chrome.exe").alias("process_name"), F.concat(F.regexp_replace("url", "^[a-z]+://", "U:\\\\web\\\\"), F.lit(" - Google Chrome")).alias("window_title"), F.array().cast("array<string>").alias("text_snippets"))
    return entities.merge(entities.drafts(p, ["page_id"]), ["page_id"])


@query("evidence_score", """
WITH f AS (SELECT d.doc_id, d.source, l.quality IS NULL AS degraded, d.lang IS NOT NULL AS process_evidence, d.n_chars > 100 AS title_evidence, coalesce(l.quality = 1, false) AS has_file, d.n_chars > 2000 AS has_task, coalesce(l.toxic = 1, false) AS blocked, d.lang <> 'en' AS unknown_app FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, 0.05 + CASE WHEN degraded THEN -0.15 ELSE 0.12 END + CASE WHEN process_evidence THEN 0.07 ELSE 0 END + CASE WHEN title_evidence THEN 0.06 ELSE 0 END + CASE WHEN has_file THEN 0.20 ELSE 0 END + CASE WHEN has_task THEN 0.16 ELSE 0 END
 + 0.07 + CASE WHEN unknown_app AND NOT (has_file OR has_task) THEN -0.12 ELSE 0 END + CASE WHEN NOT (has_file OR has_task) THEN -0.10 - 0.05 ELSE 0 END + CASE WHEN blocked THEN -0.10 ELSE 0 END AS raw FROM f)
SELECT doc_id, CAST(greatest(0, least(1, round(raw, 3))) AS DOUBLE) AS score, CASE WHEN round(raw, 3) >= 0.85 THEN 'excellent' WHEN round(raw, 3) >= 0.65 THEN 'good' WHEN round(raw, 3) >= 0.35 THEN 'weak' ELSE 'poor' END AS bucket FROM s""")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence scores of documents, their labels and lengths standing for evidence."""
    return _scored(spark, sf_dir).select("doc_id", "score", "bucket")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    no, yes = F.lit(False), F.lit(True)
    flags = {
        "degraded": F.col("quality").isNull(), "process_evidence": F.col("lang").isNotNull(), "title_evidence": F.col("n_chars") > 100, "has_file_evidence": F.coalesce(F.col("quality") == 1, no), "has_task_evidence": F.col("n_chars") > 2000,
        "has_conversation_evidence": no, "has_text_evidence": yes, "has_screenshot_evidence": no, "confident_outcomes": no, "unknown_app": F.col("lang") != "en", "blocked": F.coalesce(F.col("toxic") == 1, no), "has_summary_text": yes,
        "parser_confidence": F.lit(0.3), "n_entities": F.lit(0), "n_low": F.lit(0),
    }
    return quality.event_score(d.withColumns(flags))


@query("entity_coverage", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'browser_title' WHEN 1 THEN 'mail_subject' ELSE '' END AS parsers, CAST(3 AS INT) AS entities, page_id % 3 = 2 AS unknown_app, CASE WHEN page_id % 3 = 2 THEN 0.48::DOUBLE ELSE 0.9::DOUBLE END AS parser_confidence FROM pages""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the parsers find in browser, mail and unknown windows, and how sure they are."""
    k = F.col("page_id") % 3
    n = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.when(k == 0, "chrome.exe").when(k == 1, "outlook.exe").otherwise("tool").alias("process_name"),
        F.when(k == 0, F.concat(F.lit("Notes "), n, F.lit(" - Google Chrome"))).when(k == 1, F.concat(F.lit("RE "), n, F.lit(" - Outlook"))).otherwise(F.concat(F.lit("Panel "), n)).alias("window_title"), F.array().cast("array<string>").alias("text_snippets"))
    found = entities.drafts(p, ["page_id"])
    c = entities.coverage(found, entities.merge(found, ["page_id"]), ["page_id"])
    return c.select("page_id", F.array_join("matched_parser_names", ",").alias("parsers"), F.col("extracted_entity_count").alias("entities"), "unknown_app", "parser_confidence")


EVIDENCE_SQL = """
WITH f AS (SELECT d.doc_id, d.source, l.quality IS NULL AS degraded, d.lang IS NOT NULL AS process_evidence, d.n_chars > 100 AS title_evidence, coalesce(l.quality = 1, false) AS has_file, d.n_chars > 2000 AS has_task, coalesce(l.toxic = 1, false) AS blocked, d.lang <> 'en' AS unknown_app FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, 0.05 + CASE WHEN degraded THEN -0.15 ELSE 0.12 END + CASE WHEN process_evidence THEN 0.07 ELSE 0 END + CASE WHEN title_evidence THEN 0.06 ELSE 0 END + CASE WHEN has_file THEN 0.20 ELSE 0 END + CASE WHEN has_task THEN 0.16 ELSE 0 END
 + 0.07 + CASE WHEN unknown_app AND NOT (has_file OR has_task) THEN -0.12 ELSE 0 END + CASE WHEN NOT (has_file OR has_task) THEN -0.10 - 0.05 ELSE 0 END + CASE WHEN blocked THEN -0.10 ELSE 0 END AS raw FROM f),
e AS (SELECT source AS day, blocked, greatest(0, least(1, round(raw, 3)))::DOUBLE AS score FROM s),
g AS (SELECT day, count(*) AS n, avg(score) AS average, bool_or(blocked) AS blocked, count(*) FILTER (score < 0.65) AS n_weak FROM e GROUP BY day),
k AS (SELECT *, greatest(0, least(1, 0.32::DOUBLE - CASE WHEN blocked THEN 0.03::DOUBLE ELSE 0 END)) AS recap FROM g),
r AS (SELECT *, round(CASE WHEN average <> 0 THEN average * 0.78::DOUBLE + recap * 0.22::DOUBLE ELSE recap END, 3) AS score FROM k)
"""


@query("evidence_bucket_days", EVIDENCE_SQL + """SELECT day, greatest(0, least(1, score))::DOUBLE AS daily_score, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.35 THEN 'weak' ELSE 'poor' END AS daily_bucket, n AS source_summary_count,
CASE WHEN n_weak >= n * 0.5 THEN n END AS n, CASE WHEN n_weak >= n * 0.5 THEN n_weak END AS n_weak FROM r""")
def evidence_bucket_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily scores of sources as days, and whether half of a day's evidence is weak."""
    events = _scored(spark, sf_dir).withColumn("day", F.col("source"))
    recaps = events.select("day").distinct().withColumns({k: F.lit(True) for k in quality.RECAP}).withColumn("degraded", F.lit(False))
    daily = quality.daily_score(recaps, events).select("day", F.col("score").alias("daily_score"), F.col("bucket").alias("daily_bucket"), "source_summary_count")
    return daily.join(quality.weak_days(events), "day", "left")


@query("unknown_rollup", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, url FROM pages)
SELECT host AS process_name, count(*) AS occurrence_count, CAST(min(page_id) AS DOUBLE) AS first_seen_ts, CAST(max(page_id) AS DOUBLE) AS last_seen_ts, arg_min(url, page_id) AS sample_window_title, array_to_string(list_sort(list_distinct(list(split_part(host, '.', 1)))), ',') AS matched_parser_names FROM p GROUP BY host""")
def unknown_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown apps by process, hosts standing for processes."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    c = table(spark, sf_dir, "pages").select(
        host.alias("process_name"), host.alias("normalized_process_name"), F.col("url").alias("window_title"), F.col("url").alias("normalized_window_title"), F.col("page_id").cast("double").alias("start_ts"), F.col("page_id").cast("double").alias("end_ts"),
        F.lit(0).alias("extracted_entity_count"), F.lit(1).alias("unclassified_evidence_count"), F.array(F.split(host, "[.]")[0]).alias("matched_parser_names"), F.lit(0.3).alias("parser_confidence"), F.lit(True).alias("unknown_app"), F.col("page_id").alias("pos"))
    return reports.unknown_apps(c).select("process_name", "occurrence_count", "first_seen_ts", "last_seen_ts", "sample_window_title", F.array_join("matched_parser_names", ",").alias("matched_parser_names"))


#: Vectors are summaries in order of their id, 72 a day, their label the app; cosines of neighbours are low, and so are the thresholds.
LOOSE = CoalesceSettings(min_cosine=0.1, min_score=0.2, semantic_weight=1.0)

PAIRS_SQL = """
WITH v AS (SELECT vec_id AS id, vec_id * 1200 // 86400 AS day_no, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT day_no, lag(id) OVER w AS l_id, id AS r_id, lag(label) OVER w = label AS same, list_cosine_similarity(lag(e) OVER w, e) AS cos FROM v WINDOW w AS (PARTITION BY day_no ORDER BY id)),
q AS (SELECT *, 1.0::DOUBLE * cos + 0.2::DOUBLE * same::INT + 0.1::DOUBLE * same::INT + 0.1::DOUBLE * 1 - 0.12::DOUBLE * least(1, 600.0 / 900) - 0.2::DOUBLE * (1 - same::INT) AS score FROM p WHERE l_id IS NOT NULL),
m AS (SELECT *, CASE WHEN cos >= 0.1 AND score >= 0.2 THEN 'merge' ELSE 'no_merge' END AS decision FROM q)
"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    app = F.concat(F.lit("app"), F.col("label").cast("string"))
    return v.select(
        F.floor(F.col("vec_id") * 1200 / 86400).cast("long").alias("day_no"), F.col("vec_id").alias("id"), (F.col("vec_id") * 1200.0).alias("start_ts"), (F.col("vec_id") * 1200.0 + 600).alias("end_ts"), F.lit("worked on it").alias("summary_text"), app.alias("process_name"), app.alias("window_title"),
        F.lit("").alias("closure_reason"), F.lit(False).alias("forced"), F.col("embedding").cast("array<double>").alias("embedding"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce.score_pairs(coalesce.adjacent_pairs(_summaries(spark, sf_dir), ["day_no"]), LOOSE, window_ratio=False)


@query("merge_diagnostics", PAIRS_SQL + "SELECT day_no, l_id, r_id, round(cos, 6) AS cosine_similarity, round(score, 6) AS merge_score, decision FROM m")
def merge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a day's adjacent summaries."""
    return _diagnostics(spark, sf_dir).select("day_no", "l_id", "r_id", F.round("cosine_similarity", 6).alias("cosine_similarity"), F.round("merge_score", 6).alias("merge_score"), "decision")


CLUSTERS_SQL = PAIRS_SQL + """, c AS (SELECT v.id, v.day_no, v.label, sum(CASE WHEN m.decision = 'merge' THEN 0 ELSE 1 END) OVER (PARTITION BY v.day_no ORDER BY v.id ROWS UNBOUNDED PRECEDING) AS cluster FROM v LEFT JOIN m ON m.r_id = v.id)
"""


@query("coalesce_adjacent", CLUSTERS_SQL + """SELECT day_no, CAST(cluster AS BIGINT) AS cluster, min(id) * 1200.0::DOUBLE AS start_ts, max(id) * 1200.0::DOUBLE + 600 AS end_ts, CAST(count(*) AS INT) AS member_count,
CASE WHEN count(DISTINCT label) = 1 THEN 'app' || any_value(label) ELSE 'mixed' END AS process_name FROM c GROUP BY day_no, cluster""")
def coalesce_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of merging summaries."""
    s = _summaries(spark, sf_dir)
    composed = coalesce.compose(coalesce.clusters(s, _diagnostics(spark, sf_dir), ["day_no"]), ["day_no"])
    return composed.select("day_no", "cluster", "start_ts", "end_ts", "member_count", "process_name")


@query("cluster_members", CLUSTERS_SQL + "SELECT day_no, CAST(cluster AS BIGINT) AS cluster, CAST(row_number() OVER (PARTITION BY day_no, cluster ORDER BY id) - 1 AS INT) AS member_index, id AS summary_id FROM c")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the chains in order."""
    s = _summaries(spark, sf_dir)
    composed = coalesce.compose(coalesce.clusters(s, _diagnostics(spark, sf_dir), ["day_no"]), ["day_no"])
    return coalesce.members(composed, ["day_no"]).select("day_no", "cluster", "member_index", "summary_id")


@query("traceability", CLUSTERS_SQL + """, t AS (SELECT a.day_no, a.cluster, count(*) AS diagnostics, max(score) AS s FROM m JOIN c a ON a.id = m.l_id JOIN c b ON b.id = m.r_id AND a.day_no = b.day_no AND a.cluster = b.cluster GROUP BY a.day_no, a.cluster),
n AS (SELECT day_no, cluster, count(*) AS member_count FROM c GROUP BY day_no, cluster HAVING count(*) >= 2)
SELECT n.day_no, CAST(n.cluster AS BIGINT) AS cluster, member_count, coalesce(diagnostics, 0) AS diagnostics, CASE WHEN s >= 0.92 THEN 'High' WHEN s >= 0.85 THEN 'Medium' ELSE 'Low' END AS confidence FROM n LEFT JOIN t ON n.day_no = t.day_no AND n.cluster = t.cluster""")
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score inside each chain."""
    d = _diagnostics(spark, sf_dir)
    bridge = coalesce.members(coalesce.compose(coalesce.clusters(_summaries(spark, sf_dir), d, ["day_no"]), ["day_no"]), ["day_no"])
    return coalesce.traceability(bridge, d, ["day_no", "cluster"], ["day_no"]).select("day_no", "cluster", "member_count", "diagnostics", "confidence")


@query("stale_embeddings", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 3 = 0 OR label IN (2)")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries whose cached vector is missing, of another text or of another model."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("canonical_hash"), "label")
    cache = v.where("id % 5 <> 0").select(F.col("id").alias("summary_id"), F.when(F.col("id") % 3 == 0, F.lit("old")).otherwise(F.col("canonical_hash")).alias("canonical_hash"), F.when(F.col("label") == 2, F.lit("other")).otherwise("m").alias("embedding_model"), F.lit("u").alias("embedding_base_url"))
    return coalesce.stale_embeddings(v.drop("label"), cache, "m", "u").select("id")


@query("jaccard_recent", r"""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS other, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 5)
SELECT conv_id, turn, other, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS jaccard FROM p""")
def jaccard_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, W13 (pairs): word overlap of a turn with the five before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("created_ts"), text.word_set(F.col("text")).alias("w"))
    pairs = dedup.summary_pairs(c, ["conv_id"], 5)
    return pairs.select("conv_id", F.col("n_id").alias("turn"), F.col("o_id").alias("other"), F.round(text.jaccard(F.col("n_w"), F.col("o_w")), 6).alias("jaccard"))


@query("title_similarity")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence ratio and word overlap of adjacent turns' whole texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("created_ts"), F.col("text").alias("t"))
    return add_text_similarity(add_ratio(dedup.summary_pairs(c, ["conv_id"], 1), "n_t", "o_t", "ratio"), "n_t", "o_t", "similarity").select("conv_id", F.col("n_id").alias("turn"), F.round("ratio", 6).alias("ratio"), F.round("similarity", 6).alias("similarity"))


@query("summary_decisions")
def summary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store, merge or suppress each turn against the last five."""
    c = table(spark, sf_dir, "conversations")
    s = c.select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 60.0).alias("start_ts"), (F.col("turn") * 60.0 + 30).alias("end_ts"), F.col("turn").alias("created_ts"), F.col("text").alias("summary_text"), F.col("role").alias("process_name"), F.col("role").alias("window_title"), F.lit(False).alias("blocked"), F.lit("").alias("closure_reason"))
    return dedup.judge_summaries(s, ["conv_id"], SummaryDedupSettings())


LOG = "CASE role WHEN 'user' THEN '2024-01-01 00:00:00 [INFO] core.services: event=turn_read job_id=' || conv_id || ' attempt=' || turn || ' mode=' || role WHEN 'assistant' THEN '2024-01-01 00:00:01 [ERROR] core.storage: event=turn_failed job_id=' || conv_id || ' error_type=Timeout path=/tmp/x' || turn ELSE 'loose line ' || turn END"


@query("log_records", f"""
WITH l AS (SELECT conv_id, turn, {LOG} AS line FROM conversations),
h AS (SELECT *, starts_with(line, '2024') AS head FROM l), e AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM h),
r AS (SELECT conv_id, entry, min(turn) AS line_start, max(turn) AS line_end, arg_min(line, turn) AS line FROM e WHERE entry > 0 GROUP BY conv_id, entry)
SELECT CAST(conv_id AS VARCHAR) AS source_file, line_start, line_end, CASE WHEN contains(line, 'ERROR') THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN contains(line, 'ERROR') THEN 'turn_failed' ELSE 'turn_read' END AS event_name, CAST(conv_id AS VARCHAR) AS job_id,
CASE WHEN contains(line, 'ERROR') THEN 'storage' ELSE 'lifecycle' END AS category, CASE WHEN contains(line, 'ERROR') THEN 'High' ELSE 'Low' END AS severity FROM r""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as log lines, grouped into entries and parsed."""
    out = _entries(spark, sf_dir)
    return out.select("source_file", "line_start", "line_end", "level", "event_name", F.col("fields")["job_id"].alias("job_id"), "category", "severity")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("line_no"), F.expr(LOG).alias("line"))
    return logs.parse(logs.records(lines))


@query("log_taxonomy", f"""
WITH l AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT 'storage | storage | turn_failed | event=turn_failed job_id=<num> error_type=timeout path=<path> | error_type=timeout event=turn_failed job_id=<num> path=<path>' AS signature, count(*) AS n, 'High' AS severity, 'Timeout' AS error_class FROM l""")
def log_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by masked signature, without the loose lines after them; log_taxonomy_whole keeps these."""
    return logs.taxonomy(_entries(spark, sf_dir).withColumn("traceback", F.lit(None).cast("string"))).select("signature", "n", "severity", "error_class")


@query("log_taxonomy_whole", f"""
WITH l AS (SELECT conv_id, turn, role, {LOG} AS line FROM conversations), h AS (SELECT *, sum(starts_with(line, '2024')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM l),
e AS (SELECT conv_id, entry, arg_min(role, turn) AS role, string_agg(line, chr(10) ORDER BY turn) FILTER (NOT starts_with(line, '2024')) AS trace FROM h WHERE entry > 0 GROUP BY conv_id, entry),
m AS (SELECT trim(lower(regexp_replace(coalesce(regexp_replace(trace, '\\s+', ' ', 'g'), ''), '\\b[0-9]+\\b', '<num>', 'g'))) AS trace FROM e WHERE role = 'assistant')
SELECT 'storage | storage | turn_failed | event=turn_failed job_id=<num> error_type=timeout path=<path> | ' || CASE WHEN trace = '' THEN '' ELSE trace || ' | ' END || 'error_type=timeout event=turn_failed job_id=<num> path=<path>' AS signature, count(*) AS n, trace <> '' AS has_traceback FROM m GROUP BY trace""")
def log_taxonomy_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by masked signature, those with loose lines after them apart."""
    return logs.taxonomy(_entries(spark, sf_dir)).select("signature", "n", "has_traceback")


@query("log_lifecycles", """
WITH l AS (SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(max(turn) FILTER (role = 'user') AS INT) AS attempts, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY conv_id""")
def log_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the log."""
    e = _entries(spark, sf_dir)
    n = e.groupBy(F.col("fields")["job_id"].alias("job_id")).agg(F.count("*").alias("n"))
    return logs.job_lifecycles(e).select("job_id", "attempts").join(n, "job_id")


@query("token_estimates", "SELECT doc_id, CAST(CASE WHEN n_chars > 0 THEN ceil(n_chars / 4.0) END AS BIGINT) AS tokens, length(text) > 80 AS cut FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt sizes."""
    return table(spark, sf_dir, "documents").select("doc_id", numeric.token_estimate(F.col("n_chars")).alias("tokens"), (F.char_length("text") > 80).alias("cut"))


@query("prompt_chunks", """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, turn, size, k, n AS used, 1 AS chunk FROM t WHERE k = 1 UNION ALL
SELECT t.conv_id, t.turn, t.size, t.k, CASE WHEN r.used > 0 AND r.used + t.n > 600 THEN t.n ELSE r.used + t.n END, CASE WHEN r.used > 0 AND r.used + t.n > 600 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, CAST(size AS INT) AS size, CAST(chunk AS INT) AS chunk FROM r""")
def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation filled greedily into prompts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return responses.chunks(c, ["conv_id"], "turn", "size", 600)


@query("parsed_responses", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'validated' ELSE 'degraded' END AS parse_status, CASE WHEN turn % 2 = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS overall_confidence FROM conversations""")
def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with a fence around JSON, or plain text."""
    c = table(spark, sf_dir, "conversations")
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("summary_text"), F.struct(F.lit(0.75).alias("overall_confidence")).alias("evidence_quality"))), F.lit("\n```"))
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, good).otherwise(F.concat(F.lit("said: "), "text")).alias("raw_response"))
    return responses.parse_events(rows).select("conv_id", "turn", "parse_status", "overall_confidence")


@query("hash_distances", """
WITH h AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS a, substr(md5(p_brand), 1, 16) AS b FROM part)
SELECT p_partkey, CAST(bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(b, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(b, 9, 8))::BIGINT)) AS INT) AS bits FROM h""")
def hash_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M6: differing bits of two hashes."""
    h = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 16).alias("a"), F.substring(F.md5("p_brand"), 1, 16).alias("b"))
    return h.select("p_partkey", numeric.hamming_hex(F.col("a"), F.col("b")).cast("int").alias("bits"))
