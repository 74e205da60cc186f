"""Schemas of the stored relations, as DDL; readers never infer."""

RELATIONS = {
    "key_events": "id BIGINT, ts DOUBLE, key STRING, event_type STRING, modifiers ARRAY<STRING>, process_name STRING, window_title STRING, hwnd BIGINT, active_interval_id BIGINT, processed BOOLEAN",
    "active_intervals": "id BIGINT, start_ts DOUBLE, end_ts DOUBLE, hwnd BIGINT, pid BIGINT, process_name STRING, window_title STRING, blocked BOOLEAN, summarized BOOLEAN",
    "blocked_intervals": "id BIGINT, active_interval_id BIGINT, start_ts DOUBLE, end_ts DOUBLE, process_name STRING, window_title STRING, summarized BOOLEAN",
    "text_segments": "id BIGINT, start_ts DOUBLE, end_ts DOUBLE, process_name STRING, window_title STRING, text STRING, hotkeys ARRAY<STRING>, raw_key_count INT",
    "screenshots": "id BIGINT, ts DOUBLE, file_path STRING, process_name STRING, window_title STRING, active_interval_id BIGINT, window_hwnd BIGINT, fingerprint STRING, exact_hash STRING, perceptual_hash STRING, image_width INT, image_height INT, nearest_phash_distance INT, nearest_ssim DOUBLE, dedup_reason STRING, visual_context_streak INT",
    "summary_jobs": "id BIGINT, start_ts DOUBLE, end_ts DOUBLE, status STRING, error STRING, job_type STRING, target_day STRING, queued_at DOUBLE, created_at DOUBLE, started_at DOUBLE, finished_at DOUBLE, timeout_s DOUBLE, attempt INT, input_chars BIGINT, input_token_estimate BIGINT, priority INT, created_ts DOUBLE, updated_ts DOUBLE",
    "summaries": "id BIGINT, job_id BIGINT, start_ts DOUBLE, end_ts DOUBLE, summary_text STRING, summary_json STRING, created_ts DOUBLE",
    "activity_entities": "id BIGINT, summary_id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, entity_type STRING, entity_value STRING, entity_normalized STRING, source_kind STRING, source_ref STRING, evidence_kind STRING, confidence DOUBLE, attributes_json STRING, created_at DOUBLE",
    "summary_embeddings": "summary_id BIGINT, canonical_hash STRING, embedding ARRAY<DOUBLE>, embedding_model STRING, embedding_base_url STRING, created_ts DOUBLE, updated_ts DOUBLE",
    "coalesced_summaries": "id BIGINT, day STRING, start_ts DOUBLE, end_ts DOUBLE, summary_text STRING, summary_json STRING, created_ts DOUBLE",
    "coalesced_summary_members": "coalesced_summary_id BIGINT, summary_id BIGINT, member_index INT",
    "semantic_merge_diagnostics": "id BIGINT, day STRING, left_summary_id BIGINT, right_summary_id BIGINT, embedding_cosine_similarity DOUBLE, app_similarity_score DOUBLE, window_similarity_score DOUBLE, keyword_overlap_score DOUBLE, temporal_gap_seconds DOUBLE, blockers ARRAY<STRING>, final_merge_score DOUBLE, decision STRING, reasons ARRAY<STRING>, created_ts DOUBLE",
    "daily_summaries": "id BIGINT, day STRING, recap_text STRING, recap_json STRING, source_batch_count INT, created_ts DOUBLE",
}


def evolve(df, name: str):
    """``df`` with the columns of relation ``name`` in order: missing ones null, other ones dropped (additive migration)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(RELATIONS[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
