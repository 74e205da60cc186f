"""Entities of window titles and typed texts, as arrays of structs that are exploded and merged by precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.functions import text as T

#: Better sources and kinds of evidence come first (fixed values).
SOURCES = ["window_title", "text_segment", "process_name", "llm_inference"]
EVIDENCE = ["observed", "likely", "inferred", "unknown"]
_DRAFT = "array<struct<entity_type:string,entity_value:string,entity_normalized:string,evidence_kind:string,confidence:double,parser:string>>"


def rank(c: Column, names: Sequence[str]) -> Column:
    out = F.lit(99)
    for i, n in reversed(list(enumerate(names))):
        out = F.when(c == n, i).otherwise(out)
    return out


def _draft(kind: str, value: Column, normalized: Column, evidence: str, confidence: float, parser: str | None) -> Column:
    return F.struct(
        F.lit(kind).alias("entity_type"), value.alias("entity_value"), normalized.alias("entity_normalized"), F.lit(evidence).alias("evidence_kind"),
        F.lit(confidence).alias("confidence"), F.lit(parser).cast("string").alias("parser"),
    )


def _each(values: Column, *make) -> Column:
    """Drafts made of each value in turn, those without a value dropped."""
    drafts = F.transform(values, lambda v: F.array(*[m(v) for m in make]))
    return F.filter(F.flatten(drafts), lambda d: d["entity_value"].isNotNull() & (d["entity_value"] != ""))


def path_drafts(c: Column, parser: str | None) -> Column:
    """Path, file name, folder and project of each path in a text."""
    def folder(p: Column) -> Column:
        parent = F.regexp_replace(p, r"[\\/]+[^\\/]*$", "")
        return F.when(T.is_file_path(p), F.when(parent.rlike("^[A-Za-z]:$"), F.concat(parent, F.lit("\\"))).otherwise(parent)).otherwise(p)

    file_only = lambda p, v: F.when(T.is_file_path(p), v)
    return _each(
        T.windows_paths(c),
        lambda p: _draft("file_path", file_only(p, p), T.normalize_path(p), "observed", 0.98, parser),
        lambda p: _draft("file_name", file_only(p, T.path_name(p)), F.lower(T.path_name(p)), "observed", 0.97, parser),
        lambda p: _draft("folder_path", folder(p), T.normalize_path(folder(p)), "observed", 0.9, parser),
        lambda p: _draft("project_candidate", T.project_of_path(p), T.normalize_text(T.project_of_path(p)), "likely", 0.72, parser),
    )


def text_drafts(c: Column) -> Column:
    """what the general parsers find in any text, in their order."""
    one = lambda kind, norm, evidence, confidence, parser: lambda v: _draft(kind, v, norm(v), evidence, confidence, parser)
    return F.concat(
        path_drafts(c, "windows_path"),
        _each(T.file_tokens(c), one("file_name", F.lower, "observed", 0.88, "file_token")),
        _each(T.tickets(c), one("task_candidate", F.upper, "observed", 0.9, "ticket_label")),
        _each(T.repositories(c), one("repository", F.lower, "inferred", 0.7, "repository_hint")),
        _each(T.branches(c), one("git_branch", F.lower, "inferred", 0.68, "git_branch_hint")),
        _each(T.task_labels(c), one("task_candidate", T.normalize_text, "observed", 0.82, "explicit_task_label")),
    )


def title_drafts(process: Column, title: Column) -> Column:
    """what a window title and its process hold: paths, general finds, page, mail and conversation subjects, issue keys."""
    def subject(kind: str, names: list[str], value: Column, confidence: float, parser: str, changed: bool) -> Column:
        ok = T.names_any(process, title, names) & (value != "")
        ok = ok & (value != title) if changed else ok
        return F.when(ok, F.array(_draft(kind, value, T.normalize_text(value), "observed", confidence, parser))).otherwise(F.array().cast(_DRAFT))

    return F.concat(
        path_drafts(title, None), text_drafts(title),
        subject("web_page_title", T.BROWSERS, T.strip_browser(title), 0.93, "browser_title", True),
        subject("mail_subject", T.MAIL, T.strip_mail(title), 0.95, "mail_subject", False),
        subject("conversation_subject", T.TALK, T.strip_talk(title), 0.9, "conversation_subject", False),
        _each(T.tickets(title), lambda v: _draft("task_candidate", v, F.upper(v), "observed", 0.95, "ticket_label")),
    )


def drafts(df: DataFrame, keys: Sequence[str], process: str = "process_name", title: str = "window_title", texts: str = "text_snippets") -> DataFrame:
    """One row per find: keys, pos (order of extraction), draft columns, source_kind, source_ref."""
    p, t = T.strip(F.coalesce(F.col(process), F.lit(""))), T.strip(F.coalesce(F.col(title), F.lit("")))
    none = F.array().cast(_DRAFT)
    given = lambda v, kind: F.when(v != "", F.array(_draft(kind, v, T.normalize_text(v), "observed", 1.0, None))).otherwise(none)
    found = df.select(*keys, p.alias("_p"), t.alias("_t"), F.transform(F.coalesce(F.col(texts), F.array().cast("array<string>")), T.strip).alias("_x"))
    found = found.withColumn("_titled", F.when(F.col("_t") != "", title_drafts(F.col("_p"), F.col("_t"))).otherwise(none))
    special = F.exists("_titled", lambda d: d["parser"].isin("browser_title", "mail_subject", "conversation_subject"))
    unknown = F.when((F.col("_t") != "") & ~special, given(F.col("_t"), "unclassified_window_title")).otherwise(none)
    tag = lambda drafts, kind, ref: F.transform(drafts, lambda d: F.struct(d.alias("d"), F.lit(kind).alias("k"), ref.alias("r")))
    typed = F.flatten(F.transform("_x", lambda x, i: F.when(x != "", tag(text_drafts(x), "text_segment", F.concat(F.lit("text_segment["), i.cast("string"), F.lit("]")))).otherwise(tag(none, "", F.lit("")))))
    every = F.concat(tag(given(F.col("_p"), "program"), "process_name", F.col("_p")), tag(given(F.col("_t"), "window_title"), "window_title", F.col("_t")),
                     tag(F.col("_titled"), "window_title", F.col("_t")), tag(unknown, "window_title", F.col("_t")), typed)
    return found.select(*keys, F.posexplode(every).alias("pos", "x")).select(*keys, "pos", "x.d.*", F.col("x.k").alias("source_kind"), F.col("x.r").alias("source_ref"))


def merge(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F16: one entity per key, type and normalized value: value of the first find, best source and evidence, highest confidence.

    The reference of the best source is that of its most confident find, the first among equals.
    """
    r = rank(F.col("source_kind"), SOURCES)
    return found.groupBy(*keys, "entity_type", "entity_normalized").agg(
        F.min_by("entity_value", "pos").alias("entity_value"), F.min_by("source_kind", F.struct(r, "pos")).alias("source_kind"),
        F.min_by("source_ref", F.struct(r.alias("r"), (-F.col("confidence")).alias("c"), "pos")).alias("source_ref"),
        F.min_by("evidence_kind", F.struct(rank(F.col("evidence_kind"), EVIDENCE), "pos")).alias("evidence_kind"),
        F.max("confidence").alias("confidence"), F.min("pos").alias("pos"),
    )


def first_seen(entities: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key, the first of the entities of a type and normalized value over several segments."""
    w = Window.partitionBy(*keys, "entity_type", "entity_normalized").orderBy(*order)
    return entities.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def coverage(found: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """per key the parsers that matched, entity and unclassified counts, unknown app, confidence."""
    seen = found.groupBy(*keys).agg(
        F.array_sort(F.collect_set("parser")).alias("matched_parser_names"), F.max((F.col("entity_type") == "unclassified_window_title").cast("int")).alias("unclassified_evidence_count"),
        F.bool_or(F.coalesce(F.col("parser").isin("browser_title", "mail_subject", "conversation_subject"), F.lit(False))).alias("used_specialized_parser"),
    )
    n = merged.groupBy(*keys).agg(F.count("*").cast("int").alias("extracted_entity_count"))
    out = seen.join(n, list(keys)).withColumn("unknown_app", F.col("unclassified_evidence_count") > 0)
    return out.withColumn("parser_confidence", parser_confidence(F.col("used_specialized_parser"), F.col("extracted_entity_count"), F.col("unclassified_evidence_count")))


def parser_confidence(specialized: Column, entities: Column, unclassified: Column) -> Column:
    return (
        F.when(specialized & (entities >= 3), 0.9).when(specialized, 0.84).when(entities > unclassified + 2, 0.62).when(entities > unclassified, 0.48).otherwise(0.32)
    )


def search(entities: DataFrame, kind: str | None = None, query: str | None = None, first_day: str | None = None, last_day: str | None = None, min_confidence: float | None = None, limit: int = 200) -> DataFrame:
    """Entities by type, text in value or normalized form, day range (both ends in), confidence; latest first."""
    out = entities
    if kind:
        out = out.where(F.col("entity_type") == kind)
    if query and query.strip():
        raw = query.strip().lower()
        out = out.where(F.lower("entity_value").contains(raw) | F.lower("entity_normalized").contains(T.entity_query(F.lit(query))))
    if first_day:
        out = out.where(F.col("day") >= first_day)
    if last_day:
        out = out.where(F.col("day") <= last_day)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out.orderBy(F.desc("day"), F.desc("start_ts"), F.desc("confidence"), F.desc("id")).limit(max(1, limit))
