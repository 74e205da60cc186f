"""URL filters: host-suffix and path-prefix expressions, joined by a short digest prefix and confirmed by the full digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import BROADCAST_ROWS, Scratch, join_counted

#: Hex digits of the digest that rows are joined by (32 bits).
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    ``rules`` has verdict, host, path. A rule fits its host and all its subdomains where the path starts with the
    rule's; of several that fit, the longest host and path together win, then the longer host, then ``block``.
    Without one, rule is null and the verdict is ``default``. Only distinct (host, path) are expanded, so that a hot
    host or repeated url costs one expansion; the lengths of rule paths bound the expressions of each.
    Null, empty and odd urls (no ``://``) have empty host and path and get the default. Repeated rows are each
    returned; repeated rules are one rule; an empty rule table allows all.
    """
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    scratch = Scratch(pages.sparkSession, "urls")
    split = pages.select(F.struct(F.lit(0), *[pages[c] for c in kept]).alias("page"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    keyed = rules.select("verdict", "host", "path").distinct().select(
        F.concat("host", "path").alias("rule"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest"),
        F.char_length("host").alias("host_len"), F.char_length("path").alias("path_len"), "verdict",
    ).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    lengths = keyed.agg(F.count("*").alias("n"), F.collect_set("path_len").alias("lengths")).first()
    # a url without a host fits no rule, and none of these is joined
    urls = scratch.write(split.where(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("c")))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths["lengths"])] or [F.lit(None).cast("string")]
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(F.array_compact(F.array(*prefixes)), lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    wanted = urls.select("host", "path", "c", F.explode(F.array_distinct(digests)).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    if lengths["n"] <= broadcast_rows:
        hits = wanted.join(F.broadcast(keyed), "short").where("full = digest")
    else:
        # urls meet at short prefixes like that of a whole top-level domain, so the prefixes that many have are split
        wanted = scratch.write(wanted)
        rule = F.struct("rule", "digest", "host_len", "path_len", "verdict")
        found = keyed.groupBy("short").agg(F.collect_list(rule).alias("rules")).join(wanted.groupBy("short").agg(F.count("*").alias("c")), "short")
        met = join_counted(wanted.withColumnRenamed("c", "urls"), found, ["short"], scratch, size=F.aggregate("rules", F.lit(0), lambda a, r: a + F.octet_length(r["rule"]) + 100))
        hits = met.select("host", "path", F.col("urls").alias("c"), "full", F.explode("rules").alias("r")).where("full = r.digest").select("host", "path", "c", "r.*")
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("len"), "host_len", F.col("verdict").alias("v"), "rule")).alias("best"), F.first("c").alias("c"))
    ruled = join_counted(split.where(F.col("host") != ""), best, ["host", "path"], scratch, "left", size=F.octet_length("host") + 2 * F.octet_length("path"))
    none = split.where(F.col("host") == "").withColumn("best", F.lit(None).cast(dict(best.dtypes)["best"]))
    out = ruled.unionByName(none)
    return out.select(*[F.col("page")[c].alias(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
