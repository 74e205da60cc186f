"""Model responses and prompts: lenient JSON, normal forms with fallbacks, budgets and chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from daytrace.operators.folds import fold_sorted
from daytrace.session import new_folder

LISTS = ["primary_activity", "programs_used", "files", "conversations", "follow_ups", "blocked_activity", "unknowns"]
#: Characters of a prompt.
BUDGET = 20_000


def unfenced(c: Column) -> Column:
    """A response without the code fence around it."""
    t = F.trim(c)
    body = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(t.startswith("```") & (body != ""), body).otherwise(t)


def list_at(text: Column, *names: str) -> Column:
    """First of the members that is a non-empty list (of anything, as JSON strings); a plain string is a list of one."""
    out = []
    for n in names:
        raw = F.get_json_object(text, f"$.{n}")
        many = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
        out.append(F.when(F.trim(raw).startswith("["), F.when(F.size(many) > 0, many)).when(F.trim(raw) != "", F.array(raw)))
    return F.coalesce(*out, F.array().cast("array<string>"))


def parse_events(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """summary_text, lists, overall_confidence and parse_status of event responses; what is no JSON object is degraded."""
    text = unfenced(F.col(raw))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    t = F.when(ok, text).otherwise(F.lit("{}"))
    member = lambda n: F.nullif(F.trim(F.get_json_object(t, f"$.{n}")), F.lit(""))
    said = F.trim(F.col(raw))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get_json_object(t, "$.evidence_quality.overall_confidence").try_cast("double"), F.when(said != "", 0.25).otherwise(0.0))))
    out = df.withColumns({"summary_text": F.coalesce(member("summary_text"), member("summary"), member("recap_text"), F.nullif(said, F.lit("")), F.lit("Unavailable.")), "overall_confidence": confidence,
                          "parse_status": F.when(ok, "validated").otherwise("degraded"), **{n: list_at(t, n) for n in LISTS}, "task_candidates": list_at(t, "task_candidates", "key_points"), "outcomes": list_at(t, "outcomes", "key_points")})
    unsure = (F.size("unknowns") == 0) & (F.col("overall_confidence") < 0.5)
    return out.withColumn("unknowns", F.when(unsure, F.array(F.lit("insufficient evidence"))).otherwise(F.col("unknowns")))


def merge_recaps(rows: DataFrame, keys: Sequence[str], lists: Sequence[str], order: str, most: int = 20) -> DataFrame:
    """Per key, the rows' lists one after the other, at most ``most`` members, and their texts."""
    row = F.array_sort(F.collect_list(F.struct(order, "summary_text", *lists)))
    one = rows.groupBy(*keys).agg(row.alias("_r"))
    members = lambda name: F.transform("_r", lambda x: F.coalesce(x[name], F.array().cast("array<string>")))
    joined = {n: F.slice(F.flatten(members(n)), 1, most) for n in lists}
    return one.withColumns({**joined, "summary_text": F.array_join(F.transform("_r", lambda x: x["summary_text"]), " ")}).drop("_r")


def shortened(c: Column, most: int | Column) -> Column:
    """a longer text's first characters and an ellipsis."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substr(c, F.lit(1), most), F.lit("...")))


def cut_texts(c: Column, kind: DataType, most: int) -> Column:
    """a value with every text in it shortened, at any depth of arrays, structs and maps; keys and numbers stay."""
    if isinstance(kind, StringType):
        return shortened(c, most)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: cut_texts(x, kind.elementType, most))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: cut_texts(v, kind.valueType, most))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[cut_texts(c[f.name], f.dataType, most).alias(f.name) for f in kind]))
    return c


def has_long_text(c: Column, kind: DataType, most: int) -> Column:
    """whether ``cut_texts`` cuts anything; never null."""
    if isinstance(kind, StringType):
        found = F.char_length(c) > most
    elif isinstance(kind, ArrayType):
        found = F.exists(c, lambda x: has_long_text(x, kind.elementType, most))
    elif isinstance(kind, MapType):
        found = F.exists(F.map_values(c), lambda x: has_long_text(x, kind.valueType, most))
    elif isinstance(kind, StructType) and len(kind):
        found = reduce(lambda a, b: a | b, [has_long_text(c[f.name], f.dataType, most) for f in kind])
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def prompt_payloads(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most_rows: int, most_chars: int) -> DataFrame:
    """Per key the first rows as ``items`` with texts cut, original_count, included_count, and what was truncated.

    Only the rows that are included are gathered; the others are counted.
    """
    keys = list(keys)
    cols = [c for c in rows.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_nr", F.row_number().over(w)).where(F.col("_nr") <= most_rows)
    kind = StructType([rows.schema[c] for c in cols])
    told = first.select(*keys, "_nr", F.struct(*cols).alias("_row")).select(*keys, F.struct("_nr", cut_texts(F.col("_row"), kind, most_chars).alias("row"), has_long_text(F.col("_row"), kind, most_chars).alias("cut")).alias("x"))
    some = told.groupBy(*keys).agg(F.array_sort(F.collect_list("x"), lambda a, b: a["_nr"] - b["_nr"]).alias("_x"))
    count = rows.groupBy(*keys).agg(F.count("*").alias("original_count"))
    out = count.join(some, keys).withColumns({"items": F.transform("_x", lambda x: x["row"]), "included_count": F.size("_x").cast("bigint"), "texts_truncated": F.exists("_x", lambda x: x["cut"])}).drop("_x")
    return out.withColumn("truncated", F.col("texts_truncated") | (F.col("included_count") != F.col("original_count")))


def capped(c: Column, most: int) -> Column:
    """The first members, how many there were, and whether some are left out."""
    return F.struct(F.slice(c, 1, most).alias("included"), F.size(c).alias("original_count"), (F.size(c) > most).alias("truncated"))


def chunks(rows: DataFrame, keys: Sequence[str], order: str, size: str, budget: int = BUDGET) -> DataFrame:
    """Per key, number rows into chunks (from 1) that are filled in order while their sizes fit the budget; a row above it is a chunk.

    A row without a size takes none. The greedy fill depends on all rows before, so a key's rows pass one task in order.
    """

    def fill(state: list[int], row) -> list[tuple]:
        n = 0 if pd.isna(getattr(row, size)) else int(getattr(row, size))
        if state[0] and state[0] + n > budget:
            state[:] = 0, state[1] + 1
        state[0] += n
        return [(*row, state[1])]

    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + ["chunk int"])
    return fold_sorted(rows, keys, [order], schema, lambda: [0, 1], fill)


def reduce_recaps(rows: DataFrame, keys: Sequence[str], lists: Sequence[str], order: str, size: Column, budget: int = BUDGET, recap: Callable[[DataFrame], DataFrame] = lambda merged: merged, most: int = 20) -> DataFrame:
    """Per key one recap, with chunk_count, rounds and merged_locally.

    Rows fill chunks (W19), each chunk becomes a recap, and recaps are rows of the next round, until a key has one. A key
    whose recaps would make as many chunks again is merged as it stands. ``recap`` makes the answer to a chunk from its
    merged rows. Keys that are ready leave the loop; each round is written, and the driver learns only how many are left.
    A row that takes no room counts as one character, so that a chunk's rows are bounded.
    """
    keys, spark = list(keys), rows.sparkSession
    folder, fields = new_folder(spark, "recaps"), ["summary_text", *lists]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def chunked(df: DataFrame) -> DataFrame:
        return chunks(df.withColumn("taken", F.greatest(size, F.lit(1)).cast("bigint")), keys, "place", "taken", budget)

    def answered(df: DataFrame) -> DataFrame:
        merged = recap(merge_recaps(df, [*keys, "chunk"], lists, "place", most))
        return merged.select(*keys, F.col("chunk").cast("bigint").alias("place"), *fields)

    items = written(answered(chunked(rows.select(*keys, F.col(order).cast("bigint").alias("place"), *fields))), "0")
    counts = written(items.groupBy(*keys).agg(F.count("*").alias("chunk_count")), "counts")
    end = lambda df, rounds, local: df.select(*keys, *fields, F.lit(rounds).alias("rounds"), F.lit(local).alias("merged_locally"))
    number, done = 0, None
    while True:
        n = items.groupBy(*keys).agg(F.count("*").alias("n_items"))
        done = written(end(items.join(n.where("n_items = 1"), keys, "left_semi"), number, False), "done")
        items = items.join(n.where("n_items > 1"), keys)
        placed = written(chunked(items), f"placed-{number}")
        if placed.isEmpty():
            return done.join(counts, keys)
        m = placed.groupBy(*keys).agg((F.max("chunk") >= F.max("n_items")).alias("stuck"))
        placed = placed.join(m, keys)
        done = written(end(merge_recaps(placed.where("stuck"), keys, lists, "place", most), number, True), "done")
        number += 1
        items = written(answered(placed.where("not stuck").drop("stuck")), str(number))


def pseudo_summaries(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Results of chunks (summary_text, summary_json) as summaries without an id, whose job, start, end and creation are their number."""
    out = numbered(items, keys, order, "job_id")
    at = F.col("job_id").cast("double")
    return out.select(*keys, F.lit(None).cast("bigint").alias("id"), F.col("job_id").cast("bigint").alias("job_id"), at.alias("start_ts"), at.alias("end_ts"), "summary_text", "summary_json", at.alias("created_ts"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids 1, 2, ... per key in a stated order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
