"""Typed text from key events: split by windows, text by folding the tokens of a segment."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.session import ship

GAP_S = 8.0
BACKSPACE = "<BACKSPACE>"
# fixed values
SHIFTED = {
    "1": "!", "2": "@", "3": "#", "4": "$", "5": "%", "6": "^", "7": "&", "8": "*", "9": "(", "0": ")", "-": "_", "=": "+",
    "[": "{", "]": "}", "\\": "|", ";": ":", "'": '"', ",": "<", ".": ">", "/": "?", "`": "~",
}
MODIFIERS = ["ctrl", "alt", "shift", "win", "cmd"]
HOTKEY_MODIFIERS = ["ctrl", "alt", "win", "cmd"]


def is_modifier(key: Column) -> Column:
    """The key is itself a modifier."""
    return (F.char_length(key) > 2) & key.rlike(r"(?i)shift|ctrl|alt|cmd|win|super")


def is_hotkey(key: Column, modifiers: Column) -> Column:
    """A key pressed with ctrl, alt, win or cmd."""
    low = F.transform(F.coalesce(modifiers, F.array().cast("array<string>")), lambda m: F.lower(m))
    return F.arrays_overlap(low, F.array(*map(F.lit, HOTKEY_MODIFIERS))) & ~is_modifier(key)


def format_hotkey(key: Column, modifiers: Column) -> Column:
    """modifiers in order and the key, upper case, joined by plus."""
    held = F.filter(modifiers, lambda m: F.lower(m).isin(MODIFIERS))
    name = F.when(key.startswith("Key."), F.substring(key, 5, 1 << 20)).otherwise(key)
    return F.concat_ws("+", F.transform(held, lambda m: F.upper(m)), F.upper(name))


def token_of(key: Column, modifiers: Column) -> Column:
    """the character that a key types, BACKSPACE, or null."""
    k = F.trim(key)
    shifted = F.element_at(F.create_map(*[F.lit(x) for pair in SHIFTED.items() for x in pair]), k)
    shift = F.exists(F.coalesce(modifiers, F.array().cast("array<string>")), lambda m: F.lower(m) == "shift")
    letter = k.rlike(r"^\p{L}$")
    return (
        F.when(k == "Key.space", " ").when(k == "Key.tab", "\t").when(k.isin("Key.enter", "Key.return"), "\n").when(k == "Key.backspace", BACKSPACE)
        .when(F.char_length(k) != 1, F.lit(None)).when(shift & letter, F.upper(k)).when(shift & shifted.isNotNull(), shifted)
        .when(letter, F.lower(k)).otherwise(k)
    )


def held_modifiers(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``modifiers`` at each key-down: modifiers whose last event before it was a down."""
    w = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    low = F.lower("key")
    held = []
    for name in MODIFIERS:
        mine = low.contains(name) if name != "win" else low.contains("win") | low.contains("super")
        last = F.last(F.when(mine, F.col("event_type")), ignorenulls=True).over(w)
        held.append(F.when(last == "down", F.lit(name)))
    return events.withColumn("modifiers", F.array_compact(F.array(*held)))


def _taken_back(tokens: pd.Series) -> pd.Series:
    """Text of tokens in order, where a backspace takes back one character; null for null."""
    out = []
    for some in tokens:
        now: list[str] = []
        for t in () if some is None else some:
            if t == BACKSPACE:
                del now[-1:]
            elif t is not None:
                now.append(t)
        out.append(None if some is None else "".join(now))
    return pd.Series(out, dtype="object")


def _typed(tokens: Column) -> Column:
    """Text of tokens in order; only those with a backspace are folded."""
    folded = F.pandas_udf(_taken_back, "string")(F.when(F.array_contains(tokens, BACKSPACE), tokens))
    return F.coalesce(folded, F.array_join(tokens, ""))


def reconstruct(events: DataFrame, keys: Sequence[str] = (), gap_s: float = GAP_S) -> DataFrame:
    """Text segments (start_ts, end_ts, process_name, window_title, text, hotkeys, raw_key_count) of each of ``keys``.

    A segment ends at another process, title or window, after more than ``gap_s`` without a key, and before a hotkey,
    which is a segment of its own. Keys that type nothing prolong it; segments left without text are dropped.
    """
    keys = list(keys)
    ship(events.sparkSession)
    typed = events.where((F.col("event_type") == "down") & ~is_modifier(F.col("key"))).withColumn("_hot", is_hotkey(F.col("key"), F.col("modifiers")))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ts", "id")
    context = F.struct("process_name", "window_title", "hwnd")
    starts = (
        F.col("_hot") | F.lag("_hot", 1, True).over(w) | ~context.eqNullSafe(F.lag(context).over(w)) | (F.col("ts") - F.lag("ts").over(w) > gap_s)
    )
    numbered = typed.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("segment", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    token = F.struct("ts", "id", token_of(F.col("key"), F.col("modifiers")).alias("t"))
    out = numbered.groupBy(*keys, "segment").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.first("process_name").alias("process_name"), F.first("window_title").alias("window_title"),
        F.bool_or("_hot").alias("_hot"), F.array_sort(F.collect_list(token)).alias("_tokens"), F.first(format_hotkey(F.col("key"), F.col("modifiers"))).alias("_name"),
        F.count("*").cast("int").alias("raw_key_count"),
    )
    out = out.withColumn("_tokens", F.transform("_tokens", lambda x: x["t"]))
    out = out.withColumn("text", F.when(F.col("_hot"), "").otherwise(_typed(F.col("_tokens"))))
    out = out.withColumn("hotkeys", F.when(F.col("_hot"), F.array("_name")).otherwise(F.array().cast("array<string>")))
    return out.where(F.col("_hot") | (F.col("text") != "")).drop("_tokens", "_hot", "_name")
