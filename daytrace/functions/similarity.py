"""Similarity of titles, texts and contexts. The sequence ratio has no built-in form: an Arrow UDF over distinct pairs."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.functions.text import jaccard, normalize_title
from daytrace.session import ship


#: From so many characters on, those that make over a hundredth of the second text start no match (fixed values).
LONG_TEXT, POPULAR_SHARE = 200, 100


def ratio(a: str, b: str) -> float:
    """twice the characters in matching blocks over all characters; 1 for two empty texts, 0 for one.

    The longest common run (the first of equal ones) is a block, and so are those of what is left and right of it.
    Very frequent characters of a long second text only prolong runs.
    """
    if not a or not b:
        return float(not a and not b)
    if a == b:
        return 1.0
    starts = matches = None
    if len(b) >= LONG_TEXT:
        places: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            places.setdefault(c, []).append(j)
        places = {c: at for c, at in places.items() if len(at) <= len(b) // POPULAR_SHARE + 1}
        # only characters that start a match are gone through
        starts = [i for i, c in enumerate(a) if c in places]
        matches = [places[a[i]] for i in starts]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = _longest_text(a, b, a0, a1, b0, b1) if starts is None else _longest_run(a, b, starts, matches, a0, a1, b0, b1)
        if n:
            total += n
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return 2.0 * total / (len(a) + len(b))


def _longest_text(a: str, b: str, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """Start in either text and length of the longest common run within the given ranges, where any character starts a match."""
    if b1 - b0 < a1 - a0:  # the shorter range is gone through, the other one searched
        part = a[a0:a1]
        _, best = _longest_in(b, b0, b1, part)
        runs = ((part.find(b[j : j + best]), j) for j in range(b0, b1 - best + 1)) if best else ()
        i, j = min((r for r in runs if r[0] >= 0), default=(0, b0))
        return a0 + i, j, best
    part = b[b0:b1]
    i, best = _longest_in(a, a0, a1, part)
    return i, b0 + part.find(a[i : i + best]), best


def _longest_in(text: str, start: int, end: int, other: str) -> tuple[int, int]:
    """Start and length of the first longest part of ``text`` within a range that is in ``other``."""
    at, best, i = start, 0, start
    while i + best < end:
        if text[i : i + best + 1] in other:
            at, best = i, best + 1
            while i + best < end and text[i : i + best + 1] in other:
                best += 1
        i += 1
    return at, best


def _longest_run(a: str, b: str, starts: list[int], matches: list[list[int]], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """Start in either text and length of the longest common run within the given ranges; ``matches`` has the places in b of each start in a."""
    best_i, best_j, best = a0, b0, 0
    last, ending = -2, {}  # the place before, and by a place of b the length of the run that ends there
    for k in range(bisect_left(starts, a0), bisect_left(starts, a1)):
        i, now = starts[k], {}
        if i != last + 1:
            ending = {}
        for j in matches[k]:
            if j >= b1:
                break
            if j >= b0:
                n = now[j] = ending.get(j - 1, 0) + 1
                if n > best:
                    best_i, best_j, best = i - n + 1, j - n + 1, n
        last, ending = i, now
    while best_i > a0 and best_j > b0 and a[best_i - 1] == b[best_j - 1]:
        best_i, best_j, best = best_i - 1, best_j - 1, best + 1
    while best_i + best < a1 and best_j + best < b1 and a[best_i + best] == b[best_j + best]:
        best += 1
    return best_i, best_j, best


#: F3 of titles and other short texts, of which few are different.
known_ratio = lru_cache(maxsize=10_000)(ratio)


def add_ratio(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """the ratio of two text columns, computed once per distinct pair and joined back; null counts as empty."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    pairs = df.select(x.alias("_x"), y.alias("_y")).distinct().withColumn(out, each("_x", "_y"))
    return df.withColumns({"_x": x, "_y": y}).join(pairs, ["_x", "_y"]).drop("_x", "_y")


def add_text_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """the larger of the ratio and the word Jaccard of two normalized texts."""
    norm = lambda c: normalize_title(F.coalesce(F.col(c), F.lit("")))
    both = add_ratio(df.withColumns({"_na": norm(a), "_nb": norm(b)}), "_na", "_nb", "_ratio")
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    return both.withColumn(out, F.greatest("_ratio", jaccard(words("_na"), words("_nb")))).drop("_na", "_nb", "_ratio")


def context_similarity(same_process: Column, title: Column, same_blocked: Column, same_closure: Column) -> Column:
    """the better of two mixes of process, title, blocked flag and closure reason."""
    p, b, c = (x.cast("double") for x in (same_process, same_blocked, same_closure))
    return F.greatest(p * 0.6 + title * 0.3 + b * 0.1, p * 0.5 + title * 0.4 + c * 0.1)
