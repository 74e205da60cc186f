"""Quality rules: counts of a whole text, and robust multivariate outliers among them per language and source.

Built-in functions alone. The minimum-covariance-determinant estimate of a group has several starts: medians with median
deviations, spatial signs, bounded scores, and mean with covariance. All take two concentration steps (distances of all
rows, the nearest share of them, their mean and covariance); the one of least determinant goes on until its determinant
no longer falls. A step is one pass that sums counts, statistics and products by (group, start, distance bin); which
bins make up the nearest share is then read off these sums, so no group is ever gathered and no quantile sketch is
needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked, let, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A statistic's smallest standard deviation: most groups have no symbols, equal lines or repeats at all.
FLOORS = [0.25, 0.06, 0.06, 0.10, 0.08]
D = len(FLOORS)
_X = [f"_x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Steps that all starts take; bins of squared distances per octave; fall of the log determinant that counts as one.
FIRST_STEPS, BINS, FALL = 2, 32, 1e-3
#: Added to the variances of starts that measure in median deviations.
_RIDGE = 0.01


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a whole text; zeros for null."""
    t = F.coalesce(text, F.lit(""))

    def covered(windows: Column) -> Column:
        """Words in windows that are found twice or more, from all windows' hashes in order."""
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
            spots = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(spots, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")))["n"]

        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(let(placed, of))

    def repeats(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        return F.when(F.size(w) < 6, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), covered)))

    dense = F.translate(t, " \t\n\x0b\f\r", "")
    by_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeats(w).cast("long").alias("n_repeat_words")))
    by_chars = let(dense, lambda x: F.struct(F.char_length(x).cast("long").alias("word_chars"), (F.char_length(x) - F.char_length(F.translate(x, SYMBOLS, ""))).cast("long").alias("n_symbols")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(by_words.alias("w"), by_chars.alias("c"), dup.alias("n_dup_lines"))


def counted(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` with the five counts and base_failed (under 10 words, or over 20% of them in repeated windows)."""
    raw = docs.select(*keep, text_counts(text).alias("_c"))
    flat = raw.select(*[c for c in raw.columns if c != "_c"], *[F.col(p).alias(p.split(".")[-1]) for p in ("_c.w.n_words", "_c.c.word_chars", "_c.c.n_symbols", "_c.n_dup_lines", "_c.w.n_repeat_words")])
    return flat.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _statistics() -> list[Column]:
    """Transformed statistics: log length, log mean word length, roots of the shares of symbols, equal lines, repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.least(F.lit(1.0), 10 * F.col("n_dup_lines") / n)), F.sqrt(F.col("n_repeat_words") / n),
    ]


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_cdf(x: float, d: int) -> float:
    return _gamma_p(d / 2, x / 2)


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 1e-9, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


def _factored(cov: dict[tuple[int, int], Column], df: DataFrame, keep: list[str]) -> DataFrame:
    """Add the Cholesky factor _l{i}{j} of a covariance given by columns."""
    for (i, j), c in cov.items():
        df = df.withColumn(f"_l{i}{j}", c)
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"_l{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            df = df.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"_l{j}{j}"))
    return df.select(*keep, *[f"_l{i}{j}" for i, j in _PAIRS])


def _distance2() -> Column:
    """Squared Mahalanobis distance of _x to _m under the factor _l (forward substitution)."""
    z: list[Column] = []
    for i in range(D):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * z[j]
        z.append(rest / F.col(f"_l{i}{i}"))
    out = z[0] * z[0]
    for c in z[1:]:
        out = out + c * c
    return out


def _group_rows(rows: DataFrame, scratch: Scratch, min_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Groups by (_lang, _source), rows by _group, _n by _group, and the number of (_lang, _source)."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("_low", F.col("n") < min_rows).withColumn("_lang_n", F.sum(F.when(F.col("_low"), F.col("n")).otherwise(0)).over(Window.partitionBy("_lang")))
    group = F.when(~F.col("_low"), F.concat_ws("\x1f", F.lit("s"), "_lang", "_source")).when(F.col("_lang_n") >= min_rows, F.concat_ws("\x1f", F.lit("l"), "_lang")).otherwise("rest")
    groups = scratch.write(sizes.select("_lang", "_source", group.alias("_group"), "n"))
    n_groups = groups.count()
    mine = join_checked(rows.select("_lang", "_source", *_X), groups.select("_lang", "_source", "_group"), ["_lang", "_source"], "inner", n_groups).select("_group", *_X)
    totals = groups.groupBy("_group").agg(F.sum("n").alias("_n"))
    if not totals.where((F.col("_group") == "rest") & (F.col("_n") < min_rows)).isEmpty():
        mine = mine.where("_group <> 'rest'").unionByName(rows.select(F.lit("rest").alias("_group"), *_X))
        totals = totals.where("_group <> 'rest'").unionByName(groups.select(F.lit("rest").alias("_group"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("_n")).distinct())
    return groups.drop("n"), mine, scratch.write(totals), n_groups


def _middles(mine: DataFrame, scratch: Scratch) -> DataFrame:
    """(_group, _c*, _s*): medians and scaled median deviations with their floors, over bins of 1/64."""
    bins = mine.select("_group", F.posexplode(F.array(*[F.floor(F.col(x) * 64) for x in _X])).alias("_dim", "_bin")).groupBy("_group", "_dim", "_bin").agg(F.count("*").alias("c"))

    def middle(df: DataFrame, value: str) -> DataFrame:
        w = Window.partitionBy("_group", "_dim").orderBy(value)
        at = df.withColumn("_cum", F.sum("c").over(w)).withColumn("_all", F.sum("c").over(Window.partitionBy("_group", "_dim")))
        return at.where(2 * F.col("_cum") >= F.col("_all")).groupBy("_group", "_dim").agg(F.min(value).alias("mid"))

    bins = scratch.write(bins)
    med = middle(bins, "_bin")
    away = bins.join(med, ["_group", "_dim"]).withColumn("_off", F.abs(F.col("_bin") - F.col("mid")))
    mad = middle(away, "_off").select("_group", "_dim", F.col("mid").alias("dev"))
    return scratch.write(med.join(mad, ["_group", "_dim"]).groupBy("_group").agg(
        *[F.max(F.when(F.col("_dim") == i, (F.col("mid") + 0.5) / 64)).alias(f"_c{i}") for i in range(D)],
        *[F.sqrt(F.max(F.when(F.col("_dim") == i, F.pow(F.col("dev") * 1.4826 / 64, 2))) + FLOORS[i] ** 2).alias(f"_s{i}") for i in range(D)],
    ))


def _starts(mine: DataFrame, middles: DataFrame, n_groups: int, scratch: Scratch) -> DataFrame:
    """(_group, _start, _m*, _l*): the four starts of every group, from one pass."""
    z = [(F.col(_X[i]) - F.col(f"_c{i}")) / F.col(f"_s{i}") for i in range(D)]
    at = join_checked(mine, middles, "_group", "inner", n_groups).select("_group", *_X, *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    at = at.withColumn("_r", F.greatest(F.lit(1e-9), F.sqrt(sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(D)), F.lit(0.0)))))
    kinds = {"x": [F.col(x) for x in _X], "u": [F.col(f"_z{i}") / F.col("_r") for i in range(D)], "v": [F.tanh(f"_z{i}") for i in range(D)]}
    sums = at.groupBy("_group").agg(
        *[F.avg(c[i]).alias(f"_{k}{i}") for k, c in kinds.items() for i in range(D)], *[F.avg(c[i] * c[j]).alias(f"_{k}{i}{j}") for k, c in kinds.items() for i, j in _PAIRS])
    one = scratch.write(sums.join(middles, "_group"))
    spread = lambda k, i, j: F.col(f"_{k}{i}{j}") - (F.col(f"_{k}{i}") * F.col(f"_{k}{j}") if k != "u" else 0.0)
    scaled = lambda i, j, c: F.col(f"_s{i}") * F.col(f"_s{j}") * (c + (_RIDGE if i == j else 0.0))
    shapes = [
        ("_c", {(i, j): scaled(i, j, F.lit(float(i == j))) for i, j in _PAIRS}),
        ("_c", {(i, j): scaled(i, j, spread("u", i, j)) for i, j in _PAIRS}),
        ("_c", {(i, j): scaled(i, j, spread("v", i, j)) for i, j in _PAIRS}),
        ("_x", {(i, j): spread("x", i, j) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}),
    ]
    made = []
    for start, (center, cov) in enumerate(shapes):
        centered = one.withColumns({f"_m{i}": F.col(f"{center}{i}") for i in range(D)}).withColumn("_start", F.lit(start))
        made.append(_factored(cov, centered, ["_group", "_start", *[f"_m{i}" for i in range(D)]]))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return scratch.write(out)


def _concentrated(mine: DataFrame, params: DataFrame, sizes: DataFrame, share: float, rows: int, scratch: Scratch) -> DataFrame:
    """A concentration step: mean, factor and _logdet of the nearest ``share`` of each (_group, _start)."""
    key = ["_group", "_start"]
    consistent = share / chi2_cdf(chi2_quantile(share, D), D + 2)
    at = join_checked(mine, params, "_group", "inner", rows).withColumn("_bin", F.floor(F.log2(_distance2() + 1e-9) * BINS))
    sums = at.groupBy(*key, "_bin").agg(F.count("*").alias("c"), *[F.sum(x).alias(f"_t{x}") for x in _X], *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"_p{i}{j}") for i, j in _PAIRS])
    sums = sums.join(sizes, "_group").withColumn("_before", F.sum("c").over(Window.partitionBy(*key).orderBy("_bin")) - F.col("c"))
    near = sums.where(F.col("_before") < F.ceil(F.col("_n") * share)).groupBy(*key).agg(
        F.sum("c").alias("h"), *[F.sum(f"_t{x}").alias(f"_t{x}") for x in _X], *[F.sum(f"_p{i}{j}").alias(f"_p{i}{j}") for i, j in _PAIRS])
    near = near.withColumns({f"_m{i}": F.col(f"_t_x{i}") / F.col("h") for i in range(D)})
    cov = {(i, j): (F.col(f"_p{i}{j}") / F.col("h") - F.col(f"_m{i}") * F.col(f"_m{j}")) * consistent + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    made = _factored(cov, near, [*key, *[f"_m{i}" for i in range(D)]])
    return scratch.write(made.withColumn("_logdet", sum((2 * F.log(f"_l{i}{i}") for i in range(D)), F.lit(0.0))))


def estimates(rows: DataFrame, scratch: Scratch, share: float = 0.75, min_rows: int = 60) -> DataFrame:
    """(_lang, _source, _group, _m*, _l*) for each (_lang, _source) of ``rows`` (with _x*).

    A language and source with under ``min_rows`` rows is estimated with the other small ones of its language, or, if
    these are still too few, with the small rest of all languages; if that is too little as well, on all rows.
    """
    groups, mine, sizes, n_groups = _group_rows(rows, scratch, min_rows)
    starts = _starts(mine, _middles(mine, scratch), n_groups, scratch)
    for _ in range(FIRST_STEPS):
        starts = _concentrated(mine, starts, sizes, share, 4 * n_groups, scratch)
    cols = starts.columns
    now = scratch.write(starts.groupBy("_group").agg(F.min_by(F.struct(*cols), F.struct("_logdet", "_start")).alias("b")).select("b.*"))
    while True:
        after = _concentrated(mine, now, sizes, share, n_groups, scratch)
        fell = after.join(now.select("_group", F.col("_logdet").alias("_was")), "_group").where(F.col("_logdet") < F.col("_was") - FALL)
        if fell.isEmpty():
            break
        now = scratch.write(now.unionByName(after).groupBy("_group").agg(F.min_by(F.struct(*cols), "_logdet").alias("b")).select("b.*"))
    return scratch.write(groups.join(now.drop("_start", "_logdet"), "_group"))


def _placed(df: DataFrame, lang: Column, source: Column) -> DataFrame:
    return df.withColumns({"_lang": _key(lang), "_source": _key(source)}).withColumns(dict(zip(_X, _statistics(), strict=True)))


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", confidence: float = 0.99999) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept, and the squared distance (null where base_failed).

    kept is false where base_failed, else where the squared distance exceeds the chi-square quantile of ``confidence``.
    Languages and sources of under 60 rows are judged by a pooled estimate. Null and empty texts count zero and fail the
    base; null language and source are values of their own; equal rows get equal verdicts; rows without an id are judged
    like others; an empty table gives no rows. Only id, text, language and source are read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    base = docs.select(docs[doc_id].alias(doc_id), docs[text].alias("_text"), docs[lang].alias("_l"), docs[source].alias("_s"))
    rows = scratch.write(_placed(counted(base, [F.col(doc_id), F.col("_l"), F.col("_s")], F.col("_text")), F.col("_l"), F.col("_s")).drop("_l", "_s"))
    params = estimates(rows.where("not base_failed"), scratch)
    cutoff = chi2_quantile(confidence, D)
    out = join_checked(rows, params, ["_lang", "_source"], "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance2()))
    return out.select(doc_id, *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).alias("kept"), "distance2")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", confidence: float = 0.99999) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with their own columns.

    Texts are neither shuffled nor written aside: their counts are taken once for the estimates and once for the verdict.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    base = docs.select(docs[text].alias("_text"), docs[lang].alias("_l"), docs[source].alias("_s"))
    rows = counted(base, [F.col("_l"), F.col("_s")], F.col("_text")).where("not base_failed")
    rows = scratch.write(_placed(rows, F.col("_l"), F.col("_s")).select("_lang", "_source", *_X))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    again = _placed(counted(whole, [F.col("_doc")], F.col("_doc")[text]).where("not base_failed"), F.col("_doc")[lang], F.col("_doc")[source])
    judged = join_checked(again, estimates(rows, scratch), ["_lang", "_source"], "left").where(_distance2() <= chi2_quantile(confidence, D))
    return judged.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
