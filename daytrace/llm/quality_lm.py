"""Quality classifier: an interpolated modified Kneser-Ney model of code points, trained on trusted text.

An n-gram of ORDER code points is one 64-bit number, so every count, sum and join of the model is by exact number, and
sharded by it: shorter n-grams and contexts are its low and high bits. To score documents, the most frequent n-grams of
the trusted text (a bounded number) go to every task; the n-grams of a document that are not among them are joined with
the counts by shards. Thresholds are quantiles, per language, over trusted documents held out of training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked, join_counted

#: Code points of an n-gram, 16 bits each; the class of text boundaries.
ORDER, EDGE = 4, 0xFFFF
#: Share of held-out trusted documents of a language that pass; one trusted text in HOLD_OUT is held out.
QUANTILE, HOLD_OUT = 0.99, 5
#: N-grams of the trusted text that every task gets, at most: 16 bytes each.
HEAD = 500_000
_FEW, _FLUSH = 32, 2_000_000


def grams(text: str | None) -> np.ndarray:
    """Numbers of a text's n-grams, edges before and after it; none for an empty text.

    Code points of the basic plane are classes of their own, others share the 2,048 numbers of the surrogates.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = np.where(codes > 0xFFFF, 0xD800 | (codes & 0x7FF), codes).astype(np.uint64)
    edge = np.full(ORDER - 1, EDGE, dtype=np.uint64)
    c = np.concatenate((edge, codes, edge[:1]))
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | c[k : k + len(out)]
    return out.view(np.int64)


def _counts(texts: DataFrame) -> DataFrame:
    """(gram, c) over all of ``_text``; tasks sum before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch._text:
                some.append(grams(text))
                size += len(some[-1])
                if size > _FLUSH:
                    yield summed(some)
                    some, size = [], 0
        yield summed(some)

    def summed(some: list[np.ndarray]) -> pd.DataFrame:
        gram, c = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *some]), return_counts=True)
        return pd.DataFrame({"gram": gram, "c": c})

    return texts.mapInPandas(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _suffix(k: int) -> Column:
    """The n-gram without its first code point, of one of k."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))


def _context(k: int) -> Column:
    """The n-gram without its last code point."""
    return F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from the numbers of n-grams seen once to four times.

    They are 0.1 at least, so that little text leaves some weight to what it has not.
    """
    n = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) if n[k - 1] else k * y for k in (1, 2, 3))


class Model:
    """The levels of the model: of each order, (gram, top) discounted shares and (ctx, gamma) weights left to the next."""

    def __init__(self, trusted: DataFrame, scratch: Scratch):
        self.scratch = scratch
        counts = self.counts = scratch.write(_counts(trusted.select("_text")))
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        for k in range(ORDER, 0, -1):
            d = _discounts(counts)
            off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            one = counts.withColumn("ctx", _context(k))
            sums = scratch.write(one.groupBy("ctx").agg(F.sum("c").alias("all"), F.sum(off).alias("off")))
            share = (F.greatest(F.lit(0.0), F.col("c") - off) / F.col("all")).alias("top")
            self.levels.insert(0, (scratch.write(one.join(sums, "ctx").select("gram", share)), sums.select("ctx", (F.col("off") / F.col("all")).alias("gamma"))))
            if k > 1:  # a shorter n-gram counts the code points that it follows
                counts = scratch.write(counts.groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("c")))

    def nats(self, asked: DataFrame) -> DataFrame:
        """(gram, nats): minus log probability of the last code point of each n-gram of ``asked`` (distinct, in gram)."""
        wanted = [self.scratch.write(asked.select("gram"))]
        for k in range(ORDER, 1, -1):
            wanted.insert(0, self.scratch.write(wanted[0].select(_suffix(k).alias("gram")).distinct()))
        below = None
        for k, (want, (tops, gammas)) in enumerate(zip(wanted, self.levels, strict=True), start=1):
            rows = want.withColumns({"ctx": _context(k), "low": _suffix(k)}).join(tops, "gram", "left").join(gammas, "ctx", "left")
            p = F.lit(1 / 65536) if below is None else F.col("p_low")
            if below is not None:
                rows = rows.join(below.select(F.col("gram").alias("low"), F.col("p").alias("p_low")), "low")
            below = self.scratch.write(rows.select("gram", (F.coalesce("top", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * p).alias("p")))
        return below.select("gram", (-F.log(F.greatest("p", F.lit(1e-30)))).alias("nats"))

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, sorted, and nats of the most frequent n-grams: HEAD of them at most reach the driver."""
        level = F.floor(F.log2("c") * 4)
        least, total = 1 << 62, 0
        for r in self.counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
            total += r.n
            if total > HEAD:
                break
            least = r.level
        rows = self.nats(self.counts.where(level >= least)).toArrow()
        numbers, nats = (rows.column(c).to_numpy() for c in ("gram", "nats"))
        order = numbers.argsort()
        return numbers[order], nats[order]


def perplexities(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` with n_grams and perplexity (null without characters) of ``_text``; one row per row."""
    kinds, scratch = dict(docs.dtypes), model.scratch
    known = docs.sparkSession.sparkContext.broadcast(model.head())

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, nats = known.value
        for batch in batches:
            for at in range(0, len(batch), _FEW):
                part = batch.iloc[at : at + _FEW]
                each = [grams(t) for t in part._text]
                distinct, spot = np.unique(np.concatenate(each), return_inverse=True)
                where = np.minimum(np.searchsorted(numbers, distinct), max(0, len(numbers) - 1))
                found = numbers[where] == distinct if len(numbers) else np.zeros(len(distinct), dtype=bool)
                value = np.where(found, nats[where], 0.0) if len(numbers) else np.zeros(len(distinct))
                sums, rest, times, start = [], [], [], 0
                for g in each:
                    own = spot[start : start + len(g)]
                    start += len(g)
                    sums.append(float(value[own].sum()))
                    left, n = np.unique(own[~found[own]], return_counts=True)
                    rest.append(distinct[left]), times.append(n.astype(np.int32))
                yield part[keep].assign(n_grams=[len(g) for g in each], nats=sums, rest=rest, times=times)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_grams long, nats double, rest array<long>, times array<int>"])
    # written once, so that the numbers of rows are fixed and repeated rows stay apart
    one = scratch.write(docs.select(*keep, "_text").mapInPandas(look_up, schema).withColumn("_row", F.monotonically_increasing_id()))
    rest = one.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("g")).select("_row", F.col("g.rest").alias("gram"), F.col("g.times").alias("n"))
    asked = scratch.write(rest.groupBy("gram").agg(F.count("*").alias("c")))
    scored = join_counted(rest, model.nats(asked).join(asked, "gram"), ["gram"], scratch).groupBy("_row").agg(F.sum(F.col("n") * F.col("nats")).alias("more"))
    total = (F.col("nats") + F.coalesce("more", F.lit(0.0))) / F.col("n_grams")
    return one.drop("rest", "times").join(scored, "_row", "left").select(*keep, "n_grams", F.when(F.col("n_grams") > 0, F.exp(total)).alias("perplexity"))


def _thresholds(held: DataFrame, quantile: float) -> DataFrame:
    """(_lang, limit) for each language and, under null, for all: the quantile's bin of 1/500 of the log perplexity."""
    bins = held.where("perplexity is not null").select("_lang", F.ceil(F.log("perplexity") * 500).alias("bin"))
    # the pooled limit: under a null language, as for documents without one
    bins = bins.where("_lang is not null").union(bins.select(F.lit(None).cast("string"), "bin")).groupBy("_lang", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("_lang")
    at = bins.withColumn("cum", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    return at.where(F.col("cum") >= quantile * F.col("all")).groupBy("_lang").agg(F.exp((F.min("bin")) / 500).alias("limit"))


def classify(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: id, lang, n_grams, perplexity, threshold, kept.

    ``trusted_ids`` has the ids (column ``doc_id``) of trusted documents. One of HOLD_OUT of their texts, by hash, is held
    out of training, and kept means a perplexity of at most the ``quantile`` of the held-out ones of the language; of all
    held-out ones where the language is null or has none. Where either part is empty, all trusted texts are trained on
    and held out. Texts that are null or empty have null perplexity and are not kept; without trusted text nothing is
    judged and all is kept. Equal texts of a language get equal verdicts; an empty table gives no rows. Only id, text and
    language are read.
    """
    scratch = Scratch(docs.sparkSession, "quality-lm")
    out_of = F.pmod(F.xxhash64(docs[text]), F.lit(HOLD_OUT)) == 0
    rows = docs.select(docs[doc_id].alias(doc_id), docs[lang].alias("_lang"), out_of.alias("_held"), docs[text].alias("_text"))
    ids = scratch.write(trusted_ids.select(F.col(doc_id).alias("_trusted")).where("_trusted is not null").distinct())
    n = ids.count()
    trusted = lambda df: join_checked(df, ids, F.col(doc_id) == F.col("_trusted"), "left_semi", n)
    read = trusted(rows).where("_text <> ''")
    held, trained = read.agg(F.count_if("_held"), F.count_if(~F.col("_held"))).first()
    split = bool(held and trained)
    scored = scratch.write(perplexities(rows, Model(read.where("not _held") if split else read, scratch), [doc_id, "_lang", "_held"]))
    judged = trusted(scored)
    limits = scratch.write(_thresholds(judged.where("_held") if split else judged, quantile))
    pooled = limits.where("_lang is null").select("limit").first()
    limits = limits.where("_lang is not null").withColumnRenamed("_lang", "_l")
    out = join_checked(scored, limits, F.col("_lang") == F.col("_l"), "left").withColumn("threshold", F.coalesce("limit", F.lit(pooled[0] if pooled else math.inf)))
    return out.select(doc_id, F.col("_lang").alias(lang), "n_grams", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(pooled is None)).alias("kept"))
