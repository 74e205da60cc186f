"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral is the
source's share of the words; the integral's inverse turns a document's place in the source's cumulative word demand
into a training position, and rows are range-sorted by position. Within a source documents follow the md5 of their id.
Places come from two levels of sums (per source and digest bucket, then within a bucket), so no source is one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked, words_of

#: Weights by the rank of a source, repeating, and how each one's weight moves over time (relative, at KNOTS).
WEIGHTS = (5.0, 2.0, 1.0)
KNOTS = (0.0, 0.5, 1.0)
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
ROWS_PER_BUCKET = 500


def targets(sizes: DataFrame, weights: Sequence[float], shapes: Sequence[Sequence[float]], share: float, most: float) -> DataFrame:
    """Add target and shape to (_src, source_size): ``share`` of all words by weight, none above ``most`` times its size.

    Sources are ranked by code point, null last. What the capped sources cannot take is shared by weight among the
    rest until none is above: sorted by size over weight, the capped ones come first, so running sums settle it.
    The table has a row per source, as many as there are weight schedules to follow.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("_src").isNull(), "_src")) - 1
    pick = lambda values: F.get(F.array(*values), F.col("_rank") % len(values))
    one = sizes.withColumn("_rank", rank).withColumn("_w", pick([F.lit(float(w)) for w in weights])).withColumn("_shape", pick([F.array(*[F.lit(float(x)) for x in s]) for s in shapes]))
    one = one.withColumn("_cap", most * F.col("source_size"))
    first = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("_rest", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    one = one.withColumn("_rest_w", F.sum("_w").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("_at", F.row_number().over(first))
    one = one.withColumn("_level", F.col("_rest") / F.col("_rest_w")).withColumn("_free", F.col("_cap") > F.col("_level") * F.col("_w"))
    level = F.min(F.when(F.col("_free"), F.struct("_at", "_level"))).over(everything)
    return one.withColumn("_from", level).select(
        "_src", "source_size", F.when(F.col("_at") >= F.col("_from._at"), F.col("_from._level") * F.col("_w")).otherwise(F.col("_cap")).alias("target"), "_shape"
    )


def position_of(place: Column, shape: Column, knots: Sequence[float] = KNOTS) -> Column:
    """Time at which a schedule has used up the share ``place`` (0..1) of its integral."""
    area = F.lit(0.0)
    areas = [area]
    for k in range(1, len(knots)):
        area = area + (knots[k] - knots[k - 1]) * (F.get(shape, F.lit(k - 1)) + F.get(shape, F.lit(k))) / 2
        areas.append(area)
    wanted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), place)) * area
    out = F.lit(1.0)
    for k in range(len(knots) - 1, 0, -1):
        a, b, width = F.get(shape, F.lit(k - 1)), F.get(shape, F.lit(k)), knots[k] - knots[k - 1]
        over, slope = wanted - areas[k - 1], (b - a) / width
        into = 2 * over / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * over)))
        out = F.when(wanted <= areas[k], F.lit(knots[k - 1]) + F.when(over <= 0, F.lit(0.0)).otherwise(into)).otherwise(out)
    return out


class Mix:
    """The plan of one mix; ``decide`` gives each row its copies and their positions."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, source: str, weights=WEIGHTS, shapes=SHAPES, share: float = 1.5, most: float = 2.0):
        self.scratch = scratch = Scratch(docs.sparkSession, "mix")
        self.doc_id, self.text, self.source = doc_id, text, source
        lite = scratch.write(self._keyed(docs, [], []))
        self.digits = max(1, min(6, math.ceil(math.log(max(1, lite.count()) / ROWS_PER_BUCKET, 16))))
        lite = lite.withColumn("_bucket", F.substring("_h", 1, self.digits))
        buckets = lite.groupBy("_key", "_bucket").agg(F.sum("_size").alias("n"))
        w = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.offsets = scratch.write(buckets.select("_key", "_bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_offset")))
        sizes = lite.groupBy("_src").agg(F.sum("_size").alias("source_size"))
        self.plan = scratch.write(targets(sizes, weights, shapes, share, most).withColumn("_fill", F.lit(None).cast("struct<_h:string,_row:int>")))
        self.sources = self.plan.count()
        # what whole documents leave of a target goes to the one further document whose size is nearest to it
        placed = self._copies(self._placed(lite))
        left = placed.groupBy("_src").agg((F.first("target") - F.sum(F.col("_size") * F.size("_places"))).alias("_left"))
        rest = join_checked(placed, left.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")), "inner", self.sources)
        rest = rest.where("size(_places) < greatest(1, ceil(target / greatest(1, source_size)))").withColumn("_off", F.abs(F.col("_size") - F.col("_left"))).where("_off < _left")
        best = rest.groupBy("_src").agg(F.min_by(F.struct("_h", "_row"), F.struct("_off", "_h", "_row")).alias("_fill")).withColumnRenamed("_src", "_s")
        self.plan = scratch.write(self.plan.drop("_fill").join(best, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s"))

    def _keyed(self, docs: DataFrame, keep: list[Column], ties: list[str]) -> DataFrame:
        src = docs[self.source].cast("string")
        return docs.select(
            *keep, src.alias("_src"), F.coalesce(F.concat(F.lit("="), src), F.lit("null")).alias("_key"), (F.xxhash64(*[docs[c] for c in ties]) if ties else F.lit(0)).alias("_all"), F.md5(F.coalesce(docs[self.doc_id].cast("string"), F.lit("null"))).alias("_h"),
            F.xxhash64(docs[self.text]).alias("_tie"), F.size(words_of(docs[self.text])).cast("long").alias("_size"),
        )

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Add _row and _before (words of the source before this row), source_size, target, _shape, _fill."""
        # the join has the window's keys, so that rows are dealt once
        w = Window.partitionBy("_key", "_bucket").orderBy("_h", "_tie", "_size", "_all")
        own = rows.withColumn("_row", F.row_number().over(w)).withColumn("_cum", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        both = join_checked(own, self.offsets, ["_key", "_bucket"], "inner")
        both = both.withColumn("_before", F.col("_cum") + F.col("_offset")).drop("_cum", "_offset")
        return join_checked(both, self.plan.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")), "inner", self.sources).drop("_s")

    @staticmethod
    def _copies(placed: DataFrame) -> DataFrame:
        """Add _places: for each copy, the middle of its words in the source's demand. A pass takes whole documents while they fit."""
        fits = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.when(k * F.col("source_size") + F.col("_before") + F.col("_size") <= F.col("target"), k * F.col("source_size") + F.col("_before") + F.col("_size") / 2))
        extra = F.when((F.col("_fill._h") == F.col("_h")) & (F.col("_fill._row") == F.col("_row")), F.col("target") - F.col("_size") / 2)
        return placed.withColumn("_places", F.array_compact(F.concat(fits, F.array(extra))))

    def decide(self, docs: DataFrame, keep: list[Column], ties: list[str]) -> DataFrame:
        """``keep`` with _src, _size, source_size, target, _all and _positions (one per copy that the mix takes).

        Rows of one id, text and source are told apart by the columns ``ties``.
        """
        rows = self._keyed(docs, keep, ties).withColumn("_bucket", F.substring("_h", 1, self.digits))
        at = F.transform("_places", lambda p: position_of(p / F.greatest(F.col("target"), F.lit(1.0)), F.col("_shape")))
        return self._copies(self._placed(rows)).withColumn("_positions", at).drop("_h", "_tie", "_key", "_bucket", "_row", "_before", "_places", "_fill", "_shape")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words, repeats counted), positions.

    Null and empty texts have size 0; null source is a source, the last; equal ids or rows are each placed; a source of
    size 0 has target 0; an empty table gives no rows. Only id, text and source are read.
    """
    out = Mix(docs, doc_id, text, source, **how).decide(docs, [docs[doc_id].alias(doc_id)], [])
    return out.select(doc_id, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("_positions")).alias("taken"), F.col("_positions").alias("positions"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, sorted by training position, then id, then a hash of the row.

    Rows that differ in nothing but maps and variants may swap between runs. Texts without words take no room
    and come as often as a pass does.
    """
    ties = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    out = Mix(docs, doc_id, text, source, **how).decide(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("_doc")], ties)
    return out.select("_doc", "_all", F.explode("_positions").alias("_at")).orderBy("_at", F.col("_doc")[doc_id], "_all").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
