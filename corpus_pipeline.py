"""A pipeline over documents: quality rules, line dedup, near-dedup, mixing, packing; each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daytrace.llm import line_templates, minhash, mixing, packing, quality_rules
from daytrace.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts, and those of under ten words, go; null language and source are values of their own; equal rows
    stay or go together; rows without an id are judged like others.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of them, without lines of recurring templates.

    No row goes; a document of which all lines recur may be left without words. Of equal rows none is the other's first
    occurrence, so both lose the same lines.
    """
    return line_templates.drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Rows without an id and texts without words stay; repeated rows of the id that is kept all stay.
    """
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by training position.

    Null source is a source, the last; equal rows are each placed; rows at one position follow their ids, then a hash.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of the documents in training sequences.

    Texts without words take no room (null bin); equal rows are told apart by their copy number; equal texts never share
    a sequence; a text longer than a sequence is cut. Columns other than id, text and source are not in the result.
    """
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Robust estimates and best-fit packing cannot be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
