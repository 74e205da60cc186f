"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its leading tokens, with tokens that hold a digit generalised. Inside a leaf, a
token that too few documents have at its place is a variable field. What is left, the template, recurs if enough
documents have it; all its occurrences but the first in the corpus are dropped. Counts and joins stand in for the
usual sequential insertion, so the result does not depend on the order of lines and no leaf is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked, join_counted

FIELD = "<*>"
#: Leading tokens of a leaf.
DEPTH = 2
#: Documents that make a template recur; tokens from which rare ones are fields, too; share of these lines' tokens that must be fixed.
MIN_DOCS, MIN_TOKENS, FIXED_SHARE = 10, 4, 0.6
_DIGIT = re.compile(r"[0-9]")


def tokens_of(line: str) -> list[str]:
    """Words of a line, those with a digit generalised."""
    return _generalised(_words(line))


def _words(line: str) -> list[str]:
    return [t.decode("utf-8", "surrogatepass") for t in line.encode("utf-8", "surrogatepass").split()]


def _generalised(words: list[str]) -> list[str]:
    return [FIELD if _DIGIT.search(t) else t for t in words]


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def _hashes(tokens: list[str]) -> tuple[int, int]:
    """Of the leaf and of the generalised line."""
    h = lambda parts: _signed(xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")))
    return h([str(len(tokens)), *tokens[:DEPTH]]), h(tokens)


def _lines(docs: DataFrame, kind: str, with_tokens: bool) -> DataFrame:
    """(_id, _hash, no, leaf, line[, tokens]) of the lines with a word.

    Tokens with a digit are generalised, but in a line that has no others: it stands for itself.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, text in zip(batch._id, batch._hash, batch._text, strict=True):
                for no, line in enumerate((text or "").split("\n")):
                    if line and (w := _words(line)):
                        g = _generalised(w)
                        t = g if any(x != FIELD for x in g) else w
                        out.append((i, h, no, *_hashes(t), t) if with_tokens else (i, h, no, *_hashes(t)))
                    if len(out) > 5000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    schema = f"_id {kind}, _hash int, no int, leaf long, line long" + ", tokens array<string>" * with_tokens
    names = ["_id", "_hash", "no", "leaf", "line"] + ["tokens"] * with_tokens
    return docs.mapInPandas(parse, schema)


def _in_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, docs): documents that have a key."""
    return rows.select(key, "_id", "_hash").distinct().groupBy(key).agg(F.count("*").alias("docs"))


def recurring_lines(docs: DataFrame, doc_id: str, text: str, min_docs: int, scratch: Scratch) -> DataFrame:
    """(_id, _hash, spots, templates): numbers (from 0) of the lines to drop from a document, and their templates."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("_id"), F.hash(docs[text]).alias("_hash"), docs[text].alias("_text"))
    lines = scratch.write(_lines(rows, kind, False))
    counts = lines.groupBy("leaf").agg(F.count("*").alias("c"))
    live = scratch.write(_in_documents(lines, "leaf").where(F.col("docs") >= min_docs).select("leaf").join(counts, "leaf"))
    # one row per generalised line in a live leaf, with its tokens
    in_docs = _in_documents(join_counted(lines, live, ["leaf"], scratch, "left_semi"), "line")
    told = join_counted(_lines(rows, kind, True), live, ["leaf"], scratch, "left_semi").groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    told = scratch.write(told.join(in_docs, "line"))
    is_short = F.size("tokens") < MIN_TOKENS
    short = told.where(is_short & (F.col("docs") >= min_docs)).select("line", F.array_join("tokens", " ").alias("template"))
    placed = told.where(~is_short).select("line", "leaf", "docs", F.posexplode("tokens").alias("at", "token"))
    # the leading tokens are those of every line in the leaf, so they have its support and need no join
    later = placed.where(F.col("at") >= DEPTH)
    fixed = later.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n"), F.count("*").alias("c")).where(F.col("n") >= min_docs).drop("n")
    later = join_counted(later, fixed.withColumn("fixed", F.lit(True)), ["leaf", "at", "token"], scratch, "left", size=F.octet_length("token"))
    fields = later.unionByName(placed.where(F.col("at") < DEPTH).withColumn("fixed", F.lit(True)))
    is_fixed = F.col("fixed").isNotNull() & (F.col("token") != FIELD)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(is_fixed, F.col("token")).otherwise(FIELD).alias("t")))), lambda x: x["t"])
    made = fields.groupBy("line").agg(F.array_join(parts, " ").alias("template"), F.count_if(is_fixed).alias("n_fixed"), F.count("*").alias("n"))
    made = scratch.write(made.where((F.col("n_fixed") >= F.col("n") * FIXED_SHARE) & (F.col("n_fixed") >= MIN_TOKENS - 1)).select("line", "template").unionByName(short))
    counts = lines.groupBy("line").agg(F.count("*").alias("c"))
    made = join_checked(counts, made, "line", "inner", size=F.octet_length("template"))
    having = scratch.write(join_counted(lines, made, ["line"], scratch, size=F.octet_length("template")).select("_id", "_hash", "no", "template"))
    first = having.groupBy("template").agg(F.min(F.struct("_id", "_hash", "no")).alias("first"), F.count("*").alias("c"))
    often = _in_documents(having, "template").where(F.col("docs") >= min_docs).drop("docs").join(first, "template")
    again = join_counted(having, often, ["template"], scratch, size=F.octet_length("template")).where(~F.struct("_id", "_hash", "no").eqNullSafe(F.col("first")))
    hits = again.groupBy("_id", "_hash").agg(F.collect_set(F.struct("no", "template")).alias("hits"))
    return scratch.write(hits.select("_id", "_hash", F.col("hits.no").alias("spots"), "hits"))


def _bytes() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["template"]) + 16)


def _marked(docs: DataFrame, doc_id: str, text: str, min_docs: int, how: str, keep: list[Column]) -> DataFrame:
    found = recurring_lines(docs, doc_id, text, min_docs, Scratch(docs.sparkSession, "lines"))
    mine = docs.select(*keep, docs[doc_id].alias("_own"), F.hash(docs[text]).alias("_own_hash"), docs[text].alias("_text"))
    return join_checked(mine, found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), how, size=_bytes())


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per line that goes: id, line_no (from 0, lines are split at line feeds), template, line.

    A document, for counting, is an id with a text: wholly repeated rows count once and lose the same lines. The first
    occurrence is that of the smallest id, then text hash, then line. Tokens with a digit are fields; a line of such tokens
    alone is its own template. A line under MIN_TOKENS words has no other fields; a longer one needs FIXED_SHARE of its
    tokens, and all but one of the least number, to be fixed. No document is spared: of many copies of one all but the
    first lose the lines that recur, and may be left without words. Null and empty texts have no lines; rows without an id
    are documents too; a line of any length is parsed as a whole; an empty table gives no rows. Only id and text are read.
    """
    rows = _marked(docs, doc_id, text, min_docs, "inner", [])
    one = rows.select("_own", F.split("_text", "\n", -1).alias("lines"), F.explode("hits").alias("h"))
    return one.select(F.col("_own").alias(doc_id), F.col("h.no").alias("line_no"), F.col("h.template").alias("template"), F.get("lines", F.col("h.no")).alias("line"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without those lines; texts that lose none are untouched and no row goes."""
    rows = _marked(docs, doc_id, text, min_docs, "left", [F.struct(*[docs[c] for c in docs.columns]).alias("_doc")])
    left = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("spots", i)), "\n")
    new = F.when(F.col("spots").isNotNull(), left).otherwise(F.col("_text"))
    return rows.select(*[(new if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])
