"""Substring dedup on sliding sentence spans.

Every run of RUN consecutive sentences is hashed; the hashes are counted over all documents, and sentences that a
repeated run covers are removed wherever the run is not the first. Only hashes and places are shuffled, and the places
meet just those hashes that stand at two or more of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked, join_counted

#: Sentences of a span.
RUN = 3
#: A sentence of under SHORT words is part of the next one; one of over LONG words is cut.
SHORT, LONG = 4, 24
#: A long sentence is cut after words of which one in CUT is, by hash: at the same words wherever a passage stands.
CUT = 8
#: Where a sentence ends: full stop, question or exclamation mark (with closing quotes and brackets) before a space or
#: the end, marks of scripts that need no space after them, and line feeds.
_MARK, _CLOSE, _OPEN_ENDED = ("|".join(map(re.escape, x)) for x in (".!?…", "\"'”’»)]", "。！？।؟۔"))
_END = re.compile(f"(?:(?:{_MARK})(?:{_CLOSE})*)+(?=[ \t-\r]|$)|(?:{_OPEN_ENDED})+|\n".encode())
_WORD = re.compile(rb"[^ \t-\r]+")
_FLUSH = 100_000


def sentences(text: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, words joined by one space) of the sentences in order; ends exclude the space that follows."""
    out: list[tuple[int, int, bytes]] = []
    words: list[bytes] = []
    begin = end = start = 0
    for stop in [m.end() for m in _END.finditer(text)] + [len(text)]:
        piece = text[start:stop]
        new = piece.split()
        if new:
            if not words:
                begin = start + piece.index(new[0])
            words += new
            end = start + len(piece.rstrip())
        start = stop
        if words and (len(words) >= SHORT or stop == len(text)):
            out += [(begin, end, b" ".join(words))] if len(words) <= LONG else _cut(text, begin, end)
            words = []
    return out


def _cut(text: bytes, begin: int, end: int) -> list[tuple[int, int, bytes]]:
    """The pieces of a long sentence."""
    out, part = [], []
    for m in _WORD.finditer(text, begin, end):
        part.append(m)
        if len(part) >= LONG or len(part) >= SHORT and crc32(m.group()) % CUT == 0:
            out.append(part)
            part = []
    return [(p[0].start(), p[-1].end(), b" ".join(m.group() for m in p)) for p in [*out, part] if p]


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def _spans(docs: DataFrame, kind: str, run: int) -> DataFrame:
    """(_id, _hash, hash, check, at): a row for the run that starts at each sentence, with 96 bits of its digest."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", "_hash", "hash", "check", "at"]
        rows: list[tuple] = []
        for batch in batches:
            for i, h, text in zip(batch._id, batch._hash, batch._text, strict=True):
                own = [xxhash.xxh3_128_digest(s[2]) for s in sentences(_encoded(text))]
                for k in range(len(own) - run + 1):
                    d = xxhash.xxh3_128_intdigest(b"".join(own[k : k + run]))
                    rows.append((i, h, _signed(d, 64), _signed(d >> 64, 32), k))
                if len(rows) >= _FLUSH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(hashed, f"_id {kind}, _hash long, hash long, check int, at int")


def repeated_sentences(docs: DataFrame, doc_id: str, text: str, run: int, scratch: Scratch) -> DataFrame:
    """(_id, _hash, spots, firsts): numbers (from 0) of the sentences to remove, and the ids that hold first occurrences.

    A span's first occurrence is that of the smallest id, then text hash, then place; rows of one id are told apart by
    a hash of the text, and wholly repeated rows are one document.
    """
    rows = docs.select(docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_hash"), docs[text].alias("_text"))
    spans = scratch.write(_spans(rows, dict(docs.dtypes)[doc_id], run))  # read twice
    place = F.struct("_id", "_hash", "at")
    first = spans.groupBy("hash", "check").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1")
    again = join_counted(spans, first, ["hash", "check"], scratch).where(~place.eqNullSafe(F.col("first")))
    again = again.select("_id", "_hash", F.explode(F.sequence(F.col("at"), F.col("at") + run - 1)).alias("spot"), F.col("first._id").alias("_first"))
    return scratch.write(again.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("spot")).alias("spots"), F.array_sort(F.collect_set("_first")).alias("firsts")))


def _marked(docs: DataFrame, doc_id: str, text: str, run: int, how: str, keep: list[Column]) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "spans")
    found = repeated_sentences(docs, doc_id, text, run, scratch)
    mine = docs.select(*keep, docs[doc_id].alias("_own"), F.xxhash64(docs[text]).alias("_own_hash"), docs[text].alias("_text"))
    return join_checked(mine, found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), how, size=8 * (F.size("spots") + F.size("firsts")))


def _runs(spots: list[int]) -> list[tuple[int, int]]:
    """First and last number of each stretch of adjacent numbers."""
    out: list[tuple[int, int]] = []
    for s in spots:
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _without(text: str, spots: list[int]) -> str:
    """``text`` without some of its sentences; of the spaces before and after a removed run, those with more line feeds stay."""
    b = _encoded(text)
    all_of = sentences(b)
    out, at = [], 0
    for first, last in _runs(spots):
        final = last + 1 == len(all_of)
        before = b[all_of[first - 1][1] if first else 0 : all_of[first][0]]
        stop = len(b) if final else all_of[last + 1][0]
        after = b[all_of[last][1] : stop]
        more = after if final or after.count(b"\n") > before.count(b"\n") else before
        out += [b[at : all_of[first][0] - len(before)], more if first else before]
        at = stop
    return b"".join([*out, b[at:]]).decode("utf-8", "surrogatepass")


def removed_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """One row per run of adjacent removed sentences: id, first_sentence, n_sentences, n_words, text, first_ids.

    Removed are sentences covered by a span of ``run`` consecutive sentences that also stands earlier, in any document;
    spans are equal if their words are, whatever spaces separate them. Sentences end at full stops, question and
    exclamation marks and line feeds. One of under SHORT words is part of the next; one of over LONG words, such as text
    without marks, is cut behind words chosen by their hash, so that a passage pasted amid it is cut alike everywhere.
    first_ids are the documents that hold the first occurrences. Null and empty texts, those of under ``run`` sentences
    and unrepeated ones give no rows; of wholly repeated rows none repeats the other; rows of one id with other texts
    are documents of their own, and so are rows without an id; an empty table gives no rows. Only id and text are read.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = _marked(docs, doc_id, text, run, "inner", []).select("_own", "_text", "spots", "firsts")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, spots, firsts in zip(batch._own, batch._text, batch.spots, batch.firsts, strict=True):
                b = _encoded(t)
                all_of = sentences(b)
                for a, z in _runs(spots):
                    body = b[all_of[a][0] : all_of[z][1]]
                    out.append((i, a, z - a + 1, len(body.split()), body.decode("utf-8", "surrogatepass"), firsts))
            yield pd.DataFrame(out, columns=["id", "first_sentence", "n_sentences", "n_words", "text", "first_ids"])

    schema = f"id {kind}, first_sentence int, n_sentences int, n_words int, text string, first_ids array<{kind}>"
    return rows.mapInPandas(told, schema).withColumnRenamed("id", doc_id)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` with those sentences removed from ``text``; what stays keeps its own spaces and line feeds, no row goes."""
    rows = _marked(docs, doc_id, text, run, "left", [F.struct(*[docs[c] for c in docs.columns]).alias("_doc")])

    @F.pandas_udf("string")
    def left(texts: pd.Series, spots: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _without(t, list(s)) for t, s in zip(texts, spots, strict=True)], dtype=object)

    new = F.when(F.col("spots").isNotNull(), left(F.col("_text"), F.col("spots"))).otherwise(F.col("_text"))
    return rows.select(*[(new if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])
