"""Source divergence audit: how far the term distributions of a language's sources are apart, in exact integers.

One count vectorizer is fitted on terms that carry their language, so each language has a vocabulary of its own, made by
its own document frequencies. The sparse vectors of documents over it are summed per source, task by task and then by
Spark, as integers: a running mean, as Spark's summarizer keeps, would round. Pairs of sources are evaluated on tiles of terms and of blocks of
sources; a term that neither of two sources has adds the same to each, so only terms that occur in a tile are visited.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import methodcaller

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, join_checked

#: ASCII letters in lower case, all other ASCII as a space; bytes of other characters stay, as all of them are parts of terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a language that a kept term is in; ranks of the parts `term`; unit of the probabilities.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: No limit of the vectorizer's own.
VOCABULARY = 2**31 - 1
#: Terms of one model, which the driver and each executor hold: a larger vocabulary is cut into shards by hash.
SHARD_TERMS = 1_000_000
#: Documents that are looked at to size the shards, one in so many. It sets only how many models there are.
SIZING = 8
#: Terms whose document frequencies a task holds at a time.
SEEN_TERMS = 300_000
#: Terms of the vectors that a task sums at a time.
BATCH_TERMS = 1_000_000
#: Terms and sources on a tile's sides.
TILE_TERMS, TILE_SOURCES = 4096, 64


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of letters of ASCII and of all other characters, A-Z in lower case."""
    return text.translate(_LETTERS).split()


def _rows(batch: pa.RecordBatch, shards: int, shard: int) -> Iterator[tuple[str, str, list[bytes]]]:
    """(lang, source, terms of the shard); texts become Python's one by one, so a task holds few of them."""
    for lang, source, text in zip(*(map(methodcaller("as_py"), batch.column(c)) for c in ("lang", "source", "text")), strict=True):
        found = terms_of(text)
        yield lang, source, [t for t in found if zlib.crc32(t) % shards == shard] if shards > 1 else found


def _packed(sources: list[str], texts: list[tuple[bytes, list[bytes]]]) -> pa.RecordBatch:
    """Rows of a source and of terms behind their tag; the terms' bytes are joined once, and never are strings of Python."""
    data = b"".join(tag + tag.join(found) for tag, found in texts if found)
    sizes = np.concatenate([np.zeros(1, dtype=np.int64), *(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + len(tag) for tag, found in texts)])
    ends = np.cumsum(sizes).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
    rows = np.cumsum([0, *(len(found) for _, found in texts)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.ListArray.from_arrays(pa.array(rows), terms)], ["source", "terms"])


#: The vocabulary that this process had last: tasks that follow each other in it share it.
_LAST: list[tuple[str, dict[str, dict[bytes, int]]]] = []


def _numbers(key: str, shared) -> dict[str, dict[bytes, int]]:
    """By language the numbers of a model's terms."""
    if not _LAST or _LAST[0][0] != key:
        found: dict[str, dict[bytes, int]] = {}
        for at, tagged in enumerate(shared.value):
            lang, _, term = tagged.rpartition(" ")
            found.setdefault(lang, {})[term.encode()] = at
        _LAST[:] = [(key, found)]
    return _LAST[0][1]


def document_vector(terms: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A document's sparse vector: numbers of its kept terms and how often each occurs, as integers."""
    found = Counter(terms)
    at, n = (np.fromiter(v, dtype=np.int64, count=len(found)) for v in (map(numbers.get, found, repeat(-1)), found.values()))
    return at[at >= 0], n[at >= 0]


def _group_sums(docs: DataFrame, vocabulary: list[str], key: str) -> DataFrame:
    """(source, at, n) of (lang, source, text): sums of a source's document vectors over some documents, by number of term.

    The model's own vectors are of doubles, and cost more than all else here, so a task makes them of integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def told(groups: list[int], names: dict[str, int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        place = np.repeat(np.array(groups, dtype=np.int64), [len(at) for at, _ in vectors])
        pairs, back = np.unique(place << 32 | np.concatenate([at for at, _ in vectors]), return_inverse=True)
        # a batch's counts are far below 2^53, up to where doubles are exact
        n = np.bincount(back, weights=np.concatenate([n for _, n in vectors]), minlength=len(pairs)).astype(np.int64)
        source = pa.array(list(names), pa.string()).take(pa.array(pairs >> 32))
        return pa.RecordBatch.from_arrays([source, pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["source", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(key, shared)
        names, groups, vectors, size = {}, [], [], 0
        for batch in batches:
            for lang, source, terms in _rows(batch, 1, 0):
                groups.append(names.setdefault(source, len(names)))
                vectors.append(document_vector(terms, numbers.get(lang, {})))
                size += len(vectors[-1][0])
                if size > BATCH_TERMS:
                    yield told(groups, names, vectors)
                    names, groups, vectors, size = {}, [], [], 0
        if vectors:
            yield told(groups, names, vectors)

    return docs.mapInArrow(run, "source string, at int, n long")


def _seen(docs: DataFrame, most: int, shards: int = 1, shard: int = 0) -> DataFrame:
    """(terms) for document frequencies up to ``most``: rows that hold a term as often as documents of (lang, source, text) do, or ``most`` times.

    A term that is in ``most`` documents of some that a task has seen is in as many of all, so it need not come more often.
    The first row of several has the terms of any document, the second those of two, and so on.
    """

    def told(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            some, k = found, 1
            while some:
                yield _packed([""], [(lang.encode() + b" ", list(some))])
                k += 1
                some = [t for t in some if found[t] >= k] if k <= most else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, _, found in _rows(batch, shards, shard):
                counts.setdefault(lang, Counter()).update(set(found))
                if sum(map(len, counts.values())) > SEEN_TERMS:
                    yield from told(counts)
                    counts = {}
        yield from told(counts)

    return docs.mapInArrow(run, "source string, terms array<string>").select("terms")


def _shards(docs: DataFrame, min_docs: int) -> int:
    """Models needed for the vocabulary: of one SIZINGth of the documents, terms that a kept one must be among with some probability."""
    least = 2 if min_docs >= SIZING else 1
    share = 1 / SIZING
    found = 1 - sum(math.comb(min_docs, k) * share**k * (1 - share) ** (min_docs - k) for k in range(least))
    some = docs.where(F.monotonically_increasing_id() % SIZING == 0)
    n = _seen(some, least).select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least).count()
    return max(1, math.ceil(n / found / SHARD_TERMS))


def term_counts(docs: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (lang, source, text): the kept terms (lang, term), and (lang, source, term, no, n) where n is over 0; no is the term's number."""
    spark = docs.sparkSession
    shards = _shards(docs, min_docs)
    words, sums = [], []
    for shard in range(shards):
        # a model must not be empty: enough rows of a term that no text has
        filler = spark.range(max(1, min_docs)).select(F.array(F.lit(" ")).alias("terms"))
        model = CountVectorizer(inputCol="terms", minDF=float(min_docs), vocabSize=VOCABULARY).fit(_seen(docs, min_docs, shards, shard).unionByName(filler))
        path = f"{scratch.path}/model-{shard}"
        model.write().save(path)
        words.append(spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "tagged")).withColumn("shard", F.lit(shard)))
        found = _group_sums(docs, model.vocabulary, path)
        # written, so that only one model at a time is held
        sums.append(scratch.write(found.groupBy("source", "at").agg(F.sum("n").alias("n")).withColumn("shard", F.lit(shard))))
    every = lambda frames: frames[0] if len(frames) == 1 else every(frames[: len(frames) // 2]).unionByName(every(frames[len(frames) // 2 :]))
    term = F.substring_index("tagged", " ", -1)
    lang = F.substr("tagged", F.lit(1), F.length("tagged") - F.length(term) - 1)
    kept = scratch.write(every(words).select("shard", "at", lang.alias("lang"), term.alias("term")).where("term <> ''"))
    counts = scratch.write(join_checked(every(sums), kept, ["shard", "at"], "inner", size=F.octet_length("lang") + F.octet_length("term")).select("lang", "source", "term", (F.col("shard").cast("long") * 2**32 + F.col("at")).alias("no"), "n"))
    return kept.select("lang", "term"), counts


def _probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)) without a rounded step; null without terms."""
    wide = lambda x: x.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 2), F.nullif(wide(total + 2 * terms), F.lit(0).cast("decimal(20,0)")))
    return whole + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """Of the rows (source, side, at, p, p0) of a tile, those with no ``at`` naming its sources: sums per pair of sources.

    ``present`` is how many terms of the chunk were looked at: those that any source of the tile has.
    """
    heads, rows = tile[tile["at"].isna()], tile[tile["at"].notna()]
    heads = heads.sort_values("source", ignore_index=True)
    place = pd.Series(heads.index, index=heads.source)
    terms, col = np.unique(rows["at"].to_numpy(dtype=np.int64), return_inverse=True)
    p = np.repeat(heads.p0.to_numpy(dtype=np.int64)[:, None], len(terms), axis=1)
    p[place[rows.source].to_numpy(), col] = rows.p.to_numpy(dtype=np.int64)
    side = heads.side.to_numpy()
    one_block = tile.lo.iloc[0] == tile.hi.iloc[0]
    out = []
    for i in range(len(heads)):
        others = np.arange(i + 1, len(heads)) if one_block else np.flatnonzero(side == 1) if side[i] == 0 else []
        for j in others:
            gap = p[i] - p[j]
            out.append((tile.lang.iloc[0], heads.source[i], heads.source[j], int((gap * gap // (p[i] + p[j])).sum()), len(terms)))
    return pd.DataFrame(out, columns=["lang", "a", "b", "value", "present"])


def _pair_sums(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value, present) for ordered pairs of a language's sources that have tiles."""
    placed = groups.withColumn("blocks", F.ceil(F.col("sources") / TILE_SOURCES).cast("int")).withColumn("block", F.pmod(F.hash("source"), "blocks"))
    placed = placed.withColumn("chunks", F.ceil(F.col("terms") / TILE_TERMS).cast("int"))
    heads = placed.where("chunks > 0").select("lang", "source", "block", "blocks", "p0", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("p"))
    known = join_checked(counts, placed.select("lang", "source", "block", "blocks", "chunks", "p0"), ["lang", "source"], "inner", size=F.octet_length("lang") + F.octet_length("source"))
    rows = known.select("lang", "source", "block", "blocks", "p0", F.pmod(F.hash("no"), "chunks").alias("chunk"), F.col("no").alias("at"), "p")
    both = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = both.select("lang", "source", "chunk", "at", "p", "p0", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    found = tiles.groupBy("lang", "chunk", "lo", "hi").applyInPandas(_tile_sums, "lang string, a string, b string, value long, present long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ends.alias("e"), "value", "present").select("lang", "e.source", "e.item", "value", "present")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the audit of all sources of each language.

    Part ``pair``: item is another source, value the distance of both over all kept terms. Part ``term``: item is a term
    that is more likely in the source than in its language, value its share, only the ``top`` ranks. Ranks count from 1 by
    value descending, then item ascending by UTF-8. Kept are terms in at least ``min_docs`` rows of the language.

    Null text, language and source are empty strings. A source without terms is a source with counts of zero; a language
    without kept terms has distances of zero and no terms; one with a single source has no pairs. Repeated rows count as
    often as they stand there; whole texts are counted, however long. An empty table gives no rows. Columns beside text,
    language and source are not read, so their names don't matter.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    told = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    kept, counts = term_counts(told, min_docs, scratch)
    size = F.octet_length("lang") + F.octet_length("source")
    # per source: its words, its language's terms and words
    found = told.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n")).unionByName(counts.select("lang", "source", "n"))
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    of_lang = groups.groupBy("lang").agg(F.sum("words").alias("lang_words"), F.count("*").alias("sources"))
    of_lang = of_lang.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").fillna(0, ["terms"])
    groups = scratch.write(groups.join(of_lang, "lang").withColumn("p0", _probability(F.lit(0).cast("long"), F.col("words"), F.col("terms"))))
    all_words = F.sum("n").over(Window.partitionBy("lang", "term"))
    known = join_checked(counts.withColumn("lang_n", all_words), groups.select("lang", "source", "words", "lang_words", "terms"), ["lang", "source"], "inner", size=size)
    known = scratch.write(known.select("lang", "source", "term", "no", _probability(F.col("n"), F.col("words"), F.col("terms")).alias("p"), _probability(F.col("lang_n"), F.col("lang_words"), F.col("terms")).alias("q")))
    terms = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))

    # the result has a row for each pair of a language's sources, so this join is as large as the result
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("source <> item")
    sums = _pair_sums(groups, known.select("lang", "source", "no", "p"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left")
    rest = F.coalesce((F.col("terms") - F.coalesce("present", F.lit(0))) * _apart(F.col("p0"), F.col("q0")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda rows: rows.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
