"""Conflict-constrained best-fit packing of documents into training sequences of a fixed number of words.

Rows are dealt by hash into blocks of bounded size, and each block is packed by itself: largest piece first, bins kept
in the order of their room. A bin carries bitmaps of its sources and duplicate clusters; the search starts at the
tightest bin that has the room and walks to roomier ones until the bitmaps allow the piece.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, words_of

CAPACITY = 2048
#: Rows of a block on average; a larger block wastes less room and takes more memory and time.
BLOCK_ROWS = 3000
#: Documents of one source that a sequence may hold.
PER_SOURCE = 2


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int) -> Iterator[tuple[int, int]]:
    """Place pieces (size, source bit number, cluster bit number or -1), sizes 1..capacity, in the given order.

    Yields (bin, offset) of each: the bin with the least room that is enough, has under ``per_source`` pieces of the
    source and none of the cluster; a new bin if there is none.
    """
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    sources: list[list[int]] = []  # of a bin: bitmap k has the sources with over k pieces
    clusters: list[int] = []
    for size, source, cluster in pieces:
        s_bit, c_bit = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (sources[room[at][1]][-1] & s_bit or clusters[room[at][1]] & c_bit):
            at += 1
        if at < len(room):
            left, where = room.pop(at)
        else:
            left, where = capacity, len(sources)
            sources.append([0] * per_source)
            clusters.append(0)
        yield where, capacity - left
        for k, seen in enumerate(sources[where]):
            if not seen & s_bit:
                sources[where][k] |= s_bit
                break
        clusters[where] |= c_bit
        if left > size:
            insort(room, (left - size, where))


def _pack_block(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    full, rest = [], []
    for doc, copy, size, source, cluster in zip(rows._id, rows._copy, rows._size, rows._src, rows._cluster, strict=True):
        whole = size // capacity
        full += [(doc, copy, k, k * capacity, capacity) for k in range(whole)]
        if size % capacity:
            rest.append((-(size % capacity), doc, copy, whole, source, cluster))
    full.sort(key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], *r[1:]))
    rest.sort(key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1], r[2]))
    often = Counter(r[5] for r in rest)
    source_bits = {s: i for i, s in enumerate(sorted({r[4] for r in rest}))}
    cluster_bits = {c: i for i, c in enumerate(sorted(c for c, n in often.items() if n > 1))}
    spots = best_fit(((-r[0], source_bits[r[4]], cluster_bits.get(r[5], -1)) for r in rest), capacity, per_source)
    out = [(doc, copy, piece, start, n, i, 0) for i, (doc, copy, piece, start, n) in enumerate(full)]
    out += [(doc, copy, piece, piece * capacity, -minus, len(full) + where, offset) for (minus, doc, copy, piece, _, _), (where, offset) in zip(rest, spots, strict=True)]
    packed = pd.DataFrame(out, columns=["_id", "_copy", "_piece", "_start", "_n", "_bin", "_offset"])
    packed["_block"] = rows._block.iloc[0]
    return packed


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None,
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Placements: id, copy, piece, start, n_words (of the piece), bin, bin_offset; words are those of ``words_of``.

    A document longer than ``capacity`` is cut into full pieces, which fill bins alone, and a rest. Documents of one
    duplicate ``cluster`` (a column; without it, equal texts but for case and spacing) never share a bin. Documents
    without words take no room: one row with piece 0, n_words 0 and null bin. Equal rows are told apart by ``copy``
    (1, 2, ...); null source is a source; null cluster stands for the text's own. Pieces of one size are placed by id
    (null last), then copy; bins of equal room by number. An empty table gives no rows.
    Only the named columns are read. Bins are numbered in 64 bits: block, then bin in the block.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    words = words_of(docs[text])
    own = F.xxhash64(F.array_join(F.transform(words, lambda w: F.lower(w)), " "))
    group = own if cluster is None else F.coalesce(F.xxhash64(docs[cluster]), own)
    lite = docs.select(docs[doc_id].alias("_id"), F.coalesce(docs[source].cast("string"), F.lit("\x00")).alias("_src"), group.alias("_cluster"), F.size(words).cast("long").alias("_size"))
    # equal rows become copies 1..n, so that each has a place of its own in the deal
    alike = lite.groupBy("_id", "_src", "_cluster", "_size").agg(F.count("*").alias("n"))
    rows = scratch.write(alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"))
    some = rows.where("_size > 0")
    blocks = max(1, math.ceil(some.count() / block_rows))
    dealt = some.withColumn("_block", F.pmod(F.xxhash64("_id", "_copy", "_cluster", "_src"), F.lit(blocks)))
    kind = dict(rows.dtypes)["_id"]
    packed = dealt.groupBy("_block").applyInPandas(
        lambda pdf: _pack_block(pdf, capacity, per_source), f"_id {kind}, _copy int, _piece int, _start long, _n long, _bin long, _offset long, _block long"
    )
    placed = packed.select(
        F.col("_id").alias(doc_id), F.col("_copy").alias("copy"), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_n").alias("n_words"),
        (F.col("_block") * (1 << 32) + F.col("_bin")).alias("bin"), F.col("_offset").alias("bin_offset"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = rows.where("_size = 0").select(F.col("_id").alias(doc_id), F.col("_copy").alias("copy"), F.lit(0).alias("piece"), zero.alias("start"), zero.alias("n_words"), none.alias("bin"), none.alias("bin_offset"))
    return placed.unionByName(empty)
