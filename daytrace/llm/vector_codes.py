"""Vector code compression: product quantization in exact integers.

A vector's components become integers and its eight parts are each replaced by the number of the nearest entry of the
part's codebook. Distances come from matrix products of doubles: integers are cut into limbs so small that a product of
two, summed over a part, stays below 2^53 and is exact; the limbs' products are put together in int64, or in Python's
integers where int64 is too small. Each round is one pass over the vectors; a task sums what its parts gave each entry,
as limbs, and the driver sees only the codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import BROADCAST_BYTES, Scratch, join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a matrix product.
BLOCK = 4096
#: Bits of a limb of the sums, so that sums of 2^31 limbs fit a long.
SUM_BITS = 32
_LONG = 2**63 - 1


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exactly: int64, or Python's integers if one doesn't fit."""
    if not rows.size or np.abs(rows).max() < 2**50:
        return np.floor(rows * SCALE).astype(np.int64)
    exact = [[math.floor(x * SCALE) if abs(x) < 2**50 else int(x) * SCALE for x in row] for row in rows.tolist()]
    return np.array(exact, dtype=object)


def _bits(x: np.ndarray) -> int:
    return int(max(abs(int(x.max())), abs(int(x.min())))).bit_length() if x.size else 0


def _limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Doubles whose sum of d[i] * 2^(i * width) is x; each is below 2^width in size."""
    sign, rest, out = np.where(x < 0, -1, 1), abs(x), []
    mask = (1 << width) - 1
    while True:
        out.append((sign * (rest & mask)).astype(np.float64))
        rest = rest >> width
        if not rest.any():
            return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices: int64 if every result must fit, else Python's integers."""
    m = max(1, a.shape[1])
    width = (53 - m.bit_length()) // 2
    fits = _bits(a) + _bits(b) + m.bit_length() <= 62
    total = np.zeros((len(a), len(b)), dtype=np.int64 if fits else object)
    for i, p in enumerate(_limbs(a, width)):
        for j, q in enumerate(_limbs(b, width)):
            part = (p @ q.T).astype(np.int64)
            total = total + (part << ((i + j) * width) if fits else part.astype(object) * (1 << ((i + j) * width)))
    return total


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of least squared distance to each part, and that distance."""
    big = 2 * max(_bits(parts), _bits(entries)) + parts.shape[1].bit_length() + 2 > 62
    kind = object if big else np.int64
    p, e = parts.astype(kind), entries.astype(kind)
    # the part's own square is the same for all entries
    found = (e * e).sum(axis=1)[None, :] - 2 * exact_products(parts, entries)
    at = np.array(found.tolist() if big else found).argmin(axis=1) if len(parts) else np.zeros(0, dtype=np.int64)
    return at, found[np.arange(len(parts)), at] + (p * p).sum(axis=1)


def _padded(rows: np.ndarray) -> np.ndarray:
    """Rows as (row, part, position); lengths that parts don't divide are filled up with zeros."""
    width = -(-rows.shape[1] // PARTS)
    out = np.zeros((len(rows), PARTS * width), dtype=rows.dtype)
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), PARTS, width)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(length, rows, integers as parts) in blocks of rows of one length."""
    for batch in batches:
        for dim, group in batch.groupby("dim"):
            for at in range(0, len(group), BLOCK):
                some = group.iloc[at : at + BLOCK]
                yield int(dim), some, _padded(whole(np.stack(some.vec.to_numpy()).astype(np.float64).reshape(len(some), int(dim))))


def _round_sums(books: dict[int, np.ndarray]):
    """A pass's task: (dim, part, entry, n, position, limb, total) of the parts that are nearest to each entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = {d: np.zeros(b.shape[:2], dtype=np.int64) for d, b in books.items()}, {d: np.zeros(b.shape, dtype=object) for d, b in books.items()}
        for dim, _, x in _blocks(batches):
            for part in range(PARTS):
                at, _ = nearest(x[:, part], books[dim][part])
                counts[dim][part] += np.bincount(at, minlength=len(books[dim][part]))
                for entry in np.unique(at):
                    sums[dim][part, entry] += x[at == entry, part].astype(object if x.dtype == object or _bits(x) > 48 else np.int64).sum(axis=0).astype(object)
        for dim, n in counts.items():
            rows = []
            for part, entry in zip(*np.nonzero(n), strict=True):
                rows.append((dim, part, entry, n[part, entry], -1, 0, 0))
                for position, value in enumerate(sums[dim][part, entry]):
                    sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                    while rest:
                        rows.append((dim, part, entry, 0, position, limb, sign * (rest & ((1 << SUM_BITS) - 1))))
                        rest, limb = rest >> SUM_BITS, limb + 1
            if rows:
                yield pd.DataFrame(rows, columns=["dim", "part", "entry", "n", "position", "limb", "total"])

    return run


def _final(books: dict[int, np.ndarray], digests: dict[int, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, some, x in _blocks(batches):
            codes, error = np.zeros((len(some), PARTS), dtype=np.int64), np.zeros(len(some), dtype=object)
            for part in range(PARTS):
                codes[:, part], far = nearest(x[:, part], books[dim][part])
                error = error + far.astype(object)
            code = ["".join(f"{c:02x}" for c in row) for row in codes]
            fits = pd.array([int(e) if e <= _LONG else None for e in error], dtype="Int64")
            yield some.drop(columns=["vec", "dim"]).assign(code=code, error=fits, codebooks_sha256=digests[dim])

    return run


def _fitted(vectors: DataFrame, first: pd.DataFrame, rounds: int) -> dict[int, np.ndarray]:
    """Codebooks (part, entry, position) by length of vector, from the vectors that start them."""
    books = {}
    for dim, rows in first.groupby("dim"):
        start = np.stack(rows.sort_values("at").vec.to_numpy()).astype(np.float64).reshape(len(rows), int(dim))
        books[int(dim)] = _padded(whole(start)).transpose(1, 0, 2)
    for _ in range(rounds):
        found = vectors.mapInPandas(_round_sums(books), "dim int, part int, entry int, n long, position int, limb int, total long")
        found = found.groupBy("dim", "part", "entry", "position", "limb").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
        sums: dict[tuple[int, int, int], dict[int, int]] = {}
        for dim, part, entry, position, limb, total in found[["dim", "part", "entry", "position", "limb", "total"]].itertuples(index=False):
            own = sums.setdefault((dim, part, entry), {})
            if position >= 0:
                own[position] = own.get(position, 0) + (int(total) << (SUM_BITS * limb))
        counts = {(r.dim, r.part, r.entry): int(r.n) for r in found[found.position < 0].itertuples()}
        for dim, book in books.items():
            after = book.astype(object)
            for (d, part, entry), own in sums.items():
                if d == dim:
                    after[part, entry] = [own.get(k, 0) // counts[d, part, entry] for k in range(book.shape[2])]
            books[dim] = after.astype(np.int64) if _bits(after) < 63 else after
    return books


def _digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in book.reshape(-1)).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of the vectors that are not null and hold finite numbers only.

    code has two hex digits for each of eight parts; error is the squared distance between the integer vector and its
    entries, label_error the sum of it over rows of an equal label, null labels together. Either is null where a long
    can't hold it. Codebooks start with the 16 smallest ids (null ids last, ties by vector), or all if they are fewer;
    repeated rows start an entry each. Vectors of several lengths have codebooks by length, each with a digest of its own;
    a length that eight doesn't divide is filled up with zeros, which changes no distance. Empty vectors have a code of
    zeros, and no error. An empty table gives no rows. Only id, vector and label are read.

    Codebooks are on the driver and in every task: 16 entries per length, in batches of lengths within BROADCAST_BYTES.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    value = F.col("vec").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(vectors[vec_id].alias("id"), vectors[label].alias("label"), vectors[embedding].alias("vec")).where(F.col("vec").isNotNull())
    rows = scratch.write(rows.select("id", "label", value.alias("vec"), F.size("vec").alias("dim")).where(~F.exists("vec", bad)))
    lengths = [(r.dim, r.n) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()]
    at = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "vec"))
    some, parts = [], []
    for k, (dim, _) in enumerate(lengths):
        some.append(dim)
        if k + 1 < len(lengths) and sum(16 * ENTRIES * (d + PARTS) for d in [*some, lengths[k + 1][0]]) <= BROADCAST_BYTES:
            continue
        mine = rows if len(some) == len(lengths) else rows.where(F.col("dim").between(some[0], some[-1]))
        first = mine.select("dim", "vec", at.alias("at")).where(F.col("at") <= ENTRIES).toPandas()
        books = _fitted(mine.select("dim", "vec"), first, rounds)
        schema = f"id {dict(rows.dtypes)['id']}, label {dict(rows.dtypes)['label']}, code string, error long, codebooks_sha256 string"
        parts.append(scratch.write(mine.select("id", "label", "vec", "dim").mapInPandas(_final(books, {d: _digest(b) for d, b in books.items()}), schema)))
        some = []
    if not parts:
        return rows.select(F.col("id").alias(vec_id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = parts[0]
    for more in parts[1:]:
        coded = coded.unionByName(more)
    # null labels are one label; sums beyond a long are null
    coded = coded.withColumn("_null", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(28,0)")))
    sums = coded.groupBy("_null", "_label").agg(F.count("*").alias("c"), total.alias("total"))
    out = join_counted(coded, sums, ["_null", "_label"], scratch, size=F.octet_length("_label"))
    return out.select(F.col("id").alias(vec_id), "code", "error", F.when(F.abs("total") <= _LONG, F.col("total").cast("long")).alias("label_error"), "codebooks_sha256")
