"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of dimensions. If two are within squared distance e, then in at least one
block they are within e times the block's share of the dimensions. Each block is range-joined on a grid over its first
coordinates: a vector lives in one cell and visits the cells its range touches, with its coordinates in that block
alone. Only vectors near another one there are fetched as a whole, for the exact cosine of the raw vectors. Both steps
are matrix products on tiles of bounded size; a pair counts in the first block that admits it, so nothing has to be
made distinct and no pair becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, components, join_checked, join_counted

BLOCKS = 8
#: Vectors of a tile's side; larger cells are cut into tiles.
TILE = 2048
_SLACK = 1e-7
#: Added to the squared distance in a block between coordinates in single precision.
_COARSE = 1e-5


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int) -> list[slice]:
    n = min(BLOCKS, d)
    edges = [round(i * d / n) for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ _rotation(x.shape[1]).T


def _visits(classes: DataFrame, budget: float, grid: int, kind: str) -> DataFrame:
    """(id, label, dim, block, cell, guest, part): each class in its own cell of every block, and as a guest in those cells
    of its range that come after its own, so that of two classes in different cells only one visits the other.

    part has the class's coordinates in the block alone.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, group in batch.groupby("dim"):
                for at in range(0, len(group), TILE):
                    some = group.iloc[at : at + TILE]
                    y = _unit(np.stack(some.vec.to_numpy()))
                    for b, cut in enumerate(_blocks(int(d))):
                        reach = _reach(budget, int(d), cut) + _SLACK
                        g = min(grid, cut.stop - cut.start)
                        z, side = y[:, cut][:, :g], 2 * reach
                        home, hi = (np.floor((z + off) / side).astype(int) for off in (0.0, reach))
                        lo = np.floor((z - reach) / side).astype(int)
                        ids, cells, guests = [], [], []
                        for i in range(len(some)):
                            own = tuple(home[i])
                            for c in product(*(range(p, q + 1) for p, q in zip(lo[i], hi[i], strict=True))):
                                if c >= own:
                                    ids.append(i), cells.append("_".join(map(str, c))), guests.append(c > own)
                        part = list(y[ids, cut.start : cut.stop].astype(np.float32))
                        yield some.iloc[ids].assign(block=b, cell=cells, guest=guests, part=part)[["id", "label", "dim", "block", "cell", "guest", "part"]]

    return classes.mapInPandas(place, f"id {kind}, label string, dim int, block int, cell string, guest boolean, part array<float>")


def _tiled(members: DataFrame, cell: list[str], scratch: Scratch) -> DataFrame:
    """Members of a cell in tiles (lo, hi): dealt into chunks of about TILE, a tile has two chunks or one with itself."""
    sizes = members.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    large = scratch.write(sizes.where("chunks > 1"))
    cut = join_checked(members, large, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.select(*members.columns, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))


def _reach(budget: float, d: int, cut: slice) -> float:
    return math.sqrt(budget * (cut.stop - cut.start) / d)


def _within(x: np.ndarray, y: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of x and y are at most ``limit`` apart, squared."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T) <= limit


def _sides(tile: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of a tile's rows and columns in pieces, and which of their pairs are the tile's to look at.

    Guests are not compared with guests; inside one chunk a pair is looked at once.
    """
    chunk, guest = tile.chunk.to_numpy(), tile.guest.to_numpy()
    rows, same = np.flatnonzero(chunk == tile.lo.iloc[0]), tile.lo.iloc[0] == tile.hi.iloc[0]
    cols = rows if same else np.flatnonzero(chunk == tile.hi.iloc[0])
    for r in np.array_split(rows, math.ceil(len(rows) / TILE) or 1):
        for c in np.array_split(cols, math.ceil(len(cols) / TILE) or 1):
            mask = ~(guest[r][:, None] & guest[c])
            if same:
                mask &= r[:, None] < c
            if mask.any():
                yield r, c, mask


def _candidates(tile: pd.DataFrame, budget: float) -> pd.DataFrame:
    """The members of a tile that are near another one in its block."""
    d, part = int(tile.dim.iloc[0]), np.stack(tile.part.to_numpy()).astype(np.float64)
    limit = budget * part.shape[1] / d + _COARSE
    near = np.zeros(len(tile), dtype=bool)
    for r, c, mask in _sides(tile):
        mask &= _within(part[r], part[c], limit)
        near[r] |= mask.any(axis=1)
        near[c] |= mask.any(axis=0)
    return tile[near].drop(columns="part")


def _tile_links(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of a bipartite link matrix's rows and columns (labels are row numbers)."""
    rows = np.arange(mask.shape[0])
    while True:
        cols = np.where(mask, rows[:, None], len(rows)).min(axis=0)
        new = np.minimum(rows, np.where(mask, cols[None, :], len(rows)).min(axis=1))
        if (new == rows).all():
            return rows, cols
        rows = new


def _links(tile: pd.DataFrame, budget: float, cosine: float) -> pd.DataFrame:
    """Of a tile's candidates: per vector with links the copies it links to and a vector of its component."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    b, d = int(tile.block.iloc[0]), int(tile.dim.iloc[0])
    cuts = _blocks(d)
    raw = np.stack(tile.vec.to_numpy()).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    y, norm = _unit(raw), np.sqrt((raw * raw).sum(axis=1))
    ids, copies = tile.id.to_numpy(), tile.copies.to_numpy()

    def near(r: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
        return _within(y[r, cuts[k]], y[c, cuts[k]], budget * (cuts[k].stop - cuts[k].start) / d + _SLACK)

    for r, c, mask in _sides(tile):
        mask &= near(r, c, b) & (raw[r] @ raw[c].T >= cosine * norm[r][:, None] * norm[c])
        for k in range(b):
            if mask.any():
                mask &= ~near(r, c, k)
        if mask.any():
            rows, cols = _tile_links(mask)
            for at, n, root in ((r, mask @ copies[c], rows), (c, copies[r] @ mask, cols)):
                some = n > 0
                out.append((ids[at[some]], n[some], ids[r[root[some]]]))
    if not out:
        return pd.DataFrame({"id": tile.id.iloc[:0], "n": pd.Series(dtype="int64"), "root": tile.id.iloc[:0]})
    return pd.DataFrame({"id": np.concatenate([x[0] for x in out]), "n": np.concatenate([x[1] for x in out]), "root": np.concatenate([x[2] for x in out])})


def link_embeddings(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept, among vectors of equal label and length.

    Linked are two vectors with cosine >= ``cosine`` in double precision, whatever their lengths. n_links counts other
    vectors linked directly, component_id is the smallest id reachable, kept marks it. Vectors that are null, empty, zero
    or hold null or non-finite components, and those without a label, link with nothing. Equal vectors are one node with
    a count, so copies are never paired. Wholly repeated rows are one vector; other vectors of one id are rows of their
    own, each with its own links, in the component that they share. Vectors without an id stand alone. An empty table
    gives no rows. Only id, vector and label are read.
    """
    kind = dict(vectors.dtypes)[vec_id]
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = vectors.select(vectors[vec_id].alias("id"), vectors[embedding].alias("vec"), vectors[label].cast("string").alias("label")).distinct()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0), F.lit(False))
    v = scratch.write(v.withColumn("sound", sound))
    good = v.where("sound")
    # a class's node has a number of its own, fixed by being written: an id may stand for vectors of several classes
    classes = scratch.write(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    nodes = classes.select("id", "label", F.size("vec").alias("dim"), "copies", "vec")
    largest = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    budget = max(0.0, 2 - 2 * cosine) + _SLACK
    # a coordinate of the grid leaves about a third of the vectors in the fullest cell
    grid = max(1, math.ceil(math.log(max(1, largest) / TILE, 3)))
    cell = ["label", "dim", "block", "cell"]
    tile = [*cell, "lo", "hi"]
    visits = scratch.write(_visits(nodes, budget, grid, "long"))
    near = _tiled(visits, cell, scratch).groupBy(*tile).applyInPandas(lambda pdf: _candidates(pdf, budget), "id long, label string, dim int, block int, cell string, guest boolean, chunk int, lo int, hi int")
    near = scratch.write(near).join(classes.select("id", "copies", "vec"), "id")
    found = scratch.write(near.groupBy(*tile).applyInPandas(lambda pdf: _links(pdf, budget, cosine), "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    # classes are tied by links, and by ids that they share
    own = good.select(F.col("id").alias("own"), "label", "vec")
    rows = scratch.write(join_counted(own, classes.select("label", "vec", "id", F.col("copies").alias("c")), ["label", "vec"], scratch, size=8 * F.size("vec")).select("own", "id"))
    several = rows.groupBy("own").agg(F.count("*").alias("c"), F.min("id").alias("b")).where("c > 1")
    ties = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(join_counted(rows, several, ["own"], scratch).select(F.col("id").alias("a"), "b"))
    groups = components(ties, scratch)
    placed = scratch.write(classes.join(groups, "id", "left").select("id", "rep", "copies", F.coalesce("component", "id").alias("group")))
    least = placed.groupBy("group").agg(F.min("rep").alias("component"), F.count("*").alias("c"))
    known = join_counted(placed, least, ["group"], scratch).join(counts, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", F.col("copies").alias("c"))
    out = join_counted(rows, known, ["id"], scratch).select(F.col("own").alias("id"), "n_links", F.col("component").alias("component_id"))
    alone = v.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
