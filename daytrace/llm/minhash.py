"""MinHash near-duplicates with tensored banding.

Instead of a set of hashes for each of many tables, a document gets two small collections of sub-keys, SIDE each, of
WIDTH minhashes; a table's key is a pair of sub-keys, one of either collection. SIDE * SIDE tables thus take
2 * SIDE * WIDTH minhashes. Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import Salt, Scratch, components, join_checked, join_counted

SHINGLE = 5
#: A pair at similarity s meets in a table with probability (1 - (1 - s**WIDTH)**SIDE)**2: 0.99998 at 0.85, 0.9994 at 0.8.
SIDE, WIDTH = 16, 4
#: Rounds that compare a bucket's documents with one of them, before those left apart are compared pair by pair.
STAR_ROUNDS = 2
#: Shingles and documents of a tile's side in the last round.
TILE_SHINGLES, TILE_DOCS = 300_000, 500
_ROWS = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole sequence as one."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def words_lowered(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes methods know just these letters and the six spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash_family(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def sub_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 2 * SIDE sub-keys of a non-empty shingle set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _ROWS):
        np.minimum(low, (shingles[at : at + _ROWS, None] * a + b).min(axis=0), out=low)
    out = np.zeros(2 * SIDE, dtype=np.uint64)
    for column in low.reshape(2 * SIDE, WIDTH).T:
        out = _mixed(out * np.uint64(31) + column)
    return out


def signatures(docs: DataFrame, kind: str) -> DataFrame:
    """_id, n (shingles), class (digest of the word sequence; null without words), keys (sub-keys) of (_id, _text)."""
    a, b = _hash_family(2 * SIDE * WIDTH)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, classes, keys = [], [], []
            for text in batch._text:
                words = words_lowered(text)
                s = shingle_set(words)
                n.append(len(s))
                classes.append(xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None)
                keys.append(sub_keys(s, a, b).view(np.int64) if words else None)
            yield pd.DataFrame({"_id": batch._id, "n": n, "class": classes, "keys": keys})

    return docs.mapInPandas(sign, f"_id {kind}, n long, class string, keys array<long>")


def _live(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, left, right): documents that share a sub-key of either collection with another one, and those sub-keys."""
    sub = classes.select("id", "n", F.posexplode("keys").alias("slot", "sub")).withColumn("hash", F.xxhash64("slot", "sub"))
    shared = sub.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    live = join_counted(sub, shared, ["hash"], scratch, "left_semi")
    side = lambda left: F.collect_list(F.when(F.col("slot") < SIDE if left else F.col("slot") >= SIDE, F.col("hash")))
    both = live.groupBy("id", "n").agg(side(True).alias("left"), side(False).alias("right"))
    return both.where((F.size("left") > 0) & (F.size("right") > 0))


def _table_keys(live: DataFrame) -> DataFrame:
    """(key, id, n): the tensored keys, one for each pair of a left and a right sub-key."""
    return live.select("id", "n", "right", F.explode("left").alias("l")).select("id", "n", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id", "n")


def _shingle_sets(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(_id, text, n, s): full shingle sets of the documents in ``ids``, one per text, told apart by a hash, and their size."""
    texts = join_checked(docs, ids, "_id", "left_semi").groupBy("_id", F.xxhash64("_text").alias("text")).agg(F.first("_text").alias("_text"))

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                sets = [shingle_set(words_lowered(t)).view(np.int64) for t in part._text]
                yield pd.DataFrame({"_id": part._id, "text": part.text, "n": [len(s) for s in sets], "s": sets})

    return texts.mapInPandas(shingled, f"_id {kind}, text long, n int, s array<long>")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """Ids of which enough shingles stand in another candidate: what only one has can't be common to two.

    This bound is exact and spares documents that merely share a passage from being compared with each other.
    """
    alone = sets.select("_id", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("_id").alias("_id")).where("c = 1")
    own = alone.groupBy("_id").agg(F.count("*").alias("own"))
    n = sets.groupBy("_id").agg(F.max("n").alias("n"), F.count("*").alias("texts"))
    enough = 100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")
    return n.join(own, "_id", "left").where(enough | (F.col("texts") > 1)).select("_id")


def _rarest(sets: DataFrame, some: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, n, s): of each document in ``some`` as many of its rarest shingles as two linked ones can't both do without.

    Documents that have ``percent`` of their union in common share one of these (prefix filter, with shingles ordered
    by the number of these documents that have them).
    """
    e = scratch.write(join_checked(sets, some, "_id", "left_semi")).select("_id", "text", "n", F.explode("s").alias("s"))
    often = e.groupBy("s").agg(F.count("*").alias("c")).withColumn("often", F.col("c"))
    ordered = join_counted(e, often, ["s"], scratch).groupBy("_id", "text", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("o"))
    keep = F.col("n") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1
    return ordered.select(F.col("_id").alias("id"), "n", F.explode(F.slice("o", 1, keep)).alias("o")).where("o.often > 1").select("id", "n", "o.s")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least ``percent`` of their union in common."""
    of = lambda name: sets.select(F.col("_id").alias(name), F.col("s").alias(f"s{name}"))
    a, b = Salt(pairs, "a", scratch), Salt(pairs, "b", scratch)
    both = a.deal(b.deal(pairs)).join(b.copies(of("b")), ["b", b.name]).join(a.copies(of("a")), ["a", a.name])
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    linked = both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
    return scratch.write(linked.select("a", "b").distinct())


def _in_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` (with id) with comp, their component so far."""
    if comps is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _link_tile(tile: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join components, between the documents of a tile's two sides (of one, if they are the same)."""
    rows = tile[tile.chunk == tile.lo].reset_index(drop=True)
    cols = rows if (tile.lo == tile.hi).all() else tile[tile.chunk == tile.hi].reset_index(drop=True)
    n_rows, n_cols = rows.s.str.len().to_numpy(), cols.s.str.len().to_numpy()
    words, at = np.unique(np.concatenate([*rows.s, *cols.s]), return_inverse=True)
    split = int(n_rows.sum())
    row_of, col_of = np.repeat(np.arange(len(rows)), n_rows), np.repeat(np.arange(len(cols)), n_cols)
    common = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for low in range(0, len(words), 4096):
        x, y = np.zeros((len(rows), 4096), dtype=np.float32), np.zeros((len(cols), 4096), dtype=np.float32)
        here, there = np.flatnonzero((at[:split] >> 12) == low >> 12), np.flatnonzero((at[split:] >> 12) == low >> 12)
        if len(here) and len(there):
            x[row_of[here], at[:split][here] - low] = 1
            y[col_of[there], at[split:][there] - low] = 1
            common += x @ y.T
    linked = 100 * common >= percent * (n_rows[:, None] + n_cols[None, :] - common)
    linked &= rows.comp.to_numpy()[:, None] != cols.comp.to_numpy()[None, :]
    root: dict = {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i]):
            p, q = find(rows.comp[i]), find(cols.comp[j])
            if p != q:
                root[p] = q
                out.append((rows.id[i], cols.id[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _mixed_keys(placed: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Rows of ``placed`` (id, comp, keys) whose key documents of several components share, with first, the key's least id."""
    mixed = placed.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("first"), F.count("*").alias("c")).where("lo <> hi")
    return join_counted(placed, mixed.drop("lo", "hi"), keys, scratch)


def _grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, group) of the documents that ``first`` ties together."""
    edges = rows.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    return components(edges, scratch).withColumnRenamed("component", "group")


def _rest(members: DataFrame, comps: DataFrame | None, sets: DataFrame, kind: str, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components, from all pairs of documents that share a table and one of their rarest shingles.

    Tables whose members are in several components tie these into groups, and inside a group shared rarest shingles tie
    its documents into smaller ones, which are cut into tiles of bounded size. A tile compares its documents by a matrix
    product and returns no more links than it joins components.
    """
    tables = scratch.write(_mixed_keys(_in_components(members, comps), ["key"], scratch).select("id", "comp", "first"))
    meeting = scratch.write(_grouped(tables, scratch).join(tables.groupBy("id").agg(F.first("comp").alias("comp")), "id"))
    rare = _rarest(sets, meeting.select(F.col("id").alias("_id")), percent, scratch).join(meeting, "id")
    left = scratch.write(_mixed_keys(scratch.write(rare), ["group", "s"], scratch).select("id", "n", "comp", "first"))
    nodes = left.groupBy("id").agg(F.max("n").alias("n"), F.first("comp").alias("comp"))
    grouped = nodes.join(_grouped(left, scratch), "id")
    parts = grouped.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_DOCS)).alias("parts"), F.count("*").alias("c"))
    chunked = join_counted(grouped, parts, ["group"], scratch).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiled = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiled = tiled.select("group", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "id", "comp")
    whole = tiled.join(sets.select(F.col("_id").alias("id"), "s"), "id")
    return scratch.write(whole.groupBy("group", "lo", "hi").applyInPandas(lambda tile: _link_tile(tile, percent), f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Linked are documents with 100 * intersection >= percent * union of their 5-word shingle sets (words as in
    ``words_lowered``; shorter texts are one shingle). component_id is the smallest id reachable by links. kept is
    true for that id's row. Texts without words link with nothing. Equal word sequences are one node from the start,
    so copies are never paired. Candidates are documents that share a table; those of which too few shingles stand in any
    other one are put aside. A table's documents are compared with one of them, twice; where they are still in different
    components, all that share one of their rarest shingles are compared pair by pair, so no link between documents of a
    table is lost.
    Rows of one id are one node with the links of all its texts (kept is then true for each); rows without an id stand
    alone with null component_id, kept. An empty table gives no rows. Only id and text are read.
    """
    kind = dict(docs.dtypes)[doc_id]
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text"))
    signed = scratch.write(signatures(rows, kind))
    classes = scratch.write(signed.where("class is not null and _id is not null").groupBy("class").agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("c")))
    live = scratch.write(_live(classes, scratch))
    sets = scratch.write(_shingle_sets(rows, live.select(F.col("id").alias("_id")).distinct(), kind))
    fit = scratch.write(_linkable(sets, percent))
    keyed = _table_keys(join_checked(live, fit.withColumnRenamed("_id", "id"), "id", "left_semi"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.write(join_counted(keyed, shared, ["key"], scratch, "left_semi"))
    # one id may stand for several classes and a class for several ids: tie them
    same = signed.where("class is not null and _id is not null").select("_id", "class").distinct().groupBy("_id").agg(F.count("*").alias("c"), F.collect_set("class").alias("classes")).where("c > 1")
    links = scratch.write(same.select("_id", F.explode("classes").alias("class")).join(classes.select("class", "id"), "class").select(F.col("_id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    comps = components(links, scratch) if not links.isEmpty() else None
    tested = None

    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes further apart can't link
    for turn in range(STAR_ROUNDS):
        placed = _in_components(members, comps)
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        tops = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("id", "n", "comp"), F.struct(order, "id")).alias("top"), F.count("*").alias("c")).where("lo <> hi")
        met = join_counted(placed, tops.select("key", "top", "c"), ["key"], scratch).where("comp <> top.comp").where(alike(F.col("n"), F.col("top.n")))
        pairs = met.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct()
        pairs = scratch.write(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        found = _confirmed(pairs, sets, percent, scratch)
        tested = pairs if tested is None else tested.union(pairs)
        if not found.isEmpty():
            links = links.union(found)
            comps = components(links, scratch)
    found = _rest(members, comps, sets, kind, percent, scratch)
    if not found.isEmpty():
        comps = components(links.union(found), scratch)

    if comps is not None:
        classes = classes.join(comps, "id", "left").select("class", F.coalesce("component", "id").alias("component"), "c")
    else:
        classes = classes.select("class", F.col("id").alias("component"), "c")
    # texts without words have no class, and none of them is joined
    out = join_counted(signed.where("class is not null").select("_id", "n", "class"), classes, ["class"], scratch, "left")
    out = out.unionByName(signed.where("class is null").select("_id", "n", "class", F.lit(None).cast(kind).alias("component")))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose id another of its component precedes; repeated rows of the kept id all stay.

    Rows without an id and texts without words stay; columns keep their names, whatever these are.
    """
    judged = near_duplicates(docs, doc_id, text, percent)
    scratch = Scratch(docs.sparkSession, "minhash")
    gone = scratch.write(judged.where("not kept").select(F.col(doc_id).alias("id")).distinct())
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"))
    return join_checked(whole, gone, "id", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
