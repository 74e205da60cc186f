"""Byte-level BPE by a two-tier lookup.

A text is cut into pre-tokens. The first tier is a minimal perfect hash of the vocabulary: it names the only token that a
pre-token can be, and a comparison decides; hashes of a block's new pre-tokens are looked up at once. A pre-token that is
no token goes to the second tier, which merges its bytes: a linked list of pieces, and a heap of the pairs that are tokens
by rank. What was found is kept while a process works, up to a bound, as most pre-tokens come again.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from daytrace.session import ship

#: White space of Unicode, as patterns for the pre-tokens define it (Python's own \s has four more).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs without white space, with a space before them, and runs of white space.
SPACED = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: Cuts that a process remembers; beyond it only those of the texts at hand stay.
REMEMBERED = 400_000
#: Characters and documents per piece of a batch.
PIECE_CHARS, PIECE_ROWS = 2_000_000, 1000
#: Bits per key of the perfect hash's levels.
ROOM = 2.0


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def _mixed(digests: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash for each level."""
    x = digests + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: n keys to the numbers 0 to n - 1, by levels of bits (Limasset et al. 2017).

    Each level has a bit for a place that just one of the keys left falls on; keys that share a place go to the next. A
    key's number is how many bits are set before its own. Other keys get some number, or -1.
    """

    def __init__(self, digests: np.ndarray):
        if len(np.unique(digests)) < len(digests):
            raise ValueError("two keys have one digest")
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = digests, 0
        while len(left):
            size = max(64, int(len(left) * ROOM))
            place = (_mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            left = left[~alone[place]]
        self.size = base

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, dtype=np.int64)
        rest = np.arange(len(digests))
        for level, (alone, number) in enumerate(self.levels):
            place = (_mixed(digests[rest], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[place]
            out[rest[hit]] = number[place[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging the pair of least rank, the first of equal ones, until no pair is a token."""
    n, rank_of = len(piece), ranks.get
    # pieces touch, so the next one starts where a piece ends; a start that is gone points behind all
    after, before = [*range(1, n + 1), n + 1, n + 1], [*range(-1, n + 1)]
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = after[i]
        if after[middle] != end:  # one of its pieces has grown or gone
            continue
        after[i], after[middle], before[end] = end, n + 1, i
        if end < n and (rank := rank_of(piece[i : after[end]])) is not None:
            heapq.heappush(heap, (rank, i, after[end]))
        if i and (rank := rank_of(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes texts to ids and ids to bytes by a vocabulary of ranks.

    ``coarse`` is a plainer pattern that cuts only where ``pattern`` does, so that fewer and larger cuts are looked up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, coarse: str | None = None):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks bytes {missing[:5]}")
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.cuts = re.compile(coarse) if coarse else self.pieces
        tokens = list(ranks)
        self.hash = PerfectHash(_digests(tokens))
        self.slots: list[bytes] = [b""] * len(tokens)
        for number, token in zip(self.hash(_digests(tokens)).tolist(), tokens, strict=True):
            self.slots[number] = token
        self.slot_ids = [ranks[t] for t in self.slots]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Ids of the cuts seen, as the bytes of 32-bit integers.
        self.known: dict[str, bytes] = {}

    def resolve(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: the perfect hash for all at once, then byte merges for those that are no token."""
        raw = [t.encode("utf-8", "surrogatepass") for t in pieces]
        found = zip(raw, self.hash(_digests(raw)).tolist(), strict=True)
        return [(self.slot_ids[number],) if number >= 0 and self.slots[number] == key else tuple(merge_bytes(key, self.ranks)) for key, number in found]

    def _learn(self, cuts: list[str]) -> None:
        parts = [self.pieces.findall(c) for c in cuts]
        pieces = list(set(chain.from_iterable(parts)))
        ids = dict(zip(pieces, self.resolve(pieces), strict=True))
        for cut, part in zip(cuts, parts, strict=True):
            self.known[cut] = array("i", chain.from_iterable(map(ids.__getitem__, part))).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as 32-bit integers."""
        found = [self.cuts.findall(t) for t in texts]
        every = set().union(*found)
        if new := list(every.difference(self.known)):
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {c: self.known[c] for c in every if c in self.known}
            self._learn(new)
        return (np.frombuffer(b"".join(map(self.known.__getitem__, f)), dtype=np.int32) for f in found)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: The codec of the last vocabulary that this process had: tasks that follow each other in it share what it knows.
_LAST: list[tuple[str, Codec]] = []


def _codec(key: str, shared) -> Codec:
    if not _LAST or _LAST[0][0] != key:
        _LAST[:] = [(key, Codec(*shared.value))]
    return _LAST[0][1]


def _pieces(batch: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PIECE_ROWS rows and about PIECE_CHARS of size each; a larger row is one of its own."""
    start, total = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > start and (total + n > PIECE_CHARS or k - start >= PIECE_ROWS):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], [*kept, name])


def _mapped(df: DataFrame, settings: tuple, column: str, name: str, kind: str, size, convert) -> DataFrame:
    """``df`` with column ``name``: what ``convert(codec, values of column)`` gives, by slices of bounded size."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(settings)
    key = xxhash.xxh3_128_hexdigest(repr(settings).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            for part in _pieces(batch, np.asarray(pc.fill_null(size(batch.column(column)), 0))):
                yield _with(part, name, convert(codec, part.column(column)))

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema if f.name != name)
    return df.mapInArrow(run, f"{fields}`{name}` {kind}")


def _encoded(codec: Codec, texts: pa.Array) -> pa.Array:
    every = list(codec.encode(["" if t is None else t for t in texts.to_pylist()]))
    ends = np.cumsum([0, *map(len, every)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every) if every else np.zeros(0, dtype=np.int32)))


def _decoded(codec: Codec, ids: pa.Array) -> pa.Array:
    flat, ends = ids.flatten().to_numpy().tolist(), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0))).tolist()
    valid = ids.is_valid().to_pylist()
    return pa.array([codec.decode(flat[a:b]) if v else None for a, b, v in zip([0, *ends], ends, valid, strict=False)], pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, coarse: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text`` in column ``ids``, which replaces a column of that name.

    ``pattern`` cuts a text into pre-tokens, each encoded by itself; ``coarse`` may name a plainer one that cuts only
    there (SPACED for patterns whose pre-tokens are runs without white space behind one space at most, and runs of white
    space). No special tokens. A null or empty text has an empty array. Whole texts are encoded, a pre-token of any length
    too. Rows stay as they are, repeated ones too; an empty table gives no rows; columns of other names pass through. The
    vocabulary, which does not grow with the data, goes to every task; it must hold all single bytes.
    """
    return _mapped(docs, (ranks, pattern, coarse), text, ids, "array<int>", pc.utf8_length, _encoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its token ids in column ``decoded``. A null array has null; an unknown id is an error."""
    return _mapped(encoded, (ranks, ""), ids, decoded, "binary", pc.list_value_length, _decoded)
