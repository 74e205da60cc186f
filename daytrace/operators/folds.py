"""Folds whose state depends on order: rows of a key pass one by one, in batches, and only the state is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.session import ship


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, begin: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], end: Callable[[tuple, Any], Iterable[tuple]] = lambda key, state: ()) -> DataFrame:
    """``step(state, row)`` for each row of each key in order, and ``end(key, state)`` after its last; the tuples that they give, in ``schema``.

    Keys are dealt over tasks and sorted there, which spills where it must; a task holds one batch and one state at a
    time, however many rows a key has. They are dealt by their hash: Spark leaves out a repartition by columns that a join
    or an aggregate below has dealt by already, and may then read that one's shuffle in other parts, as nothing above
    asks for whole keys.
    """
    ship(df.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(None if pd.isna(v := getattr(row, k)) else v for k in keys)
                if state is None or key != now:
                    if state is not None:
                        out.extend(end(now, state))
                    now, state = key, begin()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if state is not None and (out := list(end(now, state))):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
