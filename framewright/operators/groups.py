"""Order-dependent kernels on many small groups: one sorted pass per partition instead of one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``kernel`` gets the rows of each group (named tuples, in ``order``) and gives the rows of the result.

    Groups are bounded by nature (see each kernel). Partitions are hash-dealt by key and sorted by Spark, which spills; the
    pass holds one group at a time, so thousands of groups cost no more than their rows."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for batch in batches:
            at = [batch.columns.get_loc(k) for k in keys]
            for row in batch.itertuples(index=False):
                own = tuple(row[i] for i in at)
                if own != key:
                    if rows:
                        out += kernel(rows)
                    key, rows = own, []
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rows and (out := kernel(rows)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Walk(Protocol):
    """A kernel over one group's rows as they pass in order; it holds only what later rows can still reach."""

    def push(self, row) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


def walked(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Walk], schema: str) -> DataFrame:
    """Like :func:`by_group`, for kernels that let go of rows: a group of any length passes in bounded memory."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, walk = None, None
        for batch in batches:
            at, out = [batch.columns.get_loc(k) for k in keys], []
            for row in batch.itertuples(index=False):
                own = tuple(row[i] for i in at)
                if own != key:
                    if walk is not None:
                        out += walk.end()
                    key, walk = own, start()
                out += walk.push(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if walk is not None and (out := walk.end()):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
