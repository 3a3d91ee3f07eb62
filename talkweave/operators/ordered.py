"""Ordered computations that do not put a whole key into one task.

A running sum, a carried-forward value or a look-back over ``(key, order)`` normally means one sort task per
key. Here the order is cut into blocks: every block is summarised (with partial aggregation), the few block
summaries are scanned per key, and each block then only needs the value carried in from the left. A key that
holds a large part of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

_BLOCK = "__block"


@dataclass(frozen=True)
class Scan:
    """One running value. ``kind``: sum, max, min, or last (nearest non-null value). ``reverse`` runs from the end."""

    out: str
    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def previous(out: str, value: Column, reverse: bool = False) -> Scan:
    """Value of the neighbouring row, null included; read it as ``col(out).v``."""
    return Scan(out, "last", F.struct(value.alias("v")), inclusive=False, reverse=reverse)


def blocks_of(order: Column, width: float) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def block_scan(df: DataFrame, keys: list[str], order: list[str], scans: Iterable[Scan], block: Column) -> DataFrame:
    """Add every scan's column. ``order`` must be unique per key; ``block`` must not decrease along it."""
    scans = list(scans)
    position = F.struct(*order)
    part = [*keys, _BLOCK]

    blocked = df.select("*", block.alias(_BLOCK), *[s.value.alias(f"__v{i}") for i, s in enumerate(scans)])

    def summary(i: int, s: Scan) -> Column:
        v = F.col(f"__v{i}")
        if s.kind == "last":
            return (F.min_by if s.reverse else F.max_by)(v, F.when(v.isNotNull(), position))
        return _AGGREGATES[s.kind](v)

    def over(s: Scan, c: Column, w) -> Column:
        return (F.last(c, ignorenulls=True) if s.kind == "last" else _AGGREGATES[s.kind](c)).over(w)

    def arranged(columns: list[str], by: list[str], s: Scan):
        return Window.partitionBy(*by).orderBy(*[F.col(c).desc() if s.reverse else F.col(c).asc() for c in columns])

    totals = blocked.groupBy(*part).agg(*[summary(i, s).alias(f"__t{i}") for i, s in enumerate(scans)])
    carries = totals.select(*part, *[
        over(s, F.col(f"__t{i}"), arranged([_BLOCK], keys, s).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__c{i}")
        for i, s in enumerate(scans)])

    def combine(i: int, s: Scan) -> Column:
        w = arranged(order, part, s).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        local, carry = over(s, F.col(f"__v{i}"), w), F.col(f"__c{i}")
        if s.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return {"max": F.greatest, "min": F.least, "last": F.coalesce}[s.kind](local, carry)

    joined = blocked.join(carries, part)
    return joined.select(*df.columns, *[combine(i, s).alias(s.out) for i, s in enumerate(scans)])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, block: Column) -> DataFrame:
    """1-based position within the key."""
    return block_scan(df, keys, order, [Scan(out, "sum", F.lit(1).cast("bigint"))], block)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str],
                folder: Callable[[], "Fold"], schema: str) -> DataFrame:
    """Feed each key's rows, in order, through a small state machine.

    For recurrences with no closed form. Rows stream through in Arrow batches out of Spark's own spilling sort,
    so memory holds one state, never one group.
    """
    # By a hash of the keys, not by the keys: a shuffle by the keys themselves is dropped where ``df`` comes from a join on them, and
    # a join that turns into a broadcast at run time then leaves a key's rows in several tasks.
    parts = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold, names = None, None, [f.split()[0] for f in schema.split(",")]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if fold is not None:
                        out.extend(fold.finish())
                    current, fold = key, folder()
                out.extend(fold.push(row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if fold is not None:
            tail = list(fold.finish())
            if tail:
                yield pd.DataFrame(tail, columns=names)

    return parts.mapInPandas(run, schema)


class Fold:
    """State of one key: ``push`` sees each row in order, ``finish`` closes the key. Both give output rows."""

    def push(self, row) -> Iterable[tuple]:
        raise NotImplementedError

    def finish(self) -> Iterable[tuple]:
        return ()

    def snapshot(self) -> tuple:
        """What a stream keeps between micro-batches."""
        raise NotImplementedError

    def restore(self, kept: tuple) -> None:
        raise NotImplementedError
