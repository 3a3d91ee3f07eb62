"""Overlap joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import Scan, block_scan, blocks_of

BUCKET_S = 30.0


def bucketed(df: DataFrame, start: str, end: str, first: str, bucket: str, width: float) -> DataFrame:
    lo = F.floor(F.col(start) / width)
    hi = F.floor(F.greatest(F.col(start), F.col(end)) / width)
    return df.select("*", lo.alias(first), F.explode(F.sequence(lo, hi)).alias(bucket))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str,
                  r_end: str, touching: bool = False, how: str = "inner", width: float = BUCKET_S) -> DataFrame:
    """Pairs of equal key whose intervals overlap (or at least touch). Column names must not collide.

    The join key carries a time bucket, so a long meeting is many small groups. A pair that shares several
    buckets is kept only in the first shared one. With ``how="left"`` a left row appears once per bucket it spans
    without a partner there, so aggregate by its identity.
    """
    l = bucketed(left, l_start, l_end, "__lf", "__b", width)
    renamed = [F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns]
    r = bucketed(right.select(*renamed), r_start, r_end, "__rf", "__rb", width)
    cond: Column = (F.col("__b") == F.col("__rb")) & (F.col("__b") == F.greatest("__lf", "__rf"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    if touching:
        cond = cond & (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
    else:
        cond = cond & (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    pairs = l.join(r, cond, how)
    return pairs.drop("__lf", "__rf", "__b", "__rb", *[f"__r_{k}" for k in keys])


def carried(df: DataFrame, key: list[str]) -> list[Column]:
    """The columns that depend on ``key``, to keep them through an aggregation instead of joining them back."""
    return [F.any_value(c).alias(c) for c in df.columns if c not in key]


def neighbours(points: DataFrame, at: str, spans: DataFrame, keys: list[str], start: str, end: str, last: Column,
               first: Column, width: float = 600.0) -> DataFrame:
    """Adds to each point ``before``: the greatest ``last`` of the spans ended by then, and ``after``: the least
    ``first`` of those not yet begun.

    ``last`` and ``first`` are orderable structs led by the span's end and start. Points and span edges are put on
    one time line and scanned once in each direction.
    """
    cols = points.columns
    kinds = {c: points.schema[c].dataType for c in cols if c not in keys}
    blank = [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    edges = F.array(
        F.struct(F.col(end).alias("t"), F.lit(0).alias("k"), last.alias("l"), F.lit(None).alias("f")),
        F.struct(F.col(start).alias("t"), F.lit(2).alias("k"), F.lit(None).alias("l"), first.alias("f")))
    marks = spans.select(*keys, *blank, F.inline(edges).alias("__t", "__k", "__l", "__f"))
    nothing = {c: F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ("__l", "__f")}
    asks = points.select(*keys, *kinds, F.col(at).alias("__t"), F.lit(1).alias("__k"), *nothing.values())
    both = marks.unionByName(asks)
    scans = [Scan("before", "max", F.col("__l")), Scan("after", "min", F.col("__f"), reverse=True)]
    scanned = block_scan(both, keys, ["__t", "__k"], scans, blocks_of(F.col("__t"), width))
    return scanned.where("__k = 1").select(*cols, "before", "after")
