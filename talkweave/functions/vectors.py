"""Embedding arithmetic in DOUBLE over ARRAY<FLOAT>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_from(dot_ab: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.coalesce(F.try_divide(dot_ab, norm_a * norm_b), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal-length or zero vectors."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, cosine_from(dot(a, b), norm(a), norm(b))).otherwise(F.lit(0.0))


def centroid(flat: Column, dim: Column) -> Column:
    """Mean of the ``dim``-long vectors laid end to end; unchanged if the length does not divide."""
    n = F.floor(F.try_divide(F.size(flat), dim)).cast("int")
    splits = (dim > 0) & (n > 1) & (F.size(flat) % F.nullif(dim, F.lit(0)) == 0)

    def mean_at(i: Column) -> Column:
        picks = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.get(flat, s * dim + i).cast("double"))
        return (F.aggregate(picks, F.lit(0.0), lambda acc, x: acc + x) / n).cast("float")

    pooled = F.transform(F.sequence(F.lit(0), dim - 1), mean_at)
    return F.when(F.coalesce(splits, F.lit(False)), pooled).otherwise(flat)


def common_divisor(lengths: Column) -> Column:
    """Greatest common divisor of an array of positive sizes; 0 for an empty array."""
    def step(acc: Column, n: Column) -> Column:
        top = F.when(acc == 0, n).otherwise(F.least(acc, n))
        fits = F.filter(F.sequence(F.lit(1), top), lambda d: (acc % d == 0) & (n % d == 0))
        return F.array_max(fits)

    return F.aggregate(F.filter(lengths, lambda n: n > 0), F.lit(0), step)
