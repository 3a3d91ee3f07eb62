"""Sets chained into families by the keys they share, and large families chained anew in an exact order of keys.

The order in ``rarity`` counts keys in a fixed table of cells. The more keys share a cell, the less it tells: keys that sets have in
common by chance come among the first, and chain them into ever larger families. So the sets of families over ``LARGE`` post
all their keys once more. A bucket counts its keys exactly, and tells each flush of a task which of its keys others have too;
the flush takes the rarest of each owner. A key that only one owner has comes first in the order and is never posted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .ragged import U, mix, packed, unpacked

LARGE = 512                # sets of a family from which its keys are counted exactly
KEYS = 1 << 20             # keys a task sorts at once
BUCKET_KEYS = 1 << 20      # keys that meet in one reducer, about
BROADCAST_ROWS = 500_000   # rows (8 bytes each) up to which they are broadcast

POSTED = "bucket int, keys binary, owner binary, classes binary, edges binary"


def _led(keys: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (key, class) for each key, and edges from the other classes under that key to it."""
    order = np.lexsort((cls, keys))
    keys, cls = keys[order], cls[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    lead = cls[np.flatnonzero(first)[first.cumsum() - 1]] if len(cls) else cls
    pairs = np.unique(np.stack([cls, lead], 1)[cls != lead], axis=0)
    return keys[first], cls[first], pairs


def _meet(table: pa.Table) -> pa.Table:
    keys, cls, pairs = [], [], []
    for k, o, c, e in zip(*(table.column(x).to_pylist() for x in ("keys", "owner", "classes", "edges")), strict=True):
        keys.append(np.frombuffer(k, U))
        cls.append(np.frombuffer(c, np.int64)[np.frombuffer(o, np.uint32)])
        pairs.append(np.frombuffer(e, np.int64).reshape(-1, 2))
    pairs.append(_led(np.concatenate(keys), np.concatenate(cls))[2])
    edges = np.unique(np.concatenate(pairs), axis=0)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def _sorted_by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and key, bounds of the buckets in it)."""
    bucket = ((mix(keys) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _dealt(batches, owned, buckets):
    """Rows (bucket, flush, keys, owner, table) of all keys; one of each flush holds its table of owners (class, keep, filled)."""
    held: list[tuple] = []
    flushes = 0

    def flush():
        nonlocal flushes
        first = np.cumsum([0] + [len(h[3]) for h in held])
        keys, last = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        owner = np.concatenate([h[0] + n for h, n in zip(held, first[:-1], strict=True)])
        table = np.concatenate([h[3] for h in held])
        held.clear()
        table = np.column_stack([table, np.bincount(owner[~last], minlength=len(table))]).astype(np.int64)
        name = TaskContext.get().partitionId() << 32 | flushes
        flushes += 1
        order, cut = _sorted_by_bucket(keys, buckets)
        keys, owner = keys[order], (2 * owner + last)[order]
        rows = [(int(b), packed(np.diff(keys[cut[b]:cut[b + 1]], prepend=U(0))), packed(owner[cut[b]:cut[b + 1]]), b"") for b in np.flatnonzero(np.diff(cut))]
        rows.append((name % buckets, b"", b"", table.tobytes()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                               names=["bucket", "flush", "keys", "owner", "table"])

    n = 0
    for found in owned(batches):
        held.append(found)
        n += len(found[1])
        if n >= KEYS:
            yield flush()
            n = 0
    if n:
        yield flush()


def _repeated(table: pa.Table) -> pa.Table:
    """Of each flush, the keys of this bucket that other owners have too, with the number of owners."""
    rows = []
    flush, keys, owner, tables = (table.column(x).to_pylist() for x in ("flush", "keys", "owner", "table"))
    lists = [unpacked(k).astype(U).cumsum(dtype=U) if k else np.empty(0, U) for k in keys]
    _, back, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    lo = 0
    for f, mine, o, t in zip(flush, lists, owner, tables, strict=True):
        n = times[back[lo:lo + len(mine)]]
        lo += len(mine)
        some = n > 1
        if t:
            rows.append((f, b"", b"", b"", t))
        elif some.any():
            rows.append((f, packed(np.diff(mine[some], prepend=U(0))), packed(unpacked(o)[some]), packed(n[some]), b""))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))],
                    names=["flush", "keys", "owner", "times", "table"])


def first_keys(owner: np.ndarray, key: np.ndarray, times: np.ndarray, last: np.ndarray, keep: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Indices of the keys among the ``keep[o]`` first of each owner ``o``, in the order (last, times, key). Of its ``filled[o]`` keys
    that are not ``last``, those that are not given are its own alone, and come first."""
    order = np.lexsort((key, times, last, owner))
    start = np.searchsorted(owner[order], np.arange(len(keep)))
    alone = filled - np.bincount(owner[~last], minlength=len(keep))
    mine = owner[order]
    return order[np.arange(len(order)) - start[mine] + alone[mine] < keep[mine]]


def _chosen(table: pa.Table, buckets: int) -> pa.Table:
    """Rows (bucket, keys, owner, classes, edges) of the rarest keys of a flush's owners: each key once, with one class."""
    keys, owner, times, info = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], None
    for k, o, n, t in zip(*(table.column(x).to_pylist() for x in ("keys", "owner", "times", "table")), strict=True):
        if t:
            info = np.frombuffer(t, np.int64).reshape(-1, 3)
        else:
            keys.append(unpacked(k).astype(U).cumsum(dtype=U))
            owner.append(unpacked(o))
            times.append(unpacked(n))
    key, owner = np.concatenate(keys), np.concatenate(owner)
    some = first_keys(owner >> 1, key, np.concatenate(times), (owner & 1).astype(bool), info[:, 1], info[:, 2])
    key, cls, pairs = _led(key[some], info[owner[some] >> 1, 0])
    order, cut = _sorted_by_bucket(key, buckets)
    key, cls, share, rows = key[order], cls[order], np.array_split(pairs, buckets), []
    for b in range(buckets):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo or len(share[b]):
            used, local = np.unique(cls[lo:hi], return_inverse=True)
            rows.append((b, key[lo:hi].tobytes(), local.astype(np.uint32).tobytes(), used.tobytes(), share[b].tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
                    names=["bucket", "keys", "owner", "classes", "edges"])


def exact_edges(rows: DataFrame, owned: Callable, buckets: int) -> DataFrame:
    """(a, b): classes that share one of the rarest keys of each, by exact counts over ``rows``.

    ``owned`` turns a task's Arrow batches into (owner, key, last, table), where ``owner`` counts the rows (class, keep) of ``table``.
    An owner looks for others by its ``keep`` first keys; those marked ``last`` come after all others."""
    dealt = rows.mapInArrow(partial(_dealt, owned=owned, buckets=buckets), "bucket int, flush long, keys binary, owner binary, table binary")
    known = dealt.groupBy("bucket").applyInArrow(_repeated, "flush long, keys binary, owner binary, times binary, table binary")
    posted = known.groupBy("flush").applyInArrow(lambda table: _chosen(table, buckets), POSTED)
    return posted.groupBy("bucket").applyInArrow(_meet, "a long, b long")


def refined(families: DataFrame, rows: DataFrame, owned: Callable, keys: int, purpose: str) -> DataFrame:
    """``families`` (node, root), those of more than ``LARGE`` nodes chained anew by exact counts of the keys of ``rows`` (cls, ...).
    Nodes that then share no key with any other are left out. ``keys``: how many a row has, about."""
    large = families.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("root")
    many = written(families.join(large, "root").select(F.col("node").alias("cls"), "root"), f"{purpose}-large")
    n = many.count()
    if not n:
        return families
    nodes = many.select("cls")
    mine = rows.join(F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes, "cls", "left_semi")
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * keys // BUCKET_KEYS + 1)
    again = components(exact_edges(mine, owned, buckets), purpose)
    return families.join(many.select("root").distinct(), "root", "left_anti").select("node", "root").unionByName(again)
