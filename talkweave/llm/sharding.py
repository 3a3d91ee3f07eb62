"""Shards by a hierarchical weighted hash tree: region, rack, shard. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHAPE = (4, 4, 4)  # regions, racks of a region, shard places of a rack
BUCKETS = 4096     # parts in which the rows of a shard are numbered

Weights = dict[tuple[int, ...], float]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _pick(key: list[Column], path: list[Column], fan: int, weights: Weights) -> Column:
    """The child with the smallest weighted draw: each child's draw depends on the row, the path and the child alone,
    so a changed weight moves rows only to or from that child."""
    draws = []
    for child in range(fan):
        bits = F.shiftrightunsigned(F.xxhash64(*key, *path, F.lit(child)), 11)
        weight = F.lit(1.0)
        for node, w in sorted(weights.items()):
            if len(node) == len(path) + 1 and node[-1] == child:
                here = F.lit(True)
                for column, step in zip(path, node, strict=False):
                    here = here & (column == step)
                weight = F.when(here, F.lit(float(w))).otherwise(weight)
        wait = -F.log((bits.cast("double") + 0.5) / F.lit(2.0 ** 53))
        draws.append(F.struct(F.when(weight > 0, wait / weight).otherwise(F.lit(float("inf"))).alias("wait"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _descend(key: list[Column], shape: tuple[int, int, int], weights: Weights) -> Column:
    """The place a row falls to, level by level: place s of rack k of region r is number r + regions * (k + racks * s)."""
    regions, racks, places = shape
    return _bound(_pick(key, [], regions, weights), lambda r: _bound(
        _pick(key, [r], racks, weights), lambda k: r + regions * (k + racks * _pick(key, [r, k], places, weights))))


def hash_tree_shard(key: Column, shards: int, weights: Weights | None = None, shape: tuple[int, int, int] = SHAPE) -> Column:
    """The shard, 0 to ``shards`` - 1, of a row with this key.

    The tree has a fixed number of places, of which the first ``shards`` are in use, spread evenly over regions and racks.
    A row descends it and draws again when it falls to a place not in use. So one more shard takes rows from all shards
    into itself and moves no other row. ``weights``: weight of a region (r,), rack (r, k) or place (r, k, s) against its
    siblings, 1 where not named. A change moves only rows that pass through the parent of the changed node; with all
    places in use they stay below that parent. A null key is a key like any other. More shards than places are an error:
    ``shape`` is part of the law and is chosen with room to grow.
    """
    size = shape[0] * shape[1] * shape[2]
    if not 1 <= shards <= size:
        raise ValueError(f"shards must be 1 to {size}")
    if shards == 1:
        return F.lit(0)
    tries = 1 if shards == size else 40 * size // shards        # all of them miss with a chance of exp(-40)

    def attempt(found: Column, t: Column) -> Column:
        return F.when(found >= 0, found).otherwise(
            _bound(_descend([key, t], shape, weights or {}), lambda at: F.when(at < shards, at).otherwise(F.lit(-1))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(-1), attempt)


def shard_by_tree(docs: DataFrame, shards: int = 40, weights: Weights | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``: size is the text's UTF-8 bytes plus 16,
    shard follows ``hash_tree_shard`` of the doc_id (law ``key``), grown_shard the same with one more shard.

    Rows of a shard are numbered without gaps from 0: bucket by bucket of a hash, then by doc_id and text sum, so that no
    task sees a whole shard. Null text counts as empty; rows with a null doc_id share a shard; repeated rows get slots
    of their own. An empty table gives an empty result.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    placed = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                         hash_tree_shard(F.col("doc_id"), shards, weights).alias("shard"),
                         hash_tree_shard(F.col("doc_id"), shards + 1, weights).alias("grown_shard"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "bucket").count()
              .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("nth", F.row_number().over(inside)).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"))
