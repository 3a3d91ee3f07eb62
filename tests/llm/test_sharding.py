import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from talkweave.llm.sharding import hash_tree_shard, shard_by_tree


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*parts):
    """xxhash64 of several columns: each one's hash seeds the next; ints take four bytes, longs eight."""
    seed = 42
    for kind, v in parts:
        if v is not None:
            seed = xxhash.xxh64(v.to_bytes(kind, "little", signed=True), seed=seed).intdigest()
    return seed


def pick(head, path, fan, weights):
    best = None
    for child in range(fan):
        w = weights.get((*path, child), 1.0)
        u = ((chain(*head, *((4, p) for p in path), (4, child)) >> 11) + 0.5) / 2 ** 53
        wait = -math.log(u) / w if w > 0 else math.inf
        if best is None or (wait, child) < best:
            best = (wait, child)
    return best[1]


def place(key, shards):
    for t in range(10000):
        head = [(8, key), (4, t)]
        region = pick(head, (), 4, {})
        rack = pick(head, (region,), 4, {})
        at = region + 4 * (rack + 4 * pick(head, (region, rack), 4, {}))
        if at < shards:
            return at
    raise AssertionError


def shards_of(spark, n, shards, weights=None):
    return {r.id: r.s for r in spark.range(n).select("id", hash_tree_shard(F.col("id"), shards, weights).alias("s")).collect()}


@pytest.mark.parametrize("shards", [2, 5, 16, 40, 63])
def test_equals_brute_force_and_grows_into_the_new_shard_only(spark, shards):
    n = 600
    now, grown = shards_of(spark, n, shards), shards_of(spark, n, shards + 1)
    assert all(now[k] == place(k, shards) for k in range(0, n, 7))
    assert set(now.values()) <= set(range(shards))
    assert all(now[k] == grown[k] or grown[k] == shards for k in range(n))
    assert any(now[k] != grown[k] for k in range(n))


def test_even_and_weighted(spark):
    n = 20000
    count = Counter(shards_of(spark, n, 40).values())
    assert len(count) == 40 and max(count.values()) < 1.35 * n / 40 and min(count.values()) > 0.65 * n / 40
    before, after = shards_of(spark, n, 64), shards_of(spark, n, 64, {(1, 2): 3.0})
    moved = [k for k in range(n) if before[k] != after[k]]
    assert moved and all(before[k] % 4 == 1 == after[k] % 4 for k in moved)                 # only inside region 1
    assert all(after[k] // 4 % 4 == 2 for k in moved)                                       # only into its rack 2
    assert all(v % 4 != 3 for v in shards_of(spark, 500, 64, {(3,): 0.0}).values())


def test_rows(spark, documents):
    rows = [(k, f"text é {k}") for k in range(300)] + [(5, "text é 5"), (5, "text é 5"), (None, "a"), (None, None), (400, ""), (401, "x" * 100000)]
    got = shard_by_tree(documents(rows), 40).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 40) for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert shard_by_tree(documents([]), 40).collect() == []
    with pytest.raises(ValueError):
        shard_by_tree(documents([]), 0)
    with pytest.raises(ValueError):
        shard_by_tree(documents([]), 64)
