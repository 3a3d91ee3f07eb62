"""Block scans against plain replay, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from talkweave.operators.ordered import Fold, Scan, block_scan, blocks_of, numbered, previous, sorted_fold


def data(seed, n=400):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"), i, rng.choice([None, rng.randrange(-20, 20)])) for i in range(n)]


def replay(rows, kind, inclusive, reverse):
    out = {}
    for key in {r[0] for r in rows}:
        state = None
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=reverse)
        for _, o, v in mine:
            def step(s):
                if v is None:
                    return s
                return {"sum": (s or 0) + v, "max": v if s is None else max(s, v), "min": v if s is None else min(s, v), "last": v}[kind]
            after = step(state)
            seen = after if inclusive else state
            out[o] = (seen or 0) if kind == "sum" else seen
            state = after
    return out


@pytest.mark.parametrize("width", [7, 1000])
def test_every_kind_and_direction(spark, width):
    rows = data(width)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    cases = [(kind, inc, rev) for kind in ("sum", "max", "min", "last") for inc in (True, False) for rev in (True, False)]
    scans = [Scan(f"c{i}", kind, F.col("v"), inc, rev) for i, (kind, inc, rev) in enumerate(cases)]
    got = block_scan(df, ["k"], ["o"], scans, blocks_of(F.col("o"), width)).collect()
    assert len(got) == len(rows)
    for i, case in enumerate(cases):
        want = replay(rows, *case)
        assert {r.o: r[f"c{i}"] for r in got} == want, case


def test_previous_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 9, None), ("a", 10, 7)], "k string, o int, v int")
    got = block_scan(df, ["k"], ["o"], [previous("p", F.col("v"))], blocks_of(F.col("o"), 4)).orderBy("o").collect()
    assert [(r.p is None, None if r.p is None else r.p.v) for r in got] == [(True, None), (False, None), (False, 5), (False, None)]


def test_hot_key_spreads_over_tasks(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    out = numbered(df, ["k"], ["o"], "n", blocks_of(F.col("o"), 500))
    assert out.where("n <> o + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in numbered(df, ["k"], ["o"], "n", blocks_of(F.col("o"), 500)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and max(sizes) < 10000


def test_a_fold_sees_a_key_whole_after_a_join_that_turns_into_a_broadcast(spark):
    class Places(Fold):
        def __init__(self):
            self.n = 0

        def push(self, row):
            self.n += 1
            return [(row.k, row.o, self.n)]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20000, 1, 4).select((F.col("id") % 50).alias("k"), F.col("id").alias("o"))
        some = spark.range(0, 400, 1, 4).select((F.col("id") % 50).alias("k")).where("k % 2 = 0").distinct()
        out = sorted_fold(df.join(some, ["k"], "left_semi"), ["k"], ["o"], Places, "k bigint, o bigint, n bigint").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 10000 and all(r.n == r.o // 50 + 1 for r in out)
