import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import mining as M

SCHEMA = "vec_id long, embedding array<double>, label int, key string, rank int, width string"


def brute(rows, positives=5, negatives=10, scale=256):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    rows = sorted({(i, lab, tuple(int(np.floor(scale * x)) for x in v)) for i, v, lab in rows if i is not None and lab is not None and ok(v)})
    out = []
    for i, lab, q in rows:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, other) for j, other, p in rows if j != i and len(p) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [(s, j) for s, j, other in scored if other != lab and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.fixture
def rows():
    r = np.random.default_rng(4)
    heart = r.normal(size=(12, 16)) / 3
    out = [(k, (heart[k % 12] + r.normal(size=16) / 8).tolist(), int(r.integers(0, 4)) if k % 3 else 1) for k in range(900)]
    same = out[5][1]
    out += [(1000 + k, same, 2 + k % 2) for k in range(40)] + [out[100], (100, out[7][1], 3), (2000, [0.0] * 16, 1), (2100, [1e6, -1e6], 1), (2101, [1e6, 2.0], 1), (2102, [5e5, 0.5], 0)]
    return out + [(3000, None, 1), (3100, [], 1), (3200, [float("nan")] * 16, 1), (3300, [None] * 16, 2), (3400, [float("inf")] * 16, 2), (3500, same, None), (None, same, 1)]


@pytest.mark.parametrize("slab,anchors,block", [(32768, 256, 1024), (128, 3, 16)])
def test_equals_brute_force(spark, rows, monkeypatch, slab, anchors, block):
    for name, value in (("SLAB", slab), ("ANCHORS", anchors), ("BLOCK", block)):
        monkeypatch.setattr(M, name, value)
    got = M.hard_negatives(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)


def test_bounds_hold_and_leave_rows_out():
    r = np.random.default_rng(6)
    heart = r.normal(size=(20, 24))
    x = np.floor(256 * np.concatenate([heart[r.integers(0, 20, 500)] + r.normal(size=(500, 24)) / 20, np.zeros((1, 24)), heart, -heart]))
    norm, angle = M._angles(x, M.directions(24, heart[:M.REFERENCES]))
    low, high = M.score_bounds(angle, norm, angle, angle, norm, norm)
    exact = M._scores(x.astype(np.int64), x.astype(np.int64))
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < 0.5 * norm[:, None] * norm[None, :]).mean() > 0.2
    cuts = np.arange(0, len(x), 64)
    low, high = M.score_bounds(angle, norm, np.minimum.reduceat(angle, cuts), np.maximum.reduceat(angle, cuts), np.minimum.reduceat(norm, cuts), np.maximum.reduceat(norm, cuts))
    assert (low <= np.minimum.reduceat(exact, cuts, axis=1)).all() and (np.maximum.reduceat(exact, cuts, axis=1) <= high).all()


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in M.hard_negatives(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
    assert M.hard_negatives(frame.filter("false"), F.col("vec_id") == 0).collect() == []
    assert M.hard_negatives(frame, F.lit(None).cast("boolean")).collect() == []


def test_scores_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        M._scores(np.array([[1 << 40, 1 << 40]]), np.array([[1 << 40, 0]]))
