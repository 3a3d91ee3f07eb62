import numpy as np
import pytest

from talkweave.llm import neighbours as N


def brute(rows, queries, top):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v)) for i, v in rows if i is not None and ok(v)]
    out = {}
    for i, v in queries:
        if i is None or not ok(v):
            continue
        v = np.array(v)
        near = sorted((-(x @ v) / np.sqrt((x @ x) * (v @ v)), j) for j, x in rows if j != i and len(x) == len(v))
        out[i] = [(j, -s) for s, j in near[:top]]
    return out


@pytest.fixture
def rows():
    r = np.random.default_rng(2)
    out = [(k, r.normal(size=24).tolist()) for k in range(1500)]
    out += [(2000 + k, (np.array(out[k][1]) + 0.05 * r.normal(size=24)).tolist()) for k in range(300)]
    return out + [(3000, None), (3050, []), (3100, [0.0] * 24), (3150, [float("nan")] * 24), (3200, [None] * 24), (3250, [1.0, 2.0]), (3251, [2.0, 1.0]),
                  (None, [1.0] * 24), (4000, out[0][1]), (4050, out[0][1])]


def test_recall_scores_and_odd_vectors(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "PART", 512)
    monkeypatch.setattr(N, "QUERIES", 16)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, width string")
    got = N.nearest(frame, frame.filter("vec_id % 50 = 0"), 5).collect()
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert {r.query_id for r in got} == {q for q in want if want[q]}
    assert [(r.vec_id, r.rank) for r in got if r.query_id == 3250] == [(3251, 1)]
    hits = 0
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {j for j, _ in want[q]})
        assert all(r.score == pytest.approx(dict(want[q])[r.vec_id], abs=1e-12) for r in mine if r.vec_id in dict(want[q]))
    assert hits / sum(len(v) for v in want.values()) >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 4000), key=lambda r: r.rank)][:2] == [0, 4050]


def test_all_candidates_if_fewer(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = N.nearest(frame, frame.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert N.nearest(frame.filter("false"), frame, 5).collect() == [] and N.nearest(frame, frame.filter("false"), 5).collect() == []


def test_forest_meets_the_longest_prefixes_first():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16))
    lines = N.directions(16)
    forest, strings = N.Forest(x, lines), N.bit_strings(x, lines)
    asked = N.bit_strings(r.normal(size=(5, 16)), lines)
    for k, met in enumerate(forest.candidates(asked, 60)):
        common = np.array([[N.BITS - int(a ^ b).bit_length() for b in strings[t]] for t, a in enumerate(asked[:, k])])
        depth = next(d for d in range(N.BITS, -1, -1) if (common.max(0) >= d).sum() >= 60)
        assert sorted(met) == sorted(np.flatnonzero(common.max(0) >= depth))


def test_a_repeated_query_row_is_asked_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0]), *[(k, [1.0, 0.1 * k]) for k in range(1, 8)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.nearest(frame, frame.filter("vec_id % 50 = 0"), 3).collect()
    assert [(r.rank, r.vec_id) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]
    assert sorted(r.rank for r in got if r.query_id == 50) == [1, 1, 2, 2, 3, 3]
