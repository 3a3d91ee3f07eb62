import numpy as np
import pytest

from talkweave.llm import quality as Q


def labelled(rng, prose, n):
    rows = []
    for k in range(n):
        text = prose(rng.randrange(5, 200))
        good = k % 4 != 0
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split()), int(good)))
    return rows


def test_held_out(spark, rng, prose, documents):
    rows = labelled(rng, prose, 400)
    odd = [(1000, None), (1001, ""), (1002, "z " * 40000), (0, rows[0][1]), (None, "x")]
    docs = documents([r[:2] for r in rows] + odd)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 5] + [(None, 1), (7777, 0), (1, None)], "doc_id long, quality int")
    model = Q.fit_quality(labels, docs)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(by[i], q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.95
    assert by[1000] == by[1001] == pytest.approx(Q.CompressionModel(model.good, model.bad, model.curve).score([b""])[0])


def test_long_texts_count_whole():
    model = Q.CompressionModel(b"good good good words" * 100, b"bad BAD!! BAD!!" * 100, (1.0, 1.0, 0.0, 0.0))
    assert Q._pieces(b"a" * 10000) == [b"a" * 4096, b"a" * 4096, b"a" * 1808]
    text = b"good words " * 800
    assert model.difference([text])[0, 0] != model.difference([text + b"BAD!! BAD!! " * 2000])[0, 0]


def test_one_class_or_no_label(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    for rows, share in (([(1, 1), (2, 1)], 3 / 4), ([], 1 / 2)):
        model = Q.fit_quality(spark.createDataFrame(rows, "doc_id long, quality int"), docs)
        assert [r.score for r in Q.score_quality(docs, model).collect()] == [pytest.approx(share)] * 2
    assert Q.score_quality(documents([]), model).collect() == []
