import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import scoring as S
from talkweave.llm.ragged import U, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\0end"]


@pytest.fixture
def rows(rng, prose):
    out = [(k, prose(rng.randrange(0, 60))) for k in range(200)]
    return out + [(200, None), (201, ""), (202, "Only OnLy"), (203, "x " * 20000), (7, out[7][1]), (None, "the unseen")]


def test_base_score_equals_brute_force(documents, rows):
    got = S.score_texts(documents(rows), F.col("doc_id") % 5 != 1).collect()
    count = Counter(t for i, x in rows if i is not None and i % 5 != 1 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = [(i, len(tokens(x)), sum(t in count for t in tokens(x)), sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in rows]
    key = lambda r: (r[0] is None, r)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.train_tokens, r.score) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and a[4] == n and a[5] < 0


def model_scores(rows):
    """(doc_id, tokens, score) of every row, from counters: levels as they are, without false positives."""
    whole = [(i, x, ["\0begin", *tokens(x)]) for i, x in rows]
    count = Counter(tuple(w[k - n + 1:k + 1]) for i, _, w in whole if i is not None and i % 5 != 1 for k in range(1, len(w)) for n in (1, 2, 3) if k >= n - 1)
    n = sum(c for g, c in count.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in count)

    def held(gram):
        c = count[tuple(gram)]
        if len(gram) == 1 or c == 0:
            return float(c)
        low = 1 << (c.bit_length() - 1)
        return (low + 2 * low - 1) / 2

    def score(words):
        out = 0.0
        for k in range(1, len(words)):
            p = (count[(words[k],)] + 0.5) / (n + 0.5 * (v + 1))
            for size, weight in ((2, S.M2), (3, S.M3)):
                gram = words[max(0, k - size + 1):k + 1]
                if len(gram) == size:
                    history = held(gram[:-1])
                    p = (min(held(gram), history) + weight * p) / (history + weight)
            out += math.log10(p)
        return out

    return [(i, len(w) - 1, score(w)) for i, _, w in whole]


def test_score_equals_brute_force(documents, rows):
    """Every n-gram of the training texts counts, one-offs too; a filter this wide has no false positives here."""
    got = S.score_texts(documents(rows), F.col("doc_id") % 5 != 1, entry_bits=200).collect()
    key = lambda r: (r[0] is None, r)
    have = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key)
    want = sorted(model_scores(rows), key=key)
    assert [r[:2] for r in have] == [r[:2] for r in want]
    assert [r[2] for r in have] == pytest.approx([r[2] for r in want], rel=1e-9)


def test_packing_gives_back_what_it_took(rng):
    for n in (0, 1, 2, 1000):
        names = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], U))
        assert (S._stepped(S._steps(names, 0)) == names).all() and (S._stepped(S._steps(names, 8)) == names >> U(8)).all()
        for top in (1, 300, 70000, 1 << 40):
            values = np.array([rng.randrange(top) for _ in range(n)], np.int64)
            assert (S.unpacked(S.packed(values)) == values).all()


def test_scores_of_the_filter_as_set_are_near(documents, rows):
    """False positives move few scores, and by little."""
    ids = [r for r in dict(rows).items() if r[0] is not None]
    got = {r.doc_id: r.score for r in S.score_texts(documents(ids), F.col("doc_id") % 5 != 1).collect()}
    want = {i: (n, score) for i, n, score in model_scores(ids)}
    off = [abs(got[i] - score) / n for i, (n, score) in want.items()]
    assert max(off) < 0.2 and sum(off) / len(off) < 0.01


def test_texts_that_train_once_twice_and_never_are_told_apart(documents, rng):
    def fresh():
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(80))
    never, once, twice = ([fresh() for _ in range(30)] for _ in range(3))
    rows = [(5 * k + 1, x) for k, x in enumerate(never)]
    rows += [(1000 + 5 * k, x) for k, x in enumerate(once)] + [(2000 + 5 * k + j, x) for k, x in enumerate(twice) for j in (0, 2)]
    got = {r.doc_id: r.score / r.n_tokens for r in S.score_texts(documents(rows), F.col("doc_id") % 5 != 1).collect()}
    of = [[v for k, v in got.items() if low <= k < low + 1000] for low in (0, 1000, 2000)]
    assert max(of[0]) < min(of[1]) and max(of[1]) < min(of[2])


def test_filter_holds_levels(rng):
    """Levels read back are never too low, and seldom too high; so are those of n-grams that were not entered."""
    names = np.unique(np.array([rng.getrandbits(48) for _ in range(20000)], U))
    counts = np.array([int(rng.paretovariate(0.7)) % 100000 for _ in names])
    entered = counts > 0
    filled = S.Segment(names[entered], counts[entered])
    got, true = filled.levels(names), np.array([int(c).bit_length() for c in counts])
    assert (got >= true).all() and (got > true).mean() < 0.01
    assert (filled.levels(np.array([rng.getrandbits(48) | 1 << 50 for _ in range(20000)], U)) > 0).mean() < 0.01
    assert S._middle(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]
    assert not S.Segment(names[:0], counts[:0]).levels(names).any()


def test_model_beats_the_base_on_held_out_text(documents, rng):
    def chain():
        w, out = "a", []
        for _ in range(60):
            w = {"a": "b", "b": "c", "c": rng.choice("ad"), "d": "a"}[w]
            out.append(w)
        return " ".join(out)
    got = S.score_texts(documents([(k, chain()) for k in range(300)]), F.col("doc_id") % 5 != 1).filter("doc_id % 5 = 1").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_no_training_and_empty(documents):
    got = S.score_texts(documents([(1, "a b"), (2, None)]), F.col("doc_id") > 5).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert S.score_texts(documents([]), F.col("doc_id") > 0).collect() == []
