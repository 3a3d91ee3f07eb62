import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from talkweave.llm import ngram_join as J
from talkweave.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def expected(rows, width, percent):
    sets = [shingles(t, width) if i is not None else frozenset() for i, t in rows]
    n = len(rows)
    link = [[a != b and bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    low = [r[0] for r in rows]
    for _ in range(n):
        low = [min([low[a]] + [low[b] for b in range(n) if link[a][b]]) if rows[a][0] is not None else None for a in range(n)]
    return sorted((rows[a][0], len(shingles(rows[a][1], width)), low[a], sum(link[a])) for a in range(n) if rows[a][0] is not None)


def edited(rng, text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(w)


def corpus(rng, prose):
    rows = []
    for size in (6, 12, 40, 150, 700):
        base = prose(size)
        rows += [base, base, base.upper()] + [edited(rng, base, k) for k in (1, 2, 3, 5, 8, 13) if k < size]
    crowd = prose(120)
    rows += [edited(rng, crowd, rng.randrange(1, 5)) for _ in range(300)]
    rows += [None, "", "  \n", "one", "one", "two words", "Two Words", "a b c", "x " * 400, "x " * 399, " ".join(f"w{k}" for k in range(30000)),
             " ".join(f"w{k}" for k in range(30000)) + " tail"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, "one"), (ids[0], rows[0])]


def test_equals_brute_force(spark, rng, prose, documents, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 32)
    rows = corpus(rng, prose)
    for width, percent in ((3, 90), (5, 80)):
        got = J.ngram_components(documents(rows), width, percent)
        out = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()]
        assert len(out) == len(rows)
        assert sorted(r for r in out if r[0] is not None) == expected(rows, width, percent)
        assert [r[2:] for r in out if r[0] is None] == [(None, 0)]


def test_low_thresholds(documents):
    """A set inside a larger one, two size bands apart."""
    words = [f"w{k}" for k in range(197)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:131]))]
    for percent, linked in ((60, True), (64, True), (66, True), (67, False)):
        assert [r.n_links for r in J.ngram_components(documents(rows), 3, percent).collect()] == [int(linked)] * 2
    with pytest.raises(ValueError):
        J.ngram_components(documents(rows), 3, 50)


def test_near_copies_dropped(spark, rng, prose, documents):
    rows = corpus(rng, prose)
    kept = J.drop_near_copies(documents(rows), 5, 80)
    want = {c for _, _, c, _ in expected(rows, 5, 80)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and None in got
    assert kept.columns == documents(rows).columns


def test_empty_table(documents):
    assert J.ngram_components(documents([]), 3, 90).collect() == []
    assert J.drop_near_copies(documents([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.data())
def test_linked_sets_share_a_fragment(n, data):
    """The guarantee that candidates rest on: every pair at the threshold has a key in common."""
    percent = data.draw(st.sampled_from([80, 90]))
    seed = data.draw(st.integers(0, 10 ** 6))
    r = np.random.default_rng(seed)
    lost = int(r.integers(0, n))
    new = int(r.integers(0, n))
    a = np.unique(r.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[lost:], r.integers(0, 2 ** 63, new, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    if not len(b) or 100 * both < percent * either or len(a) == len(b) == both:
        return
    doc = np.repeat([0, 1], [len(a), len(b)])
    d, k = J.fragment_keys(doc, np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
    assert np.intersect1d(k[d == 0], k[d == 1]).size


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (201, 202), (200, 202)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len(got) == 51 + 2 + 3
    assert len({got[k] for k in range(51)}) == 1 and got[100] == got[101] and len({got[200], got[201], got[202]}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
