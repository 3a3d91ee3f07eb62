import numpy as np
import pytest

from talkweave.llm import sketches as S
from talkweave.llm.rarity import CELLS
from test_ngram_join import corpus, edited, expected


def want(rows, width, percent):
    return sorted((i, n, c, i == c) for i, n, c, _ in expected(rows, width, percent))


def got(frame):
    out = [tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()]
    return sorted(r for r in out if r[0] is not None), [r for r in out if r[0] is None]


def test_equals_brute_force(rng, prose, documents):
    rows = corpus(rng, prose)
    for width, percent in ((4, 80), (3, 90), (2, 55)):
        found, nameless = got(S.near_copies(documents(rows), width, percent))
        assert found == want(rows, width, percent)
        assert [r[2:] for r in nameless] == [(None, True)]


def test_large_families_over_chunks(rng, prose, documents, monkeypatch):
    """Chunks, leaders and the rest: near copies of two texts, and documents that consist of one passage and little else."""
    monkeypatch.setattr(S, "CHUNK", 16)
    a, b, passage = prose(150), prose(200), prose(60)
    rows = [edited(rng, a, rng.randrange(1, 9)) for _ in range(120)] + [edited(rng, b, rng.randrange(1, 7)) for _ in range(60)]
    rows += [f"{passage} {prose(rng.randrange(2, 30))}" for _ in range(150)] + [f"{prose(100)} {passage} {prose(200)}" for _ in range(40)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    assert got(S.near_copies(documents(rows), 4, 80))[0] == want(rows, 4, 80)


@pytest.mark.parametrize("size", [3, 100, 128, 140, 160, 400, 3000])
def test_linked_sets_share_a_posting(size):
    """Pairs at the threshold share a posted value, and pass the estimate, whatever the counts are."""
    r = np.random.default_rng(size)
    counts = r.integers(0, 50, CELLS)
    for _ in range(40):
        lost = int(r.integers(0, size // 9 + 1))
        a = np.unique(r.integers(0, 2 ** 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.permutation(size)[lost:]], r.integers(0, 2 ** 63, lost, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        d, v = S._postings(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]), 80, counts)
        assert np.intersect1d(v[d == 0], v[d == 1]).size
        assert S.linked(a, b, 80)


def test_estimate_is_that_of_the_union():
    r = np.random.default_rng(1)
    for n in (1, 50, 128, 129, 1000):
        a, b = (np.unique(r.integers(0, 3 * n, n, dtype=np.uint64)) for _ in range(2))
        union = np.union1d(a, b)[:S.K]
        assert S.estimate(a[:S.K], b[:S.K]) == (len([x for x in union if x in a and x in b]), len(union))


def test_empty_table(documents):
    assert S.near_copies(documents([])).collect() == []
    assert [r.kept for r in S.near_copies(documents([(1, None), (2, ""), (3, " \n")])).collect()] == [True] * 3
