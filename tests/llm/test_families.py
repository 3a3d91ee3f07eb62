"""Large families: chained by exact counts, and compared without a copy of every set for each other block."""
import numpy as np

import pytest

from talkweave.llm import families as A, ngram_join as J, sketches as S
from test_ngram_join import edited, expected


def test_keys_that_one_owner_has_come_first():
    """Owner 0 has two keys of its own alone and keeps three; owner 1 has none and keeps two; the third is all alone."""
    owner, key = np.array([0, 0, 0, 1, 1, 1]), np.array([5, 6, 7, 7, 6, 5], np.uint64)
    times, last = np.array([2, 3, 2, 2, 3, 2]), np.array([False, False, True, True, False, False])
    some = A.first_keys(owner, key, times, last, np.array([3, 2, 4]), np.array([4, 2, 4]))
    assert sorted((int(owner[k]), int(key[k])) for k in some) == [(0, 5), (1, 5), (1, 6)]


def test_common_passage_does_not_chain_families(rng, prose, documents, monkeypatch):
    """Pairs of near copies around one passage, where the table of cells tells nothing."""
    monkeypatch.setattr(J, "cell_counts", lambda rows, values: np.zeros(J.CELLS, np.int64))
    monkeypatch.setattr(A, "LARGE", 4)
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "SPAN", 1)
    monkeypatch.setattr(J, "PART", 2)
    sizes, keep = {}, J.written

    def written(df, purpose):
        out = keep(df, purpose)
        if purpose == "ngram-members":
            sizes.update({r.family: r["count"] for r in out.groupBy("family").count().collect()})
        return out

    monkeypatch.setattr(J, "written", written)
    passage, crowd = prose(60), prose(100)
    rows = []
    for _ in range(12):
        own = f"{prose(90)} {passage}"
        rows += [own, edited(rng, own, 2)]
    rows += [edited(rng, crowd, rng.randrange(1, 5)) for _ in range(40)]
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in J.ngram_components(documents(rows), 5, 80).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == expected(rows, 5, 80)
    assert sorted(sizes.values())[:12] == [2] * 12


def test_a_block_of_near_copies_travels_small():
    r = np.random.default_rng(3)
    base = r.integers(0, 2 ** 64, 100, np.uint64)
    lists = [np.unique(np.concatenate([r.permutation(base)[:92], r.integers(0, 2 ** 64, 8, np.uint64)])) for _ in range(100)]
    lists[7] = lists[99] = np.empty(0, np.uint64)
    values, places = J.shelved(lists)
    assert (J.unshelved(values, places, np.array([len(x) for x in lists])) == np.concatenate(lists)).all()
    assert J.unshelved(*J.shelved([lists[7]]), np.zeros(1, np.int64)).size == 0
    rows = [(1, 0, 0, k, 100, 1, 0, 0, 0, x.tobytes()) for k, x in enumerate(lists)]
    batch = J.pa.record_batch([J.pa.array(c) for c in zip(*rows)], names=list("abcdefghij"))
    row, = J._bundled([batch])
    assert row.nbytes < 0.35 * sum(x.nbytes for x in lists)


def test_parts_meet_once():
    """Overlaps of two parts are the rectangle of the square."""
    r = np.random.default_rng(4)
    member, value = np.repeat(np.arange(9), 40), r.integers(0, 120, 360).astype(np.uint64)
    member, value = np.unique(np.stack([member.astype(np.uint64), value]), axis=1)
    member = member.astype(np.int64)
    assert (J._overlaps(member, value, 9, 4) == J._overlaps(member, value, 9)[:4, 4:]).all()


@pytest.mark.parametrize("side", [None, np.arange(60) // 30])
def test_forest_by_counts_joins_what_pairs_join(monkeypatch, side):
    """Whether pairs are verified one by one or all overlaps are counted, the same parts come out."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2 ** 64, 300, np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[n:], r.integers(0, 2 ** 64, n, np.uint64)])) for n in r.integers(2, 60, 60)]
    label, active, parts = np.arange(60), r.random(60) < 0.7, []
    for many in (0, 10 ** 6):
        monkeypatch.setattr(S, "MANY", many)
        part = np.arange(60)
        for i, j in S.forest(sets, label, active, 80, side):
            part[part == part[j]] = part[i]
        parts.append((part[:, None] == part[None, :]).tolist())
    assert parts[0] == parts[1] and 60 < np.sum(parts[0]) < 3600


def test_rest_of_a_large_family_moves_its_texts_once(rng, prose, documents, monkeypatch):
    """Near copies of two texts and others that share most of one and link with nothing: texts go to the chunks, not to every block."""
    monkeypatch.setattr(S, "CHUNK", 16)
    monkeypatch.setattr(A, "LARGE", 16)
    moved, keep = [], S._compared

    def compared(docs, chosen, *more):
        moved.append(chosen.count())
        return keep(docs, chosen, *more)

    monkeypatch.setattr(S, "_compared", compared)
    a, b = prose(150), prose(200)
    rows = [edited(rng, a, rng.randrange(1, 9)) for _ in range(50)] + [edited(rng, b, rng.randrange(1, 7)) for _ in range(30)] + [edited(rng, a, 7) for _ in range(60)]
    rows += [f"{a} {b}"] + [f"{a} {prose(30)}"]
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in S.near_copies(documents(rows), 4, 80).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [r[:3] for r in expected(rows, 4, 80)]
    assert sum(moved) <= 5 * len(rows)
