import math
from collections import Counter, defaultdict

import pytest

from talkweave.llm.mixing import mix_sources, mixed_documents, plan_mixture


def corpus(prose):
    rows = []
    for source, docs, words in (("big", 300, 20), ("mid", 60, 20), ("small", 15, 10), (None, 20, 7)):
        rows += [(len(rows) + k, prose(words), None, source) for k in range(docs)]
    return rows + [(9000, "", None, "mid"), (9001, None, None, "void"), (None, prose(9), None, "small"), (0, rows[0][1], None, "big")]


def shares(rows):
    total = Counter()
    for r in rows:
        total[r[3]] += len((r[1] or "").split())
    return {s: t / sum(total.values()) for s, t in total.items()}, total


def test_limit_is_met_and_nothing_is_lost(prose, documents):
    rows = corpus(prose)
    p, total = shares(rows)
    plan = {r.source: r for r in plan_mixture(documents(rows), repetition_limit=2.0).collect()}
    live = {s for s in p if p[s]}
    spread = {s: plan[s].weight / p[s] for s in live}
    assert max(spread.values()) / min(spread.values()) == pytest.approx(2.0, rel=1e-6)
    assert sum(plan[s].weight for s in live) == pytest.approx(1) and plan["void"].weight == 0
    got = mix_sources(documents(rows), repetition_limit=2.0).collect()
    assert Counter((r.doc_id, r.source) for r in got if r.epoch == 0) == Counter((r[0], r[3]) for r in rows)
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    for s in live:
        used = sum(words[r.doc_id] for r in got if r.source == s)
        want = plan[s].epochs * total[s]
        block = max(w for w in words.values())
        assert want - block - 1 <= used <= want + 1e-6
    again = mixed_documents(documents(rows), repetition_limit=2.0)
    assert again.columns == documents(rows).columns
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in got)


def test_target_entropy(prose, documents):
    rows = corpus(prose)
    p, _ = shares(rows)
    goal = 1.0
    plan = [r.weight for r in plan_mixture(documents(rows), target_entropy=goal, repetition_limit=None).collect() if r.weight]
    assert -sum(w * math.log(w) for w in plan) == pytest.approx(goal, abs=1e-6)
    grid = [k / 1000 for k in range(1001)]

    def entropy(a):
        z = sum(v ** a for v in p.values() if v)
        return -sum(v ** a / z * math.log(v ** a / z) for v in p.values() if v)
    first = next(a for a in grid if entropy(a) <= goal)
    brute = [v ** first / sum(x ** first for x in p.values() if x) for v in p.values() if v]
    assert sorted(plan) == pytest.approx(sorted(brute), abs=2e-3)


def test_budget_takes_whole_blocks_of_a_permutation(prose, documents):
    rows = corpus(prose)
    _, total = shares(rows)
    got = mix_sources(documents(rows), repetition_limit=2.0, budget=sum(total.values()) // 2).collect()
    assert 0 < len([r for r in got if r.source == "big"]) < 300
    order = defaultdict(set)
    for r in got:
        if r.source == "big":
            order[r.block_order].add(r.block)
    assert all(len(b) == 1 for b in order.values())


def test_empty_and_wordless(documents):
    assert mix_sources(documents([])).collect() == []
    got = mix_sources(documents([(1, "", None, "a"), (2, None, None, "b")])).collect()
    assert sorted((r.doc_id, r.epoch, r.weight) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]
