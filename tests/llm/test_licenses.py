import numpy as np

from talkweave.llm import licenses as L


def slow_align(template, text):
    """Best local alignment: most (matches - misses - gaps), full table."""
    table = np.zeros((len(template) + 1, len(text) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if template[i - 1] == text[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_equals_the_full_table():
    r = np.random.default_rng(4)
    for _ in range(60):
        a = r.integers(0, 50, 20)
        b = np.concatenate([r.integers(50, 99, 5), np.delete(a, r.integers(0, 20, r.integers(0, 3))), r.integers(50, 99, 5)])
        match, lo, hi = L.align(a, b, 5, 12)
        assert slow_align(a, b) == slow_align(a, b[lo:hi]) and match <= hi - lo
    assert L.align(np.arange(10), np.arange(10), 0, 3) == (10, 0, 10)


def test_winnowing_keeps_a_place_in_every_window():
    r = np.random.default_rng(5)
    for n in (1, 3, 4, 5, 40):
        h = r.integers(0, 9, n)
        kept = L.winnow(h)
        assert all(np.intersect1d(kept, np.arange(k, k + L.WINDOW)).size for k in range(n - L.WINDOW + 1)) and len(kept)


def test_planted_notices(spark, rng, prose, documents):
    names = list(L.TEMPLATES)
    rows, want = [], set()
    for k, name in enumerate(names):
        text = L.TEMPLATES[name]
        words = text.split()
        if len(words) > 30:
            words[len(words) // 2] = "changed"
            del words[len(words) // 3]
        before = prose(rng.randrange(0, 200))
        rows.append((k, f"é{before}\n{' '.join(words)}\n{prose(50)}"))
        want.add((k, name))
        rows.append((100 + k, " ".join(words[:len(words) // 3])))
    rows += [(500, None), (501, ""), (502, "MIT"), (503, prose(20000)), (504, (L.TEMPLATES["MIT"] + "\n") * 300), (0, rows[0][1]), (None, rows[2][1])]
    got = L.scan_licenses(documents(rows)).collect()
    found = {(r.doc_id, r.license) for r in got if r.doc_id is not None and r.doc_id < 100}
    assert want <= found and found - want <= {(names.index("Apache-2.0-header"), "Apache-2.0")}
    short = {(r.doc_id, r.license) for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert short == {(504, "MIT"), (100 + names.index("Apache-2.0-header"), "Apache-2.0")}      # the header begins with the short notice
    assert sorted(r.first_word for r in got if r.doc_id == 504) == [5 * k for k in range(300)]
    assert sum(r.doc_id == 0 for r in got) == 2 and any(r.doc_id is None for r in got)
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and r.coverage == 1:
            assert text[r.doc_id][r.first_char:r.last_char].lower().split()[0] == L.TEMPLATES[r.license].lower().split()[0]
    assert L.scan_licenses(documents([])).collect() == []


def test_short_notices_are_told_apart(spark, documents):
    lines = {
        "All rights reserved.": {"All-rights-reserved"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
        "This work is licensed under the GNU General Public License, version 9.": set(),
        "Licensed under CC BY 4.0.": {"CC-BY-4.0"},
        "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0"},
        "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0"},
        "Released under the BSD License.": {"BSD"},
        "Released under the MIT License.": {"MIT"},
        "Work licensed under Apache License, Version 2.0": {"Apache-2.0"},
    }
    got = L.scan_licenses(documents([(k, f"some words before {x} and after it") for k, x in enumerate(lines)])).collect()
    assert {k: {r.license for r in got if r.doc_id == k} for k in range(len(lines))} == dict(enumerate(lines.values()))
