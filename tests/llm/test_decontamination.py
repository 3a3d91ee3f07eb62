import numpy as np
import pyarrow as pa

from talkweave.llm import decontamination as D


def items(prose):
    out = [(k, prose(20 + 3 * k) + ". " + prose(6) + ".") for k in range(30)]
    return out + [(100, None), (None, out[0][1]), (101, "too short"), (102, ""), (103, out[3][1]), (104, prose(400) + ". " + prose(9))]


def test_planted_items_are_found_and_clean_documents_left(spark, rng, prose, documents):
    bench = items(prose)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    rows, want = [], set()
    for k, (i, text) in enumerate(b for b in bench if b[0] is not None and b[1] and len(b[1].split()) >= 5):
        style = (str, str.upper, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", "*** "))[k % 4]
        rows.append((k, prose(rng.randrange(0, 300)) + " " + style(text) + " " + prose(rng.randrange(0, 300))))
        want.add((k, i))
    same = {3: 103, 103: 3}
    want |= {(d, same[i]) for d, i in want if i in same}
    clean = [(1000 + k, prose(200)) for k in range(40)] + [(2000, None), (2001, ""), (2002, "too short"), (2003, prose(30000))]
    clean += [(2004, bench[0][1].rsplit(". ", 1)[0][:60]), (2005, "\n".join(" ".join(b[1].split()[:5]) for b in bench[:20]))]
    docs = documents([*rows, *clean, rows[0], (None, rows[0][1])])
    got = D.benchmark_matches(docs, frame).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want
    assert sum(r.doc_id == 0 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.6 and r.score >= D.THRESHOLD for r in got)
    kept = D.drop_contaminated(docs, frame)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c[0] for c in clean)


def test_retrieval_equals_brute_force(prose):
    bench = [b for b in items(prose) if b[0] is not None and b[1]]
    index = D.build_index([b[0] for b in bench], [b[1] for b in bench])
    weight: dict = {}
    for t in range(len(index.terms)):
        for b in range(index.block_start[t], index.block_start[t + 1]):
            for p in range(index.post_start[b], index.post_start[b + 1]):
                weight[int(index.terms[t]), int(index.entry[p])] = index.impact[p]
    text = [prose(90) + " " + bench[5][1] + " " + prose(70), bench[9][1], "", bench[2][1][:90] + " " + bench[4][1][:100], bench[-1][1]]
    words = next(D.Words(d, b, punctuation=False) for _, d, b in D.text_slices(pa.array(text)))
    first = np.append(0, words.counts().cumsum())
    want = {}
    for d in range(len(text)):
        for lo in range(int(first[d]), int(first[d + 1]), D.SPAN):
            seen = set(words.hash[lo:min(lo + 2 * D.SPAN, int(first[d + 1]))].tolist())
            for e in range(len(index.item)):
                s = sum(weight.get((t, e), 0) for t in seen)
                if s >= D.THRESHOLD:
                    want[lo, e] = s
    got = dict(zip(zip(*(x.tolist() for x in D.retrieve(words, index)[:2]), strict=True), D.retrieve(words, index)[2].tolist(), strict=True))
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_indexes_of_a_large_benchmark(spark, prose, documents, monkeypatch):
    bench = [b for b in items(prose) if b[0] is not None and b[1]]
    frame = spark.createDataFrame(bench, "item_id long, text string")
    docs = documents([(k, b[1]) for k, b in enumerate(bench)])
    one = {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, frame).collect()}
    monkeypatch.setattr(D, "INDEX_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, frame).collect()} == one


def test_empty_tables(spark, documents, prose):
    frame = spark.createDataFrame(items(prose), "item_id long, text string")
    assert D.benchmark_matches(documents([]), frame).collect() == []
    assert D.benchmark_matches(documents([(1, prose(50))]), frame.filter("false")).collect() == []


def test_scores_do_not_depend_on_the_cut(spark, prose, documents, monkeypatch):
    bench = items(prose)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    sound = [b for b in bench if b[0] is not None and b[1]]
    docs = documents([(k, prose(70) + " " + " ".join(w for n, w in enumerate(b[1].split()) if n % 29) + " " + prose(40)) for k, b in enumerate(sound)] + [(500 + k, b[1]) for k, b in enumerate(sound)])

    def scores():
        return {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in D.benchmark_matches(docs, frame).collect()}

    whole = scores()
    size = sum(len(b[1].encode()) for b in sound)
    for parts in (2, 5):
        monkeypatch.setattr(D, "INDEX_BYTES", size // parts + 1)
        assert scores() == whole
    assert len(whole) > 30 and any(s < 1 for s, *_ in whole.values())
