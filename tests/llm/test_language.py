import numpy as np
import pytest

from talkweave.llm import language as L
from talkweave.llm.ragged import text_slices

import pyarrow as pa

VOICE = {"en": "the and of this that with house were would there", "de": "der die und nicht das mit haus waren würde über",
         "fr": "le les et des que avec maison était où été", "es": "el los y del que con casa era dónde niño"}


def texts(rng, n):
    out = []
    for k in range(n):
        lang = ("en", "de", "fr", "es")[k % 4]
        out.append((k, " ".join(rng.choice(VOICE[lang].split()) for _ in range(rng.randrange(4, 40))), lang))
    return out


def test_held_out_accuracy_and_odd_texts(spark, rng, documents):
    rows = texts(rng, 400)
    model = L.fit_languages(documents([r for r in rows if r[0] % 5] + [(9000, None, "en"), (9001, "the", None)]))
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "the " * 50000), (0, rows[0][1]), (None, "der die das")]
    got = L.predict_language(documents(rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([by[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_sums_the_weights_over_the_whole_text(rng):
    r = np.random.default_rng(1)
    model = L.LanguageModel(["f"], [["a", "b"]], r.normal(size=(2 * L.DIMS, 1)), np.array([0.1]), np.array([2.0]), [(0, 0, 1)])
    for _, data, bounds in text_slices(pa.array(["Ab cd", "", "x" * 3000 + " yé"])):
        tri, home, word, doc = L._features(data, bounds)
        langs, score = model.predict(data, bounds)
        for k in range(3):
            m = model.weights[tri[home == k], 0].sum() / max(1, (home == k).sum()) + model.weights[word[doc == k], 0].sum() / max(1, (doc == k).sum()) + 0.1
            p = 1 / (1 + np.exp(-2 * m))
            assert langs[k] == ("a" if p >= 0.5 else "b") and score[k] == pytest.approx(max(p, 1 - p))


def test_family_comes_first():
    assert L.family_of("en") == L.family_of("de-AT") == "germanic" and L.family_of("xx") == "xx"


def test_one_language_and_none(documents):
    one = L.fit_languages(documents([(1, "hello there", "en")]))
    assert [r.lang_pred for r in L.predict_language(documents([(1, "anything"), (2, "")]), one).orderBy("doc_id").collect()] == ["en", "und"]
    assert L.fit_languages(documents([(1, "hello", None)])) is None
    assert [r.lang_pred for r in L.predict_language(documents([(1, "anything")]), None).collect()] == ["und"]
    assert L.predict_language(documents([]), one).collect() == []


def test_stage_keeps_columns_and_clean_documents(rng, documents):
    docs = documents(texts(rng, 80) + [(500, ""), (501, None, "en"), (3, "12"), (None, "the and of")])
    kept = L.drop_unknown_language(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, k) for k in range(80)] + [(True, None)]
