"""Language of a text: first the language family, then one-versus-one linear support vector machines inside it.

A text is its byte trigrams (case folded for A-Z, with one blank at each end) and its words, both hashed to ``DIMS``
features and divided by their number. A linear score is then a mean of weights over positions, taken over whole texts
without building the feature vector.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ragged import U, Words, mix, text_slices

DIMS = 1 << 12
SAMPLE = 1200             # labelled documents that the machines are fitted on, evenly from all languages
LANGUAGES = 200           # languages fitted at most; more than that is an error, not a cut
FAMILIES = {              # languages of one family are hard to tell apart, families are not; others are families of their own
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, document) of trigrams and of words; places of trigrams are below DIMS, of words above."""
    words = Words(data, bounds)
    n, docs = len(words.low), words.docs
    padded = np.full(n + 2 * docs, 32, np.uint8)
    length = np.diff(bounds)
    home = np.repeat(np.arange(docs), length)
    at = np.arange(n) + 2 * home + 1
    padded[at] = words.low
    before, here, after = padded[at - 1].astype(U), words.low.astype(U), padded[at + 1].astype(U)
    tri = (mix(before << U(16) | here << U(8) | after) >> U(64 - 12)).astype(np.int64)
    word = (words.hash >> U(64 - 12)).astype(np.int64) + DIMS
    return tri, home, word, words.doc


def _vectors(batches):
    """Feature shares of sampled texts: the features of 2 * DIMS that occur (int32), and their shares (float32)."""
    for batch in batches:
        for row, data, bounds in text_slices(batch.column("text")):
            tri, home, word, doc = _features(data, bounds)
            for r in range(len(bounds) - 1):
                a, b = np.searchsorted(home, (r, r + 1))
                c, d = np.searchsorted(doc, (r, r + 1))
                v = np.bincount(tri[a:b], minlength=2 * DIMS) / max(1, b - a) + np.bincount(word[c:d], minlength=2 * DIMS) / max(1, d - c)
                there = np.flatnonzero(v)
                yield pa.record_batch([batch.column("lang").slice(row + r, 1), pa.array([there.astype(np.int32).tobytes()], pa.binary()),
                                       pa.array([v[there].astype(np.float32).tobytes()], pa.binary())], names=["lang", "feature", "share"])


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, y in {-1, 1}, by accelerated gradient descent.

    Classes weigh alike. Inputs are scaled by the root of their features' mean so that rare features count.
    """
    scale = 1 / np.sqrt(x.mean(0, dtype=np.float64) + 1e-5)
    z = x * scale.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    rate = 1 / (1 + 2 * cost * (float(np.einsum("ij,ij->i", z, z).max()) + 1))
    w = v = np.zeros(z.shape[1] + 1)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v[:-1].astype(z.dtype) + v[-1])) * y * weight
        grad = v * np.append(np.ones(z.shape[1]), 0) - 2 * np.append(slack.astype(z.dtype) @ z, slack.sum())
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1] * scale, float(w[-1])


def _sharpness(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope that makes the logistic of ``margin`` likeliest, between 0.5 and 20."""
    grid = np.geomspace(0.5, 20, 25)
    loss = [np.logaddexp(0, -g * margin * y).mean() for g in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class LanguageModel:
    """families: names; of_family: languages of each; machines: weights (2 * DIMS, m), bias and slope. ``family`` has a
    machine per family against the rest (one for two families), ``pair`` one per pair of languages inside a family."""

    families: list[str]
    of_family: list[list[str]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    pairs: list[tuple[int, int, int]]

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        tri, home, word, doc = _features(data, bounds)
        docs = len(bounds) - 1
        margin = np.empty((docs, self.weights.shape[1]))
        for m in range(self.weights.shape[1]):
            for k, (place, owner) in enumerate(((tri, home), (word, doc))):
                run = np.concatenate([[0.0], self.weights[place, m].cumsum()])
                at = np.searchsorted(owner, np.arange(docs + 1))
                part = (run[at[1:]] - run[at[:-1]]) / np.maximum(1, np.diff(at))
                margin[:, m] = part if not k else margin[:, m] + part
        p = 1 / (1 + np.exp(-np.clip((margin + self.bias) * self.slope, -30, 30)))
        heads = _heads(len(self.families))
        fam = p[:, :heads] if heads != 1 else np.stack([p[:, 0], 1 - p[:, 0]], 1)
        if not heads:
            fam = np.ones((docs, 1))
        fam = fam / np.maximum(fam.sum(1, keepdims=True), 1e-12)
        best = fam.argmax(1)
        langs, score = np.empty(docs, object), np.zeros(docs)
        for f, names in enumerate(self.of_family):
            votes = np.zeros((docs, len(names)))
            for m, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    votes[:, a] += p[:, heads + m]
                    votes[:, b] += 1 - p[:, heads + m]
            share = votes / max(1, len(names) - 1) if len(names) > 1 else np.ones((docs, 1))
            here = best == f
            langs[here] = np.array(names, object)[share[here].argmax(1)]
            score[here] = fam[here, f] * share[here].max(1)
        return list(langs), np.clip(score, 0, 1)


def _heads(families: int) -> int:
    return 0 if families < 2 else 1 if families == 2 else families


def fit_languages(labelled: DataFrame) -> LanguageModel | None:
    """Fit on ``labelled`` (doc_id, text, lang): of each language the documents with the smallest hashes, SAMPLE in
    all, a documented bound. Only their feature vectors come to the driver. Null texts and languages take no part; without any
    labelled text the result is None."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not langs:
        return None
    ids = None
    for lang in langs:
        own = rows.filter(F.col("lang") == lang).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, SAMPLE // len(langs)))
        ids = own if ids is None else ids.unionByName(own)
    chosen = rows.join(F.broadcast(ids.distinct()), "doc_id").dropDuplicates(["doc_id"])      # a repeated row counts once
    sample = chosen.mapInArrow(_vectors, "lang string, feature binary, share binary").toArrow()
    got = sorted(zip(*(c.to_pylist() for c in sample.columns), strict=True))
    lang = np.array([g[0] for g in got])
    # Features that no sampled text has keep the weight 0: only the others are held.
    there = [np.frombuffer(g[1], np.int32) for g in got]
    used = np.unique(np.concatenate(there))
    x = np.zeros((len(got), len(used)), np.float32)
    for row, feature, (*_, share) in zip(x, there, got, strict=True):
        row[np.searchsorted(used, feature)] = np.frombuffer(share, np.float32)
    del sample, got, there
    families = sorted({family_of(v) for v in langs})
    of_family = [[v for v in langs if family_of(v) == f] for f in families]
    home = np.array([families.index(family_of(v)) for v in lang])
    tasks = [(slice(None), np.where(home == f, 1.0, -1.0)) for f in range(_heads(len(families)))]
    pairs = [(f, a, b) for f, names in enumerate(of_family) for a, b in combinations(range(len(names)), 2)]
    for f, a, b in pairs:
        keep = (lang == of_family[f][a]) | (lang == of_family[f][b])
        tasks.append((keep, np.where(lang[keep] == of_family[f][a], 1.0, -1.0)))
    weights, bias, slope = np.zeros((2 * DIMS, len(tasks))), np.zeros(len(tasks)), np.ones(len(tasks))
    for m, (rows_of, y) in enumerate(tasks):
        z = x[rows_of]
        weights[used, m], bias[m] = fit_svm(z, y)
        slope[m] = _sharpness(z @ weights[used, m] + bias[m], y)
        del z
    return LanguageModel(families, of_family, weights, bias, slope, pairs)


def _predicted(batches, model, keep):
    for batch in batches:
        text = batch.column("text")
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
        for row, data, bounds in text_slices(text):
            n = len(bounds) - 1
            langs, score = model.value.predict(data, bounds) if model.value else ([UNKNOWN] * n, np.zeros(n))
            ok = letters[row:row + n]
            out = [pa.array([v if k else UNKNOWN for v, k in zip(langs, ok, strict=True)], pa.string()), pa.array(np.where(ok, score, 0.0))]
            yield pa.record_batch([batch.column(c).slice(row, n) for c in keep] + out, names=[*keep, "lang_pred", "score"])


def predict_language(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred (a learned language, or ``und`` with score 0 for texts that are null,
    empty or without a letter, and for all texts without a model) and score in 0 to 1, of the whole text. Repeated rows
    get equal answers; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    result = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    columns = dict.fromkeys([*keep, "text"])
    return docs.select(*[docs[c] for c in columns]).mapInArrow(partial(_predicted, model=held, keep=list(keep)), result)


def drop_unknown_language(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose language is ``und``; learned from the rows of ``docs`` with a lang.

    Documents in any learned language stay, however low their score.
    """
    model = fit_languages(docs)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if len(columns) == len(docs.columns):
        return predict_language(docs, model, tuple(columns)).filter(F.col("lang_pred") != UNKNOWN).select(*columns)
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    return predict_language(packed, model, ("row",)).filter(F.col("lang_pred") != UNKNOWN).select("row.*")
