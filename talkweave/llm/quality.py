"""Quality of a text as how much better a dictionary of good texts compresses it than one of bad texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import text_slices

PIECE = 4096            # bytes compressed at once, so that a dictionary counts for all of a long text
DICTIONARY = 64 * 1024
LEVEL = 3
SAMPLE = 1500           # labelled documents of each class that dictionaries, and again the calibration, are made from
SAMPLE_PIECES = 4       # pieces kept of each of them, spread evenly over the text


def _pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


def _spread(batches: Iterator[pa.RecordBatch]):
    """(label, part, piece) of sampled documents, at most SAMPLE_PIECES each."""
    for batch in batches:
        label, part, piece = [], [], []
        for y, p, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _pieces(text.encode())
            for k in np.unique(np.linspace(0, len(own) - 1, SAMPLE_PIECES).astype(int)) if own else ():
                label.append(y)
                part.append(p)
                piece.append(own[k])
        yield pa.record_batch([pa.array(label, pa.int32()), pa.array(part, pa.int32()), pa.array(piece, pa.binary())], names=["label", "part", "piece"])


@dataclass
class CompressionModel:
    """Two dictionaries and the logistic curve from size difference to probability; about 130 kB."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def _coders(self):
        if not self.good:
            return None
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)]

    def difference(self, texts: list[bytes]) -> np.ndarray:
        """Size with the bad dictionary less size with the good one, over the text's bytes and over the mean size, and the
        mean size over the bytes; a row of zeros for an empty text."""
        out = np.zeros((len(texts), 3))
        coders = self._coders()
        if coders is None:
            return out
        good, bad = (c.compress for c in coders)
        for k, text in enumerate(texts):
            if text:
                own = _pieces(text)
                a, b = sum(len(good(p)) for p in own), sum(len(bad(p)) for p in own)
                out[k] = (b - a) / len(text), 2 * (b - a) / (a + b), (a + b) / 2 / len(text)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(texts) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the pieces themselves are the dictionary's content."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of y on x by Newton steps with a weak pull to zero; ``weight`` restores the classes' shares."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.append(np.full(a.shape[1] - 1, 1e-4), 1e-2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_quality(labelled: DataFrame, docs: DataFrame) -> CompressionModel:
    """Fit on ``labelled`` (doc_id, quality) and the texts of ``docs``.

    Of each class, the 2 * SAMPLE ids with the smallest hashes are taken, a documented bound; half of them make the
    dictionaries, the other half the calibration, whose classes are weighted back to their shares among all labels. Null
    ids and labels take no part. With only one class, or none, every score is the smoothed share of label 1.
    """
    labelled = labelled.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    share = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    ones, all_ = share.get(1, 0), sum(share.values())
    prior = (ones + 1) / (all_ + 2)
    picked = None
    for label in (0, 1):
        ids = labelled.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
        picked = ids if picked is None else picked.unionByName(ids)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)).cast("int")
    chosen = docs.join(F.broadcast(picked.withColumn("part", part)), "doc_id").filter("text <> ''").dropDuplicates(["doc_id"]).select("label", "part", "text")
    sample = chosen.mapInArrow(_spread, "label int, part int, piece binary").toArrow()
    label, half, piece = (sample.column(c).to_pylist() for c in range(3))
    rows = sorted(zip(label, half, piece, strict=True))
    text = {(y, p): [r[2] for r in rows if r[:2] == (y, p)] for y in (0, 1) for p in (0, 1)}
    if not all(text.values()):
        return CompressionModel(b"", b"", (0.0, 0.0, 0.0, float(np.log(prior / (1 - prior)))))
    model = CompressionModel(_dictionary(text[1, 0]), _dictionary(text[0, 0]), (0.0,) * 4)
    tried = text[0, 1] + text[1, 1]
    y = np.repeat([0.0, 1.0], [len(text[0, 1]), len(text[1, 1])])
    weight = np.where(y == 1, prior / len(text[1, 1]), (1 - prior) / len(text[0, 1])) * len(y)
    model.curve = _calibrate(model.difference(tried), y, weight)
    return model


def _scored(batches, model):
    for batch in batches:
        for row, data, bounds in text_slices(batch.column("text")):
            texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id").slice(row, len(texts)), pa.array(model.value.score(texts))], names=["doc_id", "score"])


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score in 0 to 1) for each row of ``docs``, of the whole text; null and empty texts get the score of no
    difference. Repeated rows get equal scores; an empty table gives an empty result; other columns are not looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(partial(_scored, model=held), "doc_id long, score double")
