"""Bottom-k sketches, and the sets that have enough in common with others to link with any.

A set keeps the ``K`` smallest of its hashed shingles. Inverted lists of all retained values tell, for each set, how many of
them another set has too: with too few, it links with nothing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ragged import U, Words, mix, packed, shingle_sets, sum_by, text_slices, unpacked

K = 128                    # retained values of a set
SIGMAS = 5.0               # a pair at the threshold is lost with a probability of about one in a million, others sooner
POSTINGS = 1 << 20         # postings a task sorts at once
BUCKET_POSTINGS = 1 << 20  # postings that meet in one reducer, about


def retained(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of sets given as (doc, value) in order."""
    start = np.searchsorted(doc, np.arange(docs))
    keep = np.arange(len(doc)) - start[doc] < K
    return doc[keep], value[keep]


def _spread(union: np.ndarray, percent: int) -> np.ndarray:
    """Standard deviation of the number of shared values among the ``K`` smallest of a union at the threshold."""
    t = percent / 100
    return np.sqrt(K * t * (1 - t) * np.clip(1 - K / np.maximum(union, 1), 0, None))


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """The fewest retained values that a set of this size shares with a set it links with, within ``SIGMAS``."""
    t = percent / 100
    union = size * 100 // percent
    sampled = np.where(union > K, K * t - SIGMAS * _spread(union, percent), np.inf)
    return np.maximum(1, np.ceil(np.minimum(np.where(size <= K, t * size, np.inf), sampled) - 1e-9)).astype(np.int64)


def hashed_sets(batches, width: int):
    """(ids, doc, hash, size, class) of the sets of each slice of (doc_id, text)."""
    for batch in batches:
        ids = batch.column(0)
        for row, data, bounds in text_slices(batch.column(1)):
            words = Words(data, bounds)
            doc, value = shingle_sets(words, width)
            size = np.bincount(doc, minlength=words.docs)
            yield ids.slice(row, words.docs), doc, value, size, mix(sum_by(doc, mix(value), words.docs) + size.astype(U)).view(np.int64)


def _sketched(batches, width):
    for ids, doc, value, size, cls in hashed_sets(batches, width):
        d, v = retained(doc, value, len(size))
        at = np.searchsorted(d, np.arange(len(size) + 1))
        yield pa.record_batch([ids, pa.array(size, pa.int64()), pa.array(cls), pa.array([v[at[k]:at[k + 1]].tobytes() for k in range(len(size))], pa.binary())],
                              names=["doc_id", "n_shingles", "cls", "sketch"])


def _unrolled(batches):
    """(doc, value, size, class) of batches of (cls, n_shingles, sketch)."""
    for batch in batches:
        sketches = batch.column("sketch").to_pylist()
        doc = np.repeat(np.arange(len(sketches)), [len(x) // 8 for x in sketches])
        yield doc, np.frombuffer(b"".join(sketches), U), np.asarray(batch.column("n_shingles")), np.asarray(batch.column("cls"))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(values) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _inverted(batches, buckets):
    """All retained values by bucket: rows (bucket, values, owner, classes), values ascending, each (value, class) once a flush."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        value, cls = (np.concatenate([h[i] for h in held]) for i in range(2))
        held.clear()
        bucket = _bucket(value, buckets)
        order = np.lexsort((cls, value, bucket))
        value, cls, bucket = value[order], cls[order], bucket[order]
        new = np.append(True, (value[1:] != value[:-1]) | (cls[1:] != cls[:-1]))[:len(value)]
        value, cls, bucket = value[new], cls[new], bucket[new]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cut)):
            used, local = np.unique(cls[cut[b]:cut[b + 1]], return_inverse=True)
            out.append((int(b), packed(np.diff(value[cut[b]:cut[b + 1]], prepend=U(0))), packed(local), used.tobytes()))
        return pa.record_batch([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in range(1, 4))],
                               names=["bucket", "values", "owner", "classes"])

    n = 0
    for doc, value, _, cls in _unrolled(batches):
        held.append((value, cls[doc]))
        n += len(value)
        if n >= POSTINGS:
            yield flush()
            n = 0
    if n:
        yield flush()


def _common(table: pa.Table, ranges: int) -> pa.Table:
    """How many of a class's values in this bucket another class has too, a row for each range of classes."""
    parts = [(unpacked(v).astype(U).cumsum(dtype=U), np.frombuffer(c, np.int64)[unpacked(o)]) for v, o, c in zip(*(table.column(x).to_pylist() for x in ("values", "owner", "classes")), strict=True)]
    value, cls = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((cls, value))
    value, cls = value[order], cls[order]
    new = np.append(True, (value[1:] != value[:-1]) | (cls[1:] != cls[:-1]))[:len(value)]
    value, cls = value[new], cls[new]
    twin = np.append(False, value[1:] == value[:-1])[:len(value)]
    names, n = np.unique(cls[twin | np.append(twin[1:], False)[:len(value)]], return_counts=True)
    place = _bucket(names.view(U), ranges)
    order = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(ranges + 1))
    used = np.flatnonzero(np.diff(cut))
    return pa.table([pa.array(used, pa.int32()), pa.array([names[order[cut[r]:cut[r + 1]]].tobytes() for r in used], pa.binary()), pa.array([packed(n[order[cut[r]:cut[r + 1]]]) for r in used], pa.binary())],
                    names=["range", "classes", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    names, back = np.unique(np.concatenate([np.frombuffer(c, np.int64) for c in table.column("classes").to_pylist()]), return_inverse=True)
    n = np.bincount(back, np.concatenate([unpacked(c) for c in table.column("counts").to_pylist()]), len(names))
    return pa.table({"cls": names, "n": n.astype(np.int64)})


def _enough(batches, percent):
    for batch in batches:
        yield batch.filter(pa.array(np.asarray(batch.column("n")) >= least_shared(np.asarray(batch.column("n_shingles")), percent)))



SKETCHED = "doc_id long, n_shingles long, cls long, sketch binary"


def sketched(docs: DataFrame, width: int, purpose: str) -> DataFrame:
    """(doc_id, n_shingles, cls, sketch) of each row of (doc_id, text); equal sets have equal ``cls``. Written to the shared folder."""
    return written(docs.mapInArrow(partial(_sketched, width=width), SKETCHED), purpose)


def buckets_of(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * K // BUCKET_POSTINGS + 1)


def hopeful(sized: DataFrame, classes: DataFrame, percent: int, purpose: str) -> DataFrame:
    """(cls, n_shingles, n, rep) of the classes (cls, n_shingles, rep) that have enough retained values in common with others."""
    buckets = buckets_of(sized)
    lists = (sized.filter("doc_id is not null and n_shingles > 0").select("cls", "n_shingles", "sketch")
             .mapInArrow(partial(_inverted, buckets=buckets), "bucket int, values binary, owner binary, classes binary"))
    common = lists.groupBy("bucket").applyInArrow(lambda table: _common(table, buckets), "range int, classes binary, counts binary").groupBy("range").applyInArrow(_summed, "cls long, n long")
    return written(common.join(classes, "cls").select("cls", "n_shingles", "n", "rep").mapInArrow(partial(_enough, percent=percent), "cls long, n_shingles long, n long, rep long"), purpose)
