"""Hard negatives by integer inner products, with angular triangle filtering.

Components are quantised to ``floor(scale * x)``. A row stores its norm and its angles to a few reference directions. The
angle between two rows lies between the difference and the sum of their angles to a reference, so every reference gives an
interval of the cosine; times the norms, and widened for rounding, that bounds the integer score. First whole blocks of
rows, kept in the order of one angle, then single rows are left out where their bounds miss every window an anchor still
has open; only the others are scored. What is scored is exact, so the filter never changes a result.

Anchors meet all rows block by block: positives first, slab by slab of their own label; then negatives, whose windows
follow from the positives' scores.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

REFERENCES = 8          # stored angles a row
SLAB = 32768            # rows that a task holds
BLOCK = 1024            # rows whose angle ranges are looked at together
ANCHORS = 256           # anchors that a task answers from one slab
SLACK = 1e-5            # radians an interval is widened by at each end; the angles are 32-bit
EXACT = 1 << 53         # integer sums below it are exact in double precision


def directions(width: int, sample: np.ndarray) -> np.ndarray:
    """Unit reference directions: sampled rows of this width, filled up with seeded random ones."""
    fill = np.random.default_rng(width).normal(size=(REFERENCES, width))
    lines = np.concatenate([sample.reshape(-1, width).astype(float), fill])[:REFERENCES]
    return lines / np.sqrt((lines ** 2).sum(1, keepdims=True))


def _angles(matrix: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((matrix ** 2).sum(1))
    cosine = matrix @ lines.T / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def _stored(batches, sample):
    for batch in batches:
        for width in np.unique(np.asarray(batch.column("width"))):
            rows = batch.filter(pa.array(np.asarray(batch.column("width")) == width))
            matrix = np.asarray(rows.column("code").flatten()).reshape(-1, int(width)).astype(float)
            norm, angle = _angles(matrix, directions(int(width), np.array(sample.get(int(width), []), float)))
            angles = pa.ListArray.from_arrays(pa.array(np.arange(len(angle) + 1) * REFERENCES, pa.int32()), pa.array(angle.ravel()))
            yield pa.record_batch([*rows.columns, pa.array(norm), angles], names=[*rows.schema.names, "norm", "angles"])


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _cosines(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest cosine of angles from ``low`` to ``high``, widened."""
    return np.cos(np.minimum(np.pi, high + SLACK)), np.cos(np.maximum(0, low - SLACK))


def score_bounds(angle: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray, norm_least: np.ndarray, norm_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds, anchors x blocks, of integer scores with rows whose angles to each reference (blocks x references)
    lie from ``least`` to ``most`` and whose norms from ``norm_least`` to ``norm_most``. A single row is a block of its own."""
    low = np.zeros((len(angle), len(least)))
    high = np.full((len(angle), len(least)), np.pi)
    for r in range(angle.shape[1]):
        a, m, w = angle[:, r, None].astype(float), least[None, :, r].astype(float), most[None, :, r].astype(float)
        low = np.maximum(low, np.maximum(m - a, a - w))
        # the largest of min(a + x, 2 pi - a - x) over x from m to w
        high = np.minimum(high, np.where(a + w <= np.pi, a + w, np.where(a + m >= np.pi, 2 * np.pi - a - m, np.pi)))
    down, up = _cosines(low, high)
    lower = norm[:, None] * np.where(down < 0, norm_most[None, :], norm_least[None, :]) * down
    upper = norm[:, None] * np.where(up < 0, norm_least[None, :], norm_most[None, :]) * up
    room = 1 + 1e-9 * norm[:, None] * norm_most[None, :]
    return np.floor(lower - room), np.ceil(upper + room)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, anchors x rows."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if top(anchors) * top(rows) * anchors.shape[1] < EXACT:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    exact = anchors.astype(object) @ rows.T.astype(object)
    if max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


class Windows:
    """For each of some anchors ``count`` score windows, each with its best ``keep`` rows so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, keep: int):
        self.low, self.high, self.keep = low, high, keep            # anchors x windows; low > high: closed
        self.found = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * low.shape[1] for _ in range(len(low))]

    def open(self, lower: np.ndarray, upper: np.ndarray, who: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Where scores from ``lower`` to ``upper`` (anchors ``who`` x n) may enter some window."""
        out = np.zeros(lower.shape, bool)
        for low, high in zip(self.low[who].T, self.high[who].T, strict=True):
            out |= (lower <= high[:, None]) & (upper >= low[:, None]) & (low <= high)[:, None]
        return out

    def take(self, k: int, ids: np.ndarray, score: np.ndarray) -> None:
        for j in range(self.low.shape[1]):
            good = (score >= self.low[k, j]) & (score <= self.high[k, j])
            if not good.any():
                continue
            i, s = np.append(self.found[k][j][0], ids[good]), np.append(self.found[k][j][1], score[good])
            best = np.lexsort((i, -s))[:self.keep]
            self.found[k][j] = i[best], s[best]
            if len(best) == self.keep:        # a row that ties with the last may have the smaller id
                self.low[k, j] = max(self.low[k, j], s[best[-1]])


def _searched(asked: pa.Table, slab: pa.Table, windows: Windows, same: bool) -> None:
    angle, norm, label, own = _matrix(asked, "angles"), np.asarray(asked.column("norm")), np.asarray(asked.column("label")), np.asarray(asked.column("vec_id"))
    code = _matrix(asked, "code")
    angles = _matrix(slab, "angles")
    order = np.argsort(angles[:, 0], kind="stable")
    angles, norms, labels, ids, codes = angles[order], *(np.asarray(slab.column(c))[order] for c in ("norm", "label", "vec_id")), _matrix(slab, "code")[order]
    cuts = np.arange(0, len(ids), BLOCK)
    bounds = score_bounds(angle, norm, np.minimum.reduceat(angles, cuts), np.maximum.reduceat(angles, cuts), np.minimum.reduceat(norms, cuts), np.maximum.reduceat(norms, cuts))
    if bounds[1].max() >= 1 << 63 or bounds[0].min() < -(1 << 63):
        _scores(code, codes)                      # an error if any score is really that large
    for b in np.argsort(-bounds[1].max(0)):       # the most promising blocks first: they close windows early
        who = np.flatnonzero(windows.open(bounds[0][:, [b]], bounds[1][:, [b]])[:, 0])
        if not len(who):
            continue
        rows = slice(cuts[b], cuts[b] + BLOCK)
        lower, upper = score_bounds(angle[who], norm[who], angles[rows], angles[rows], norms[rows], norms[rows])
        all_open = np.zeros((len(asked), lower.shape[1]), bool)
        all_open[who] = windows.open(lower, upper, who) & ((label[who, None] == labels[None, rows]) == same) & (own[who, None] != ids[None, rows])
        who, some = np.flatnonzero(all_open.any(1)), all_open.any(0)
        if not len(who):
            continue
        score = _scores(code[who], codes[rows][some])
        for n, k in enumerate(who):
            mine = all_open[k, some]
            windows.take(k, ids[rows][some][mine], score[n, mine])


def _positives(keep: int):
    def find(asked: pa.Table, slab: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and slab.num_rows:
            low = np.full((asked.num_rows, 1), -(1 << 63), np.int64)
            windows = Windows(low, np.full_like(low, (1 << 63) - 1), keep)
            _searched(asked, slab, windows, same=True)
            for key, found in zip(asked.column("key").to_pylist(), windows.found, strict=True):
                out += [(key, i, s) for i, s in zip(*(x.tolist() for x in found[0]), strict=True)]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["key", "positive_id", "positive_score"])
    return find


def _negatives(keep: int, least: int, most: int):
    def find(asked: pa.Table, slab: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and slab.num_rows:
            scores = asked.column("scores").to_pylist()
            count = max(map(len, scores))
            # least * p <= 100 * n <= most * p; windows an anchor does not have are closed
            low = np.array([[-(-least * s // 100) for s in row] + [1] * (count - len(row)) for row in scores], np.int64)
            high = np.array([[most * s // 100 for s in row] + [0] * (count - len(row)) for row in scores], np.int64)
            windows = Windows(low, high, keep)
            _searched(asked, slab, windows, same=False)
            for key, row, found in zip(asked.column("key").to_pylist(), scores, windows.found, strict=True):
                out += [(key, j, i, s) for j in range(len(row)) for i, s in zip(*(x.tolist() for x in found[j]), strict=True)]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["key", "place", "negative_id", "negative_score"])
    return find


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(vector) > 0), F.lit(False))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding, label) where ``anchors`` holds, its first ``positives`` other rows of its
    label, and for each of these the first ``negatives`` rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Fewer rows than asked for give all of them; a positive without negatives
    gives no row.

    A score is the inner product of the components ``floor(scale * x)``, x in double precision; higher scores come first, ties
    by smaller vec_id. Rows with a null vec_id or label, a null or empty vector, or any null or non-finite component take no
    part. Vectors of different widths are separate spaces. A row that is there twice is one row; rows that share only their
    vec_id are rows of their own, but none is the other's positive. A zero vector scores 0 with all. An empty table gives an
    empty result. A score beyond 64 bits is an error, as in other arithmetic. Other columns are not looked at.
    """
    rows = (vectors.withColumn("anchor", F.coalesce(anchors, F.lit(False)))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "anchor", F.size("embedding").alias("width"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("code")).distinct()
            .withColumn("key", F.xxhash64("vec_id", "label", "code")))
    rows = written(rows, "mining-codes")
    sample: dict[int, list] = {}
    for r in rows.orderBy("key").limit(REFERENCES * 8).select("width", "code").collect():
        if any(r.code) and r.code not in sample.setdefault(r.width, []):
            sample[r.width].append(r.code)
    shape = rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    stored = written(rows.mapInArrow(partial(_stored, sample=sample), f"{shape}, norm double, angles array<float>"), "mining-angles")
    asked = stored.filter("anchor")
    blocks = int(asked.count() // ANCHORS) + 1
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    plain = ["vec_id", "label", "code", "norm", "angles"]

    # A label's rows are cut into slabs, and so are its anchors into blocks, by its own counts.
    sizes = stored.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m")).filter("m > 0")
    sized = stored.join(sizes, ["width", "label"])
    parts, groups = (F.floor(F.col(c) / F.lit(k)).cast("int") + 1 for c, k in (("n", SLAB), ("m", ANCHORS)))
    of = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    seeking = (sized.filter("anchor").select("key", *plain, "width", of(groups).alias("block"), parts.alias("parts"))
               .select("*", upto(F.col("parts")).alias("slab")).drop("parts"))
    searched = sized.select(*plain, "width", of(parts).alias("slab"), upto(groups).alias("block"))
    again = lambda df: df.toDF(*df.columns)  # noqa: E731  (columns of its own, for the other side of a cogroup)
    near = (seeking.groupBy("width", "label", "slab", "block").cogroup(again(searched).groupBy("width", "label", "slab", "block"))
            .applyInArrow(_positives(positives), "key long, positive_id long, positive_score long"))
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = written(near.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives), "mining-positives")

    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("found")).select("key", F.col("found.positive_score").alias("scores"))
    slabs = int(stored.count() // SLAB) + 1
    slab = F.pmod(F.xxhash64("key"), F.lit(slabs)).cast("int").alias("slab")
    asking = asked.join(windows, "key").select("key", *plain, "scores", "width", block, F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    far = (asking.groupBy("width", "slab", "block").cogroup(again(stored.select(*plain, "width", slab, every)).groupBy("width", "slab", "block"))
           .applyInArrow(_negatives(negatives, least, most), "key long, place long, negative_id long, negative_score long"))
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = asked.select("key", F.col("vec_id").alias("anchor_id"))
    return (far.join(near, ["key", "place"]).join(names, "key")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
