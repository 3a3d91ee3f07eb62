"""Nearest vectors by cosine with a hash-prefix forest.

A vector has one long bit string per tree: the signs of its products with random directions. Vectors are dealt into index
parts of about ``PART`` rows; a part holds, for each tree, its bit strings in order. A query goes down every tree to the
strings with the longest common prefix with its own, then all trees go up together, one bit at a time, until enough
candidates are met. Candidates are ranked by their exact cosines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = 4096            # vectors of an index part
QUERIES = 1024         # queries that a task answers from one part
TREES = 24
BITS = 48              # length of a bit string
SHARE = 0.6            # candidates to meet before a query stops going up, as a share of its part; unclustered vectors need
                       # that many for a recall of 0.9
SEED = 7


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(TREES * BITS, width))


def bit_strings(vectors: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """(trees, vectors): the first bit of a string is the highest of the BITS used."""
    signs = (vectors @ lines.T > 0).reshape(len(vectors), TREES, BITS)
    return (signs.astype(np.uint64) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).sum(2, dtype=np.uint64).T


class Forest:
    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        strings = bit_strings(vectors, lines)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def candidates(self, strings: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query (trees, queries) the positions met when the trees, going up together, have ``enough`` of them."""
        n, q = self.sorted.shape[1], strings.shape[1]
        low, high = np.zeros((TREES, BITS + 1, q), np.int32), np.full((TREES, BITS + 1, q), n, np.int32)
        for t in range(TREES):       # the run of strings that share each prefix length with the query
            for depth in range(1, BITS + 1):
                cut = np.uint64(BITS - depth)
                head = strings[t] >> cut << cut
                low[t, depth] = np.searchsorted(self.sorted[t], head)
                high[t, depth] = np.searchsorted(self.sorted[t], head + (np.uint64(1) << cut))
        out = []
        for k in range(q):
            met = np.zeros(n, bool)
            depth = int(np.flatnonzero((high[:, :, k] > low[:, :, k]).any(0)).max())     # the longest match of any tree
            while depth >= 0:
                for t in range(TREES):
                    met[self.order[t, low[t, depth, k]:high[t, depth, k]]] = True
                if depth == 0 or met.sum() >= enough:
                    break
                depth -= 1
            out.append(np.flatnonzero(met))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _answered(top: int):
    def answer(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "asked": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not index.num_rows or not asked.num_rows:
            return none
        vectors, queries = _matrix(index.column("vector")), _matrix(asked.column("vector"))
        lines = directions(vectors.shape[1])
        forest = Forest(vectors, lines)
        ids, wanted, name = np.asarray(index.column("vec_id")), np.asarray(asked.column("vec_id")), np.asarray(asked.column("asked"))
        length, own = np.sqrt((vectors ** 2).sum(1)), np.sqrt((queries ** 2).sum(1))
        rows = []
        for k, met in enumerate(forest.candidates(bit_strings(queries, lines), max(4 * top, int(SHARE * len(ids))))):
            met = met[ids[met] != wanted[k]]
            score = (vectors[met] * queries[k]).sum(1) / (length[met] * own[k])
            best = np.lexsort((ids[met], -score))[:top]
            rows.append((np.full(len(best), wanted[k]), np.full(len(best), name[k]), ids[met][best], score[best]))
        q, a, v, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.table({"query_id": q, "asked": a, "vec_id": v, "score": s})
    return answer


def sound(vector: Column) -> Column:
    """Whether a vector can take part: not null, not empty, only finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` nearest rows of ``vectors`` found for each row of ``queries`` (both: vec_id, embedding): query_id, rank
    from 1, vec_id, score (exact cosine in double precision of the original vectors); ties to the smaller vec_id.

    Every sound vector is indexed; a query does not meet rows with its own id. Rows with a null id, or a vector that is
    null, empty, zero or holds null or non-finite components, take no part. Vectors of different widths are separate
    spaces. Equal vectors of different ids are all found alike; a repeated id is one row per copy. A query row that is
    repeated is asked once; rows of one id with different vectors are each asked, and ranked apart. Fewer candidates than
    ``top`` give fewer rows; an empty table gives an empty result. Queries are an explicit set; they meet the index part
    by part, in blocks.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        vector = F.transform("embedding", lambda x: x.cast("double"))
        return df.filter(F.col("vec_id").isNotNull() & sound(F.col("embedding"))).select("vec_id", vector.alias("vector"), F.size("embedding").alias("width"))

    index = cleaned(vectors)
    asked = cleaned(queries).withColumn("asked", F.xxhash64("vector")).dropDuplicates(["vec_id", "asked"])
    parts, blocks = int(index.count() // PART) + 1, int(asked.count() // QUERIES) + 1
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    laid = index.select("width", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector")
    dealt = asked.select("width", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block"), "vec_id", "asked", "vector")
    found = (laid.groupBy("width", "part", "block").cogroup(dealt.groupBy("width", "part", "block"))
             .applyInArrow(_answered(top), "query_id long, asked long, vec_id long, score double"))
    rank = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
