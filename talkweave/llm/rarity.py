"""A global order of hashed values, rarest first, from a fixed table of counts.

Values are counted over all documents in ``CELLS`` cells by hash. The table has the same size whatever the input, so it can
go to the driver and to every task. Order by (count of the cell, value) is the same everywhere, and that is all that a
prefix filter rests on: counts that share a cell cost time, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ragged import U, mix, packed, unpacked

CELL_BITS = 20
CELLS = 1 << CELL_BITS        # 8 MB as 64-bit counts
SLICES = 16


def cell(values: np.ndarray) -> np.ndarray:
    return (mix(values + U(7)) >> U(64 - CELL_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], values: Callable):
    table, any_rows = np.zeros(CELLS, np.int64), False
    for found in values(batches):
        table += np.bincount(cell(found), minlength=CELLS)
        any_rows = True
    if any_rows:
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([packed(part) for part in np.split(table, SLICES)], pa.binary())], names=["slice", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.int64)
    for part in table.column("counts").to_pylist():
        total += unpacked(part)
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": [packed(total)]})


def cell_counts(rows: DataFrame, values: Callable) -> np.ndarray:
    """How often the values fall into each cell; ``values`` turns a task's Arrow batches into arrays of 64-bit values."""
    parts = rows.mapInArrow(partial(_counted, values=values), "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()
    out = np.zeros(CELLS, np.int64)
    for row in parts:
        out[row["slice"] * (CELLS // SLICES):][:CELLS // SLICES] = unpacked(row["counts"])
    return out


def rarest(owner: np.ndarray, value: np.ndarray, counts: np.ndarray, keep: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Indices of the ``keep[o]`` rarest values of each owner ``o``; values marked ``last`` come after all others."""
    weight = counts[cell(value)]
    if last is not None:
        weight = np.where(last, np.iinfo(np.int64).max, weight)
    order = np.lexsort((value, weight, owner))
    start = np.searchsorted(owner[order], np.arange(len(keep)))
    return order[np.arange(len(order)) - start[owner[order]] < keep[owner[order]]]
