"""Greedy chains: the first row, then always the next row at least ``gap`` after the last one taken.

Each link depends on the one before, yet a long history need not pass through one task. Inside a block of time the
chain is a function of the moment from which it may continue, and chains that enter a block early on soon meet. So
every block reports how it would be left for each way it can be entered (a few rows), these reports are walked in
order, and then every block picks its own links.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ordered import Fold, sorted_fold

BLOCK_GAPS = 512


def _links(at: np.ndarray, gap) -> np.ndarray:
    return np.searchsorted(at, at + gap, side="left")


def _passages(pdf: pd.DataFrame, keys: list[str], gap, width) -> pd.DataFrame:
    """(entry_at, exit_due) per distinguishable way into the block; a way serves every moment up to its entry_at."""
    at = np.sort(pdf["at"].to_numpy())
    nxt, n = _links(at, gap), len(at)
    due = np.empty(n, dtype=at.dtype)
    for i in range(n - 1, -1, -1):
        due[i] = at[i] + gap if nxt[i] == n else due[nxt[i]]
    block = int(pdf["block"].iloc[0])
    ways = np.searchsorted(at, block * width + gap, side="left") + 1
    entry, leave = at[:ways], due[:ways]
    last_of_run = np.append(leave[1:] != leave[:-1], True)
    out = pd.DataFrame({"block": block, "entry_at": entry[last_of_run], "exit_due": leave[last_of_run]})
    for k in reversed(keys):
        out.insert(0, k, pdf[k].iloc[0])
    return out


class Walk(Fold):
    """From block to block: the moment from which the chain may continue in each."""

    def __init__(self, keys: list[str]):
        self.keys, self.due, self.block, self.passed = keys, None, None, False

    def push(self, row):
        out = []
        if row.block != self.block:
            self.block, self.passed = row.block, False
            opening = self.due is None
            out = [(*[getattr(row, k) for k in self.keys], row.block, opening, 0 if opening else self.due)]
        if not self.passed and (self.due is None or row.entry_at >= self.due):
            self.due, self.passed = row.exit_due, True
        return out


def _taken(pdf: pd.DataFrame, keys: list[str], order: str, gap) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", order], kind="stable")
    at = pdf["at"].to_numpy()
    nxt, picked = _links(at, gap), []
    i = 0 if pdf["opening"].iloc[0] else int(np.searchsorted(at, pdf["due"].iloc[0], side="left"))
    while i < len(at):
        picked.append(i)
        i = int(nxt[i])
    return pdf.iloc[picked][[*keys, order, "at"]]


def greedy_chain(rows: DataFrame, keys: list[str], at: str, order: str, gap) -> DataFrame:
    """keys, ``order``, ``at`` of the rows on each key's chain; of rows at the same moment the lowest ``order`` counts.

    ``at`` is BIGINT or DOUBLE; ``gap`` is in its unit.
    """
    types = dict(rows.dtypes)
    width = gap * BLOCK_GAPS
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    moments = rows.groupBy(*keys, F.col(at).alias("at")).agg(F.min(order).alias(order))
    blocked = moments.withColumn("block", F.floor(F.col("at") / F.lit(width)).cast("bigint"))

    def passages(pdf: pd.DataFrame) -> pd.DataFrame:
        return _passages(pdf, keys, gap, width)

    def taken_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        return _taken(pdf, keys, order, gap)

    ways = blocked.select(*keys, "block", "at").groupBy(*keys, "block").applyInPandas(
        passages, f"{key_types}, block bigint, entry_at {types[at]}, exit_due {types[at]}")
    entries = sorted_fold(ways, keys, ["block", "entry_at"], partial(Walk, keys), f"{key_types}, block bigint, opening boolean, due {types[at]}")
    taken = blocked.join(entries, [*keys, "block"]).groupBy(*keys, "block").applyInPandas(
        taken_rows, f"{key_types}, {order} {types[order]}, at {types[at]}")
    return taken.withColumnRenamed("at", at)
