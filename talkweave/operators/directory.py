"""Lookups against calendars, crash reports, manifests and model lists."""

from __future__ import annotations

from collections import deque
from functools import partial
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from .intervals import neighbours
from .ordered import Fold, sorted_fold


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c)) / F.lit(1e6)


class CalendarFold(Fold):
    """A sweep over the begins of events and the moments of meetings. Rows: at, asks, cal_id, till, and the meeting's identity.

    The running event begun last tops the heap; ended ones are dropped as they come up, for time only moves on. Meetings that
    nothing runs at wait for the next begin, no longer than the look-ahead.
    """

    def __init__(self, keys: list[str], ident: list[str], lookahead: int):
        self.names, self.lookahead = [*keys, *ident], lookahead
        self.running: list[tuple] = []
        self.waiting: deque = deque()

    def push(self, row):
        out = []
        if not row.asks:
            # The first begin after a meeting decides it; events of one begin come by cal_id.
            while self.waiting and self.waiting[0].at < row.at:
                asked = self.waiting.popleft()
                if row.at <= asked.at + self.lookahead:
                    out.append(self.picked(asked, row.cal_id, False, row.at))
            if row.till > row.at:
                heappush(self.running, (-row.at, row.cal_id, row.till))
            return out
        while self.running and self.running[0][2] <= row.at:
            heappop(self.running)
        if self.running:
            begun, cal_id, _ = self.running[0]
            return [self.picked(row, cal_id, True, -begun)]
        while self.waiting and self.waiting[0].at + self.lookahead < row.at:
            self.waiting.popleft()
        self.waiting.append(row)
        return out

    def picked(self, row, cal_id, running, begin):
        return (*[getattr(row, k) for k in self.names], cal_id, running, begin)


def calendar_pick(meetings: DataFrame, events: DataFrame, keys: list[str], ident: list[str],
                  lookahead_min: int = params.LOOKAHEAD_MINUTES, width_s: int = 3600) -> DataFrame:
    """The event a meeting belongs to: the running one begun last, else the next one within the look-ahead.

    Nothing is paired: meetings and events are swept once in time order, by key and hour. An event is met in every hour that it
    runs in, or that a meeting may look ahead from.
    """
    width, lookahead = width_s * 1_000_000, lookahead_min * 60_000_000
    hour = lambda at: F.floor(at / F.lit(width)).cast("bigint")
    types = dict(events.dtypes) | dict(meetings.dtypes)
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    # Columns of the other side hold a value rather than null: a column with nulls reaches Python as floats.
    blank = lambda c: F.lit(0).cast(types[c]).alias(c)
    begin = F.unix_micros("starts_at")
    till = F.coalesce(F.unix_micros("ends_at"), begin)
    timed = events.where(some & F.expr("NOT all_day AND NOT declined AND starts_at IS NOT NULL")).select(
        *keys, F.explode(F.sequence(hour(begin - lookahead), hour(F.greatest(begin, till - 1)))).alias("hour"), begin.alias("at"),
        F.lit(False).alias("asks"), "cal_id", till.alias("till"), *[blank(c) for c in ident])
    now = F.unix_micros("now")
    asked = meetings.where(some & F.col("now").isNotNull()).select(
        *keys, hour(now).alias("hour"), now.alias("at"), F.lit(True).alias("asks"), blank("cal_id"), F.lit(0).cast("bigint").alias("till"), *ident)
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*keys, *ident)], f"cal_id {types['cal_id']}", "running boolean", "begin bigint"])
    found = sorted_fold(timed.unionByName(asked), [*keys, "hour"], ["at", "asks", "cal_id"], partial(CalendarFold, keys, ident, lookahead), schema)
    rank = F.struct("running", F.when(F.col("running"), F.col("begin")).otherwise(-F.col("begin")), -F.col("cal_id"))
    best = found.groupBy(*keys, *ident).agg(F.max_by(F.struct("cal_id", "running"), rank).alias("b"))
    return best.select(*keys, *ident, "b.*")


def crash_class(interruptions: DataFrame, reports: DataFrame, keys: list[str], tokens: tuple[str, ...], window_s: float) -> DataFrame:
    """``likelyCrash`` where a matching report was written within the window before the interruption."""
    lower = F.lower("report_name")
    named = F.lit(False)
    for token in tokens:
        named = named | lower.contains(token.lower())
    r = reports.where(named).select(*keys, _seconds("modified").alias("r0"), _seconds("modified").alias("r1"))
    asked = interruptions.withColumn("__at", _seconds("now"))
    # The newest report up to the interruption decides, so a scan in time order is enough: no pairs are formed.
    seen = neighbours(asked, "__at", r, keys, "r0", "r1", F.struct(F.col("r1").alias("at")), F.struct(F.col("r0").alias("at")))
    fresh = F.coalesce(F.col("__at") - F.col("before.at") <= window_s, F.lit(False))
    return seen.select(*interruptions.columns, F.when(fresh, "likelyCrash").otherwise("transientBlip").alias("verdict"))


def manifest_check(manifest: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """ok / missing / corrupt per file. Contents are hashed where they are read; only digests move."""
    inv = inventory.select(*keys, F.col("size").alias("real_size"), F.sha2("content", 256).alias("digest"))
    both = manifest.join(inv, keys, "left")
    state = (F.when(F.col("real_size").isNull(), "missing").when(F.col("real_size") != F.col("size"), "corrupt")
             .when(F.col("digest") != F.col("sha256"), "corrupt").otherwise("ok"))
    return both.select(*keys, state.alias("state"))


def update_status(manifests: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads(repo, head_sha, checked)``: a repo without a row, or without a sha, could not be checked."""
    both = manifests.join(heads, "repo", "left")
    state = (F.when(F.coalesce(F.col("commit_sha"), F.lit("")) == "", "noBaseline").when(F.col("head_sha").isNull(), "checkFailed")
             .when(F.col("head_sha") == F.col("commit_sha"), "upToDate").otherwise("updateAvailable"))
    return both.select("repo", state.alias("status"))


def model_states(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """Load state by bare id or ``publisher/id``; the first listing wins. Both keys are exploded into one equi-join."""
    names = F.array(F.col("id"), F.concat_ws("/", "publisher", "id"))
    keyed = listed.select(F.explode(names).alias("model"), "list_ord", "loaded", "loaded_context")
    first = keyed.groupBy("model").agg(F.min_by(F.struct("loaded", F.when(F.col("loaded"), F.col("loaded_context")).alias("loaded_context")), "list_ord").alias("s"))
    return requests.join(first, "model", "left").select(*requests.columns, "s.loaded", "s.loaded_context")
