"""Capture-quality monitors over whole histories. The streaming forms live in ``talkweave.streaming``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions.timing import iso8601
from .chains import greedy_chain
from .ordered import Fold, Scan, block_scan, blocks_of, numbered, previous, sorted_fold

ORD_BLOCK = 65_536


def event_json(detail: Column | None = None) -> Column:
    """One diagnostics line: keys in alphabetical order, whole-second time."""
    empty = F.create_map().cast("map<string,string>")
    return F.to_json(F.struct((detail if detail is not None else empty).alias("detail"), "kind", "origin", "severity",
                              iso8601(F.col("ts")).alias("timestamp")))


def merged_in_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two event streams of a session as one, numbered by time; the first stream goes first on a tie."""
    both = a.withColumn("stream", F.lit(0)).unionByName(b.withColumn("stream", F.lit(1)))
    return numbered(both, ["session_id"], ["ts", "stream", "event_ord"], "place", blocks_of(F.unix_seconds("ts"), 3600))


def retained(events: DataFrame, cost: Column, max_events: int = params.RING_EVENTS, max_bytes: int = params.RING_BYTES) -> DataFrame:
    """What a ring bounded by count and bytes still holds; the newest event always stays."""
    newest = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), F.col("event_ord").desc())
    # Ranks are cut before the shuffle, so a session's history shrinks to the ring before any bytes are added up.
    ring = events.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max(max_events, 1)).withColumn("cost", cost)
    held = ring.withColumn("__b", F.sum(F.col("cost").cast("bigint")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return held.where((F.col("__n") == 1) | (F.col("__b") <= max_bytes)).drop("__n", "__b")


def retry_streaks(failures: DataFrame, key: str = "session_id", at: str = "failed_at_s",
                  decay: float = params.RETRY_DECAY_S, cap: int = params.RETRY_CAP, ties: tuple[str, ...] = ()) -> DataFrame:
    """Length of the failure streak at each failure; a gap beyond ``decay`` starts a new one. ``ties`` order failures of one moment."""
    order = [at, *ties]
    block = blocks_of(F.col(at), decay * 1024)
    scans = [previous("__p", F.col(at)), Scan("__rn", "sum", F.lit(1).cast("bigint"))]
    seen = block_scan(failures, [key], order, scans, block)
    fresh = F.col("__p.v").isNull() | (F.col(at) - F.col("__p.v") > decay)
    marked = seen.withColumn("__s", F.when(fresh, F.col("__rn"))).drop("__p")
    out = block_scan(marked, [key], order, [Scan("__start", "last", F.col("__s"))], block)
    count = F.col("__rn") - F.col("__start") + 1
    return out.select(*failures.columns, count.alias("retry_count"), (count > cap).alias("give_up"))


def same_format(a_rate: Column, a_channels: Column, b_rate: Column, b_channels: Column) -> Column:
    return (a_rate == b_rate) & (a_channels == b_channels)


def format_changes(buffers: DataFrame, keys: list[str], order: str = "buffer_ord") -> DataFrame:
    """first / unchanged / changed against the buffer before."""
    seen = block_scan(buffers, keys, [order], [previous("__p", F.struct("sample_rate", "channels"))], blocks_of(F.col(order), ORD_BLOCK))
    p = F.col("__p.v")
    same = same_format(p["sample_rate"], p["channels"], F.col("sample_rate"), F.col("channels"))
    state = F.when(p.isNull(), "first").when(same, "unchanged").otherwise("changed")
    return seen.withColumn("observation", state).withColumn(
        "from_rate", F.when(state == "changed", p["sample_rate"])).drop("__p")


def sticky_drops(buffers: DataFrame, session: list[str], chunk: list[str], order: str = "buffer_ord",
                 run: int = params.STICKY_RUN) -> DataFrame:
    """One row per run of at least ``run`` buffers whose format is not the session's first one."""
    first = buffers.groupBy(*session).agg(F.min_by(F.struct("sample_rate", "channels"), order).alias("cfg"))
    rows = buffers.join(first, session)
    ok = same_format(F.col("cfg.sample_rate"), F.col("cfg.channels"), F.col("sample_rate"), F.col("channels"))
    block = blocks_of(F.col(order), ORD_BLOCK)
    counted = numbered(rows.withColumn("__ok", ok), chunk, [order], "__rn", block)
    held = block_scan(counted.withColumn("__a", F.when(F.col("__ok"), F.col("__rn"))), chunk, [order], [Scan("__last_ok", "last", F.col("__a"))], block)
    length = F.col("__rn") - F.coalesce("__last_ok", F.lit(0))
    return held.where(~F.col("__ok") & (length == run)).select(*buffers.columns, F.col("cfg.sample_rate").alias("configured_rate"))


def target_frames(buffers: DataFrame, chunk: list[str], at: str = "pts_s", order: str = "buffer_ord") -> DataFrame:
    """Frame at which each buffer belongs on the chunk's timeline, whose zero is the chunk's first buffer of any track.

    Null where the distance is negative or a day or more: such a buffer asks for no silence.
    """
    anchor = buffers.groupBy(*chunk).agg(F.min_by(at, order).alias("__a"))
    delta = F.col(at) - F.col("__a")
    plausible = (delta >= 0) & (delta < params.PAD_MAX_DELTA_S)
    return buffers.join(anchor, chunk).withColumn(
        "target_frame", F.when(plausible, F.round(delta * F.col("rate")).cast("bigint"))).drop("__a")


def silence_padding(buffers: DataFrame, keys: list[str], order: str = "buffer_ord") -> DataFrame:
    """Silence put before each buffer so that it lands on its target frame; at most 60 s at a time.

    Without the limit the padding is the growth of a running maximum. Only keys where the limit bites are replayed
    buffer by buffer.
    """
    block = blocks_of(F.col(order), ORD_BLOCK)
    summed = block_scan(buffers, keys, [order], [Scan("__s", "sum", F.col("data_frames"), inclusive=False)], block)
    need = F.coalesce(F.greatest(F.col("target_frame") - F.col("__s"), F.lit(0)), F.lit(0)).cast("bigint")
    ahead = summed.withColumn("__need", need)
    scans = [Scan("__g", "max", F.col("__need")), Scan("__h", "max", F.col("__need"), inclusive=False)]
    grown = block_scan(ahead, keys, [order], scans, block)
    padded = grown.withColumn("pad_frames", (F.col("__g") - F.coalesce("__h", F.lit(0))).cast("bigint")).drop("__s", "__need", "__g", "__h")
    return padded


def clamped_padding(buffers: DataFrame, keys: list[str], order: str = "buffer_ord") -> DataFrame:
    """``silence_padding`` with the 60 s limit applied exactly."""
    free = silence_padding(buffers, keys, order)
    over = free.where(F.col("pad_frames") > F.col("rate") * params.PAD_CLAMP_S).select(*keys).distinct()
    fine = free.join(over, keys, "left_anti")
    replayed = replay_padding(buffers.join(over, keys, "left_semi"), keys, order)
    return fine.select(*keys, order, "pad_frames").unionByName(replayed)


class PaddingFold(Fold):
    def __init__(self, keys: list[str], order: str, limit_s: float):
        self.keys, self.order, self.limit_s, self.written = keys, order, limit_s, 0

    def push(self, row):
        missing = row.target_frame != row.target_frame or row.target_frame is None
        pad = 0 if missing else max(0, min(int(row.target_frame) - self.written, int(row.rate * self.limit_s)))
        self.written += pad + int(row.data_frames)
        return [(*[getattr(row, k) for k in self.keys], getattr(row, self.order), pad)]


def replay_padding(buffers: DataFrame, keys: list[str], order: str = "buffer_ord") -> DataFrame:
    types = dict(buffers.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{order} {types[order]}", "pad_frames bigint"])
    rows = buffers.select(*keys, order, "target_frame", "data_frames", "rate")
    return sorted_fold(rows, keys, [order], partial(PaddingFold, keys, order, params.PAD_CLAMP_S), schema)


def pad_alarm(appends: DataFrame, keys: list[str], order: str = "buffer_ord") -> DataFrame:
    """First append of a track and chunk at which too much of it is fabricated silence."""
    pad = F.greatest(F.col("pad_frames"), F.lit(0))
    data = F.greatest(F.col("data_frames"), F.lit(0))
    live = appends.where("rate > 0")
    scans = [Scan("__p", "sum", pad.cast("bigint")), Scan("__t", "sum", (pad + data).cast("bigint"))]
    run = block_scan(live, keys, [order], scans, blocks_of(F.col(order), ORD_BLOCK))
    total_s, padded_s = F.col("__t") / F.col("rate"), F.col("__p") / F.col("rate")
    bad = ((F.col("__t") > 0) & (total_s >= params.PAD_MIN_TOTAL_S) & (padded_s >= params.PAD_MIN_PADDED_S)
           & (F.col("__p") > F.col("__t") * params.PAD_RATIO))
    first = run.where(bad).groupBy(*keys).agg(F.min_by(F.struct(
        order, F.try_divide(F.col("__p"), F.col("__t")).alias("ratio"), padded_s.alias("padded_s"), total_s.alias("total_s")), order).alias("f"))
    return first.select(*keys, "f.*")


class DriftFold(Fold):
    """Stream form of :func:`rate_drift`: effective rate over windows of at least five seconds; reports the first window outside the band."""

    def __init__(self, keys: list[str], order: str, window_s: float, band: tuple[float, float]):
        self.keys, self.order, self.window_s, self.band = keys, order, window_s, band
        self.anchor, self.frames, self.done = None, 0, False

    def push(self, row):
        if self.done or not row.declared_rate > 0:
            return ()
        self.frames += int(row.frames)
        now = int(row.host_nanos)
        if self.anchor is None:
            self.anchor = now
            return ()
        elapsed = (now - self.anchor) / 1e9
        if elapsed < self.window_s:
            return ()
        ratio = self.frames / elapsed / row.declared_rate
        healthy = self.band[0] <= ratio <= self.band[1]
        out = (*[getattr(row, k) for k in self.keys], int(getattr(row, self.order)), "healthy" if healthy else "drift", float(ratio))
        self.anchor, self.frames, self.done = now, 0, not healthy
        return [out]

    def snapshot(self):
        return self.anchor, self.frames, self.done

    def restore(self, kept):
        self.anchor, self.frames, self.done = kept


class PadAlarmFold(Fold):
    """Stream form of :func:`pad_alarm`: reports once."""

    def __init__(self, keys: list[str], order: str):
        self.keys, self.order = keys, order
        self.ratio, self.min_total_s, self.min_padded_s = params.PAD_RATIO, params.PAD_MIN_TOTAL_S, params.PAD_MIN_PADDED_S
        self.pad, self.total, self.done = 0, 0, False

    def push(self, row):
        if self.done or not row.rate > 0:
            return ()
        self.pad += max(0, int(row.pad_frames))
        self.total += max(0, int(row.pad_frames)) + max(0, int(row.data_frames))
        padded_s, total_s = self.pad / row.rate, self.total / row.rate
        self.done = self.total > 0 and total_s >= self.min_total_s and padded_s >= self.min_padded_s and self.pad > self.total * self.ratio
        if not self.done:
            return ()
        return [(*[getattr(row, k) for k in self.keys], int(getattr(row, self.order)), self.pad / self.total, padded_s, total_s)]

    def snapshot(self):
        return self.pad, self.total, self.done

    def restore(self, kept):
        self.pad, self.total, self.done = kept


class StickyFold(Fold):
    """Stream form of :func:`sticky_drops`: the first format of the session is the configured one."""

    def __init__(self, key: str, order: str, limit: int):
        self.key, self.order, self.limit = key, order, limit
        self.rate, self.channels, self.chunk, self.run = None, None, None, 0

    def push(self, row):
        if self.rate is None:
            self.rate, self.channels = int(row.sample_rate), int(row.channels)
        if self.chunk != row.chunk_index:
            self.chunk, self.run = int(row.chunk_index), 0
        same = row.sample_rate == self.rate and row.channels == self.channels
        self.run = 0 if same else self.run + 1
        if self.run != self.limit:
            return ()
        return [(int(getattr(row, self.key)), self.chunk, int(getattr(row, self.order)), int(row.sample_rate), self.rate)]

    def snapshot(self):
        return self.rate, self.channels, self.chunk, self.run

    def restore(self, kept):
        self.rate, self.channels, self.chunk, self.run = kept


class RetryFold(Fold):
    """Stream form of :func:`retry_streaks`."""

    def __init__(self, key: str, at: str, decay: float, cap: int):
        self.key, self.at, self.decay, self.cap = key, at, decay, cap
        self.last, self.streak = None, 0

    def push(self, row):
        at = getattr(row, self.at)
        decayed = self.last is not None and at - self.last > self.decay
        self.streak = 1 if decayed else self.streak + 1
        self.last = float(at)
        return [(getattr(row, self.key), at, self.streak, self.streak > self.cap)]

    def snapshot(self):
        return self.last, self.streak

    def restore(self, kept):
        self.last, self.streak = kept


def rate_drift(callbacks: DataFrame, keys: list[str], order: str = "cb_ord") -> DataFrame:
    """Verdict at the end of every window, up to and including the first drift. A rebuild is a new key.

    Windows end at the links of a greedy chain over the callback times; frames per window come from running sums.
    """
    live = callbacks.where("declared_rate > 0").select(*keys, order, "host_nanos", "declared_rate", "frames")
    block = blocks_of(F.col(order), ORD_BLOCK)
    summed = block_scan(live, keys, [order], [Scan("__s", "sum", F.col("frames").cast("bigint"))], block)
    links = greedy_chain(live, keys, "host_nanos", order, int(params.DRIFT_WINDOW_S * 1_000_000_000)).select(*keys, order)
    ends = summed.join(links, [*keys, order])
    scans = [previous("__p", F.struct("host_nanos", "__s", "frames")), Scan("__k", "sum", F.lit(1).cast("bigint"))]
    seen = block_scan(ends, keys, [order], scans, block).where("__k > 1")
    p = F.col("__p.v")
    # The first window also counts the frames of the callback it starts with.
    frames = F.col("__s") - p["__s"] + F.when(F.col("__k") == 2, p["frames"]).otherwise(0)
    elapsed = (F.col("host_nanos") - p["host_nanos"]) / F.lit(1e9)
    judged = seen.withColumn("ratio", frames / elapsed / F.col("declared_rate"))
    judged = judged.withColumn("verdict", F.when(F.col("ratio").between(*params.DRIFT_BAND), "healthy").otherwise("drift"))
    stop = judged.where("verdict = 'drift'").groupBy(*keys).agg(F.min(order).alias("__stop"))
    latched = judged.join(stop, keys, "left").where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    return latched.select(*keys, order, "verdict", "ratio")


class CooldownFold(Fold):
    """Stream form of :func:`prompts`: a prompt silences the following ones until the cooldown has passed since that prompt."""

    def __init__(self, cooldown_s: float):
        self.cooldown_s, self.last = cooldown_s, None

    def push(self, row):
        if self.last is not None and row.at_s - self.last < self.cooldown_s:
            return ()
        self.last = float(row.at_s)
        return [(row.device_id, row.signal_ord, row.at_s)]

    def snapshot(self):
        return (self.last,)

    def restore(self, kept):
        (self.last,) = kept


def meeting_signal(prompting: Column, recording: Column, mic: Column, app: Column) -> Column:
    return prompting & ~recording & mic & app


def prompts(signals: DataFrame, cooldown_s: float = params.COOLDOWN_S) -> DataFrame:
    """Prompts per device: a greedy chain over the signals that could prompt."""
    rows = signals.where("eligible").select("device_id", "signal_ord", "at_s")
    return greedy_chain(rows, ["device_id"], "at_s", "signal_ord", float(cooldown_s))


def alive(arrivals: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Did anything arrive after the probe started?"""
    last = arrivals.groupBy(*keys).agg(F.max("arrived").alias("last_arrival"))
    return probes.join(last, keys, "left").withColumn("resumed", F.coalesce(F.col("last_arrival") > F.col("probe_start"), F.lit(False)))


def clock_risk(rate: Column, bluetooth: Column, virtual: Column, drifting: Column) -> Column:
    """Why a device's clock should not be trusted, or ``keep``; the most specific reason wins."""
    return (F.when(drifting, "drift").when(rate.isin(*params.HANDS_FREE_RATES), "degraded_rate")
            .when(bluetooth, "bluetooth").when(virtual, "virtual").otherwise("keep"))
