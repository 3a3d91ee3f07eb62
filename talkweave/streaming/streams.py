"""The streaming operators. All take streaming DataFrames and return streaming DataFrames, except where noted."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import params
from ..operators import aggregates as ag, monitors as mo, reconcile as rc
from ..session import scratch_dir
from .stateful import can_end, end_of_input, run_fold, silence_alerts

__all__ = ["chunk_counts", "rate_drift", "pad_alarm", "sticky_drops", "retry_streaks", "prompts", "reconcile", "drained",
           "new_chunks", "silence_alerts", "provenance", "collect_appended", "collect_latest", "process_landing"]


def rotation_index(ts: Column, start: Column, minutes: int = params.CHUNK_MINUTES) -> Column:
    """Which chunk of a recording begun at ``start`` a moment falls into; chunks are at least ten minutes."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(start)) / (max(minutes, 10) * 60_000_000)).cast("int")


def chunk_counts(events: DataFrame, start: Column, minutes: int = params.CHUNK_MINUTES, late_minutes: int = 10) -> DataFrame:
    """Events per session and chunk, kept up to date; chunks count from ``start``, which may be a column of the session."""
    length = max(minutes, 10)
    index = rotation_index(F.col("ts"), start, minutes)
    begun = F.timestamp_micros(F.unix_micros(start) + index.cast("bigint") * (length * 60_000_000))
    # The event time of a chunk is its begin, so a chunk stays open for its length and the lateness after it.
    at = events.withColumn("chunk_index", index).withColumn("chunk_at", begun)
    counted = at.withWatermark("chunk_at", f"{length + late_minutes} minutes").groupBy("session_id", "chunk_index", "chunk_at").agg(F.count(F.lit(1)).alias("events"))
    return counted.select("session_id", "chunk_index", "events")


LATE = "10 minutes"        # how far rows may come out of order


def _clocked(rows: DataFrame, at: Column | None, otherwise: Column) -> DataFrame:
    return rows.withColumn("event_at", (otherwise if at is None else at).cast("timestamp"))


def _by_ordinal(order: str) -> Column:
    """A clock for buffers that carry none: ten milliseconds a buffer."""
    return F.timestamp_millis(F.col(order) * 10)


def rate_drift(callbacks: DataFrame, keys: list[str], order: str = "cb_ord", at: Column | None = None, late: str = LATE) -> DataFrame:
    """A rebuilt stream must come under a new key, which resets the monitor. Event time is the host clock."""
    types = dict(callbacks.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{order} bigint", "verdict string", "ratio double"])
    fold = partial(mo.DriftFold, keys, order, params.DRIFT_WINDOW_S, params.DRIFT_BAND)
    rows = _clocked(callbacks, at, F.timestamp_micros(F.floor(F.col("host_nanos") / 1000).cast("bigint")))
    return run_fold(rows, keys, [order], fold, "anchor bigint, frames bigint, done boolean", schema, "event_at", late)


def pad_alarm(appends: DataFrame, keys: list[str], order: str = "buffer_ord", at: Column | None = None, late: str = LATE) -> DataFrame:
    types = dict(appends.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{order} bigint", "ratio double", "padded_s double", "total_s double"])
    fold = partial(mo.PadAlarmFold, keys, order)
    return run_fold(_clocked(appends, at, _by_ordinal(order)), keys, [order], fold, "pad bigint, total bigint, done boolean", schema, "event_at", late)


def sticky_drops(buffers: DataFrame, key: str = "session_id", order: str = "buffer_ord", at: Column | None = None, late: str = LATE) -> DataFrame:
    schema = f"{key} int, chunk_index int, {order} bigint, sample_rate int, configured_rate int"
    fold = partial(mo.StickyFold, key, order, params.STICKY_RUN)
    return run_fold(_clocked(buffers, at, _by_ordinal(order)), [key], [order], fold, "rate int, channels int, chunk int, run bigint", schema, "event_at", late)


HOUR_MS = 3_600_000        # rows that come seldom are released by the hour


def retry_streaks(failures: DataFrame, key: str = "session_id", at: str = "failed_at_s", late: str = LATE) -> DataFrame:
    types = dict(failures.dtypes)
    schema = f"{key} {types[key]}, {at} {types[at]}, retry_count bigint, give_up boolean"
    fold = partial(mo.RetryFold, key, at, params.RETRY_DECAY_S, params.RETRY_CAP)
    return run_fold(_clocked(failures, None, F.timestamp_seconds(at)), [key], [at], fold, "last double, streak bigint", schema, "event_at", late, HOUR_MS)


def prompts(signals: DataFrame, cooldown_s: float = params.COOLDOWN_S, late: str = LATE) -> DataFrame:
    rows = _clocked(signals.where("eligible").select("device_id", "signal_ord", "at_s"), None, F.timestamp_seconds("at_s"))
    fold = partial(mo.CooldownFold, cooldown_s)
    return run_fold(rows, ["device_id"], ["at_s", "signal_ord"], fold, "last double", "device_id bigint, signal_ord bigint, at_s double", "event_at", late, HOUR_MS)


def reconcile(voices: DataFrame, threshold: float = params.RECONCILE_COSINE, keep: float = params.RECONCILE_KEEP, late: str = "1 hour") -> DataFrame:
    """Speaker identities as chunks arrive. A chunk's speakers may come in several batches, and chunks out of order: a chunk is
    closed, and matched once, when the watermark has passed its end. Event time is the chunk's place in the meeting."""
    schema = "meeting_id bigint, namespace string, chunk_index int, speaker string, global_speaker string"
    fold = partial(rc.ReferenceVoices, threshold, keep)
    state = "next_number int, known map<string, array<double>>"
    rows = _clocked(voices, None, F.timestamp_seconds(F.col("chunk_index") * (params.CHUNK_MINUTES * 60)))
    return run_fold(rows, rc.CHANNEL, ["chunk_index", "speaker"], fold, state, schema, "event_at", late, params.CHUNK_MINUTES * 60_000, closes=True)


def drained(app: DataFrame, helper: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of both origins as one stream that tolerates disorder up to ``late``."""
    return app.unionByName(helper).withWatermark("ts", late)


def new_chunks(arrivals: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """First arrival of each chunk; a re-ingested orphan within ``late`` is dropped."""
    return arrivals.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def provenance(events: DataFrame, keys: list[str]) -> DataFrame:
    return ag.provenance(events, keys)


ROWLESS = "spark.sql.streaming.noDataMicroBatches.enabled"


def collect_appended(stream: DataFrame, purpose: str) -> DataFrame:
    """Not a stream: run over everything available, then to the end of the input, and return what was emitted.

    Where the end can be told, the first run does not end with a batch without rows: what that would release, the mark's batch does.
    """
    path = scratch_dir(stream.sparkSession, purpose)

    def started() -> StreamingQuery:
        return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state")
                .outputMode("append").trigger(availableNow=True).start())

    if can_end(stream):
        conf = stream.sparkSession.conf
        was = conf.get(ROWLESS)
        conf.set(ROWLESS, "false")
        try:
            first = started()       # keeps the settings it was started with
        finally:
            conf.set(ROWLESS, was)
        first.awaitTermination()
        end_of_input(stream)
    started().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def collect_latest(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Not a stream: run in update mode and return the newest row per key.

    Each micro-batch owns one folder, so a batch that is retried replaces its own output.
    """
    path = scratch_dir(stream.sparkSession, purpose)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run = (stream.writeStream.foreachBatch(store).option("checkpointLocation", path + "-state").outputMode("update")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def process_landing(segments: DataFrame, plan: Callable[[DataFrame], DataFrame], purpose: str) -> DataFrame:
    """Not a stream: the chunks a micro-batch touches go through ``plan``; the rows of every chunk are returned.

    A chunk may land in parts, over several batches: all its rows so far are planned anew, and its newest result counts. A
    segment that lands again (recovered after a crash) replaces its older row.
    """
    path = scratch_dir(segments.sparkSession, purpose)
    chunk, ident = ["meeting_id", "chunk_index"], ["meeting_id", "chunk_index", "source", "seg_ord"]
    rest = [c for c in segments.columns if c not in ident]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}-raw/batch={batch_id}")
        landed = spark.read.parquet(f"{path}-raw").where(F.col("batch") <= batch_id)
        touched = landed.where(F.col("batch") == batch_id).select(*chunk).distinct()
        newest = (landed.join(touched, chunk, "left_semi").groupBy(*ident)
                  .agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*ident, *[F.col(f"v.{c}").alias(c) for c in rest]))
        plan(newest.select(segments.columns)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run = (segments.writeStream.foreachBatch(store).option("checkpointLocation", path + "-state").outputMode("append")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    rows = segments.sparkSession.read.parquet(path)
    newest = rows.groupBy("meeting_id", "chunk_index").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["meeting_id", "chunk_index", "batch"], "left_semi").drop("batch")
