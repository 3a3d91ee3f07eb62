"""Per-key state machines on ``transformWithStateInPandas``, fed in event-time order.

The machines are the same folds the batch operators replay, so stream and batch cannot drift apart. Rows may arrive in any
order within the lateness the stream allows: rows wait in state, and event-time timers release a bucket of event time, sorted, once
the watermark has passed its end. State is kept by slot, a hash of the key. What a worker holds at once is some ``PACK`` rows of a slot
and the pieces that overlap them in time, and the small state of the slot's keys. A key that has been silent for ``KEEP_MS`` of event
time is forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructField, StructType

from ..operators.ordered import Fold
from ..session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_MS = 10_000              # event time of the rows that are released together
KEEP_MS = 24 * 3_600_000        # silence after which a key's state ends
PACK = 10_000                   # rows that are handed over together, whole buckets
PIECE = 1_000                   # rows that wait together, whole buckets
SLOTS = 4_096                   # sets of keys that share their state
SLOT = "__slot"
END = "2300-01-01"              # event time of the mark at the end of the input
ENDED_MS = 10_382_256_000_000   # 2299-01-01: watermarks beyond are of that mark

_MARKS: WeakKeyDictionary[DataFrame, tuple] = WeakKeyDictionary()     # where the end of a stream's input is told


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Released(StatefulProcessor):
    """Hands the rows of keys to ``ordered`` in the order of bucket and ``order``, as the watermark passes.

    ``at_ms`` is the rows' event time. Rows without one, and rows of a null key (marks that only move the watermark on), are not
    held. A row that comes after its bucket was released is dropped, as Spark drops late rows. Calls to the state are what costs, so
    their number must not follow keys times buckets: keys share a slot, whose rows wait in pieces of some ``PIECE`` rows, whole buckets,
    sorted. A slot has one timer, for the next thing it has to do, and one value that says which pieces wait (number, first and last
    bucket) and which keys are known (the time of their last released row, and whether their silence was told).
    """

    def __init__(self, keys: StructType, order: list[str], bucket_ms: int = BUCKET_MS, keep_ms: int = KEEP_MS):
        self.keys, self.order, self.bucket_ms, self.keep_ms = keys.names, order, bucket_ms, keep_ms
        self.whole = [f.name for f in keys.fields if isinstance(f.dataType, IntegralType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "piece bigint", "rows binary")
        self.seen = handle.getValueState("seen", "slot binary")

    def ordered(self, known: dict, rows: dict[str, np.ndarray], runs: list[tuple]) -> Iterator[pd.DataFrame]:
        """``runs``: key, begin and end of the rows of a key (and bucket, if ``apart``). Sets their keys in ``known``."""
        raise NotImplementedError

    apart = False       # whether the buckets of a key are runs of their own

    def leave(self, known: dict, ended: list[tuple]) -> None:
        """The slot is done for now; the keys ``ended`` are no longer known."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        released, number, pieces, known, timer = self._slot() or (-1 << 62, 0, [], {}, None)
        for batch in rows:
            if batch["at_ms"].hasnans:
                batch = batch[batch["at_ms"].notna()]
            bucket = batch["at_ms"].to_numpy().astype("int64") // self.bucket_ms
            place = np.argsort(bucket, kind="stable")
            place = place[np.searchsorted(bucket[place], released, side="right"):]
            bucket = bucket[place]
            columns = {c: batch[c].to_numpy()[place] for c in batch.columns if c != SLOT}
            columns.update({k: columns[k].astype("int64") for k in self.whole})
            begin = 0
            while begin < len(bucket):
                end = int(np.searchsorted(bucket, bucket[min(begin + PIECE, len(bucket)) - 1], side="right"))
                self._hold(pieces, number, {c: v[begin:end] for c, v in columns.items()}, bucket[begin:end])
                number, begin = number + 1, end
        if pieces or known:
            self._leave(released, number, pieces, known, timer)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = self._slot()
        if slot is None:
            return
        released, number, pieces, known, _ = slot
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        last = now // self.bucket_ms - 1        # the last bucket that has ended
        due, rest = [p for p in pieces if p[1] <= last], [p for p in pieces if p[1] > last]
        for columns, bucket in self._released(due, last, rest):
            order = self._sorted(columns, bucket)
            columns, bucket = {c: v[order] for c, v in columns.items()}, bucket[order]
            yield from self.ordered(known, columns, self._runs(columns, bucket))
            released = max(released, int(bucket.max()))
        ended = [k for k, (at, _) in known.items() if at + self.keep_ms <= now]
        silent = [k for k in known if self.is_silent(known[k], now)]
        waiting = self._waiting(rest) if ended or silent else {}
        yield from self.silent(known, [k for k in silent if k not in waiting or waiting[k] * self.bucket_ms > self.wakes(known[k])])
        ended = [k for k in ended if k not in waiting]
        self.leave(known, ended)
        for k in ended:
            del known[k]
        if rest:
            kept = {p[0] for p in rest}
            for p in due:
                if p[0] not in kept:
                    self.held.removeKey((p[0],))
        elif due:
            self.held.clear()
        if rest or known:
            self._leave(released, number, rest, known, None, now + 1)
        else:
            self.seen.clear()

    def _slot(self) -> tuple | None:
        seen = self.seen.get()
        return None if seen is None else pickle.loads(bytes(seen[0]))

    def _hold(self, pieces: list[tuple], number: int, columns: dict[str, np.ndarray], bucket: np.ndarray) -> None:
        self.held.updateValue((number,), (pickle.dumps((columns, bucket), protocol=5),))
        pieces.append((number, int(bucket[0]), int(bucket[-1])))

    def _piece(self, number: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return pickle.loads(bytes(self.held.getValue((number,))[0]))

    def _released(self, due: list[tuple], last: int, rest: list[tuple]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """The rows up to the bucket ``last`` in whole buckets, some ``PACK`` at a time; later rows go back into ``rest``."""
        due = sorted(due, key=lambda p: p[1])
        parts: list[tuple] = []
        for k, (number, _, end) in enumerate(due):
            columns, bucket = self._piece(number)
            if end > last:
                cut = int(np.searchsorted(bucket, last, side="right"))
                self._hold(rest, number, {c: v[cut:] for c, v in columns.items()}, bucket[cut:])
                columns, bucket = {c: v[:cut] for c, v in columns.items()}, bucket[:cut]
            parts.append((columns, bucket))
            following = due[k + 1][1] if k + 1 < len(due) else last + 1
            if following <= last and sum(len(b) for _, b in parts) < PACK:
                continue
            # What begins before the next piece is whole; the pieces are sorted, so a part is cut at one place.
            cuts = [int(np.searchsorted(b, following)) for _, b in parts]
            ready = [({c: v[:n] for c, v in cs.items()}, b[:n]) for (cs, b), n in zip(parts, cuts) if n]
            parts = [({c: v[n:] for c, v in cs.items()}, b[n:]) for (cs, b), n in zip(parts, cuts) if n < len(b)]
            if ready:
                yield {c: np.concatenate([cs[c] for cs, _ in ready]) for c in ready[0][0]}, np.concatenate([b for _, b in ready])

    def _sorted(self, columns: dict[str, np.ndarray], bucket: np.ndarray) -> np.ndarray:
        """By key, bucket and order. Keys need only stand together."""
        by = [*[_numbers(columns[k]) for k in self.keys], bucket, *[_numbers(columns[c]) for c in self.order]]
        return np.lexsort(by[::-1])

    def _runs(self, columns: dict[str, np.ndarray], bucket: np.ndarray) -> list[tuple]:
        heads = [columns[k] for k in self.keys]
        change = np.zeros(len(bucket) - 1, dtype=bool)
        for v in [*heads, bucket] if self.apart else heads:
            change |= v[1:] != v[:-1]
        ends = [*(np.flatnonzero(change) + 1).tolist(), len(bucket)]
        return [(_key(heads, begin), begin, end) for begin, end in zip([0, *ends[:-1]], ends)]

    def _waiting(self, rest: list[tuple]) -> dict:
        """The keys of the rows that wait, each with its first bucket."""
        first: dict = {}
        for number, _, _ in rest:
            columns, bucket = self._piece(number)
            order = self._sorted(columns, bucket)
            columns, bucket = {k: columns[k][order] for k in self.keys}, bucket[order]
            for k, begin, _ in self._runs(columns, bucket):
                first[k] = min(first.get(k, int(bucket[begin])), int(bucket[begin]))
        return first

    def _leave(self, released: int, number: int, pieces: list[tuple], known: dict, timer: int | None, soonest: int = -1 << 62) -> None:
        due = max(min([*[(p[1] + 1) * self.bucket_ms for p in pieces], *map(self.wakes, known.values())]), soonest)
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.seen.update((pickle.dumps((released, number, pieces, known, timer), protocol=5),))

    def wakes(self, entry: tuple[int, bool]) -> int:
        """When a known key has something to do, if nothing else comes."""
        return entry[0] + self.keep_ms

    def is_silent(self, entry: tuple[int, bool], now_ms: int) -> bool:
        """Whether a key says something at ``now_ms``, unless a row that waits begins in time."""
        return False

    def silent(self, known: dict, keys: list[tuple]) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def _numbers(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values, sort=True)[0] if values.dtype == object else values


def _key(heads: list[np.ndarray], at: int) -> tuple:
    return tuple(v[at].item() if isinstance(v[at], np.generic) else v[at] for v in heads)


class FoldProcessor(Released):
    """Runs a fold per key. ``state_schema`` names the fields its ``snapshot`` keeps. With ``closes`` a bucket is a closed unit."""

    def __init__(self, folder: Callable[[], Fold], keys: StructType, order: list[str], columns: list[str], state_schema: str,
                 bucket_ms: int, closes: bool):
        super().__init__(keys, order, bucket_ms)
        self.folder, self.key_schema, self.columns, self.state_schema, self.apart = folder, keys, columns, state_schema, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("kept", self.key_schema, self.state_schema)
        self.folds: dict[tuple, Fold] = {}      # of the slot at hand
        self.stored: set[tuple] = set()         # those that the state has

    def ordered(self, known, rows, runs):
        lines = list(pd.DataFrame(rows).itertuples(index=False))
        out: list[tuple] = []
        for key, begin, end in runs:
            fold = self.folds.get(key)
            if fold is None:
                fold = self.folds[key] = self.folder()
                if key in known:
                    fold.restore(self.kept.getValue(key))
                    self.stored.add(key)
            for line in lines[begin:end]:
                out.extend(fold.push(line))
            if self.apart:
                out.extend(fold.finish())
            last = int(rows["at_ms"][begin:end].max())
            known[key] = (max(known[key][0], last) if key in known else last, False)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def leave(self, known, ended):
        gone = set(ended)
        if len(gone) == len(known):
            self.kept.clear()
        else:
            for key in ended:
                if key in self.stored or key not in self.folds:
                    self.kept.removeKey(key)
        for key, fold in self.folds.items():
            if key not in gone:
                self.kept.updateValue(key, fold.snapshot())
        self.folds, self.stored = {}, set()


def _clocked(df: DataFrame, at: str, late: str) -> tuple[DataFrame, tuple]:
    """The rows with ``at_ms`` under a watermark on ``at``, joined by a stream of marks that tell the end of the input."""
    marks = scratch_dir(df.sparkSession, "marks")
    shape = StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])
    df.sparkSession.createDataFrame([], shape).write.parquet(marks)
    both = df.unionByName(df.sparkSession.readStream.schema(shape).parquet(marks))
    timed = both.withWatermark(at, late).withColumn("at_ms", F.unix_millis(at)).drop(at)
    return timed, (marks, shape, at)


def _slotted(timed: DataFrame, keys: list[str]) -> GroupedData:
    """Rows of a null key have a slot of their own, not a null one: Arrow hands integers beside nulls over as floats."""
    present = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return timed.withColumn(SLOT, F.when(present, F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")).otherwise(-1)).groupBy(SLOT)


def run_fold(df: DataFrame, keys: list[str], order: list[str], folder: Callable[[], Fold], state_schema: str, schema: str,
             at: str, late: str, bucket_ms: int = BUCKET_MS, closes: bool = False) -> DataFrame:
    """``at``: the rows' event time; ``late``: how far rows may come out of order. With ``closes`` a bucket is a closed unit: the
    fold's ``finish`` runs at its end."""
    use_rocksdb(df)
    columns = [f.split()[0] for f in schema.split(",")]
    timed, end = _clocked(df, at, late)
    key_types = StructType([df.schema[k] for k in keys])
    out = _slotted(timed, keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(folder, key_types, order, columns, state_schema, bucket_ms, closes), outputStructType=schema,
        outputMode="append", timeMode="EventTime")
    _MARKS[out] = end
    return out


def can_end(stream: DataFrame) -> bool:
    return stream in _MARKS


def end_of_input(stream: DataFrame) -> None:
    """Land a mark after all rows of a stream: its watermark passes them, and all state ends."""
    marks, shape, at = _MARKS[stream]
    end = F.lit(END).cast("timestamp")
    one = stream.sparkSession.range(1).select(*[(end if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    one.write.mode("append").parquet(marks)


class SilenceWatch(Released):
    """Alerts when a key has been silent longer than the gap: between two released rows, or by an event-time timer."""

    def __init__(self, key: StructField, gap_ms: int):
        super().__init__(StructType([key]), ["at_ms"], max(1, min(BUCKET_MS, gap_ms)), max(KEEP_MS, 2 * gap_ms))
        self.key, self.gap_ms = key.name, gap_ms

    def _alerts(self, keys, since_ms) -> pd.DataFrame:
        return pd.DataFrame({self.key: keys, "silent_since_ms": np.asarray(since_ms, dtype="int64")})

    def ordered(self, known, rows, runs):
        keys, since = [], []
        for key, begin, end in runs:
            times = np.unique(rows["at_ms"][begin:end].astype("int64"))
            last, told = known.get(key, (int(times[0]), False))
            before = np.append(last, times[:-1])
            silent = times - before > self.gap_ms
            silent[0] &= not told
            keys += [key[0]] * int(silent.sum())
            since += before[silent].tolist()
            known[key] = (int(times[-1]), False)
        if keys:
            yield self._alerts(keys, since)

    def is_silent(self, entry, now_ms):
        """The end of the input is no silence: what is held then is released, and no more."""
        last, told = entry
        return not told and last + self.gap_ms <= now_ms < ENDED_MS

    def silent(self, known, keys):
        if keys:
            yield self._alerts([k[0] for k in keys], [known[k][0] for k in keys])
        for k in keys:
            known[k] = (known[k][0], True)

    def wakes(self, entry):
        last, told = entry
        return last + (self.keep_ms if told else self.gap_ms)


def silence_alerts(arrivals: DataFrame, key: str, gap_s: float, key_type: str = "bigint", late: str | None = None) -> DataFrame:
    """``arrivals`` has ``key``, a watermarked ``ts`` and ``at_ms``, or ``key`` and ``ts`` only and comes with ``late``. Rows may come out
    of order within the watermark's delay; a silence is told once the watermark has passed it, and a key that stays silent is
    forgotten. With ``late`` the end of the input can be told: silences between the last rows are then known too."""
    use_rocksdb(arrivals)
    timed, end = (arrivals, None) if late is None else _clocked(arrivals, "ts", late)
    out = _slotted(timed, [key]).transformWithStateInPandas(
        statefulProcessor=SilenceWatch(arrivals.schema[key], int(gap_s * 1000)), outputStructType=f"{key} {key_type}, silent_since_ms bigint",
        outputMode="append", timeMode="EventTime")
    if end is not None:
        _MARKS[out] = end
    return out
