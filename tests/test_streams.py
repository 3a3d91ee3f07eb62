"""Streams whose files arrive in any order, one a batch, against their batch twins."""

import glob
import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from talkweave.operators import monitors as mo, reconcile as rc
from talkweave.session import scratch_dir, scratch_root
from talkweave.streaming import streams as st


@pytest.fixture
def shuffled(spark):
    """shuffled(rows, files): the rows dealt at random over files that arrive one a batch."""
    def make(df, files=4):
        rows, path = df.collect(), scratch_dir(spark, "shuffled")
        random.Random(len(rows)).shuffle(rows)
        for k in range(files):
            spark.createDataFrame(rows[k::files], df.schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)         # files are taken in the order of their time
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return make


def same(rows, stream, batch, *columns):
    got = rows(st.collect_appended(stream, "shuffled-out"), *columns)
    assert got == rows(batch, *columns) and got


def test_retry_streaks(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 3, 40 * k * (1 + k % 3)) for k in range(120)], "session_id int, failed_at_s bigint")
    same(rows, st.retry_streaks(shuffled(df), late="30 days"), mo.retry_streaks(df), "session_id", "failed_at_s", "retry_count", "give_up")


def test_rate_drift(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 4, k, k * 150_000_000, 48000.0, 3600 if k % 4 == 2 and k > 300 else 28800) for k in range(800)],
                               "track_id int, cb_ord bigint, host_nanos bigint, declared_rate double, frames int")
    same(rows, st.rate_drift(shuffled(df), ["track_id"], late="1 day"), mo.rate_drift(df, ["track_id"]), "track_id", "cb_ord", "verdict")


def test_pad_alarm(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 2, k // 300, k, 480 * (k % 300 > 90), 480 * 30, 480.0) for k in range(1200)],
                               "track_id int, chunk_index int, buffer_ord bigint, pad_frames bigint, data_frames bigint, rate double").withColumn("pad_frames", F.col("pad_frames") * 9)
    keys = ["track_id", "chunk_index"]
    same(rows, st.pad_alarm(shuffled(df), keys, late="1 day"), mo.pad_alarm(df, keys), *keys, "buffer_ord")


def test_sticky_drops(spark, rows, shuffled):
    df = spark.createDataFrame([(k // 900, k // 450, k, 24000 if k // 150 % 3 == 1 else 48000, 1) for k in range(1800)],
                               "session_id int, chunk_index int, buffer_ord bigint, sample_rate int, channels int")
    same(rows, st.sticky_drops(shuffled(df), late="1 day"), mo.sticky_drops(df, ["session_id"], ["session_id", "chunk_index"]), "session_id", "chunk_index", "buffer_ord", "sample_rate")


def test_prompts(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 5, k, 37.0 * k, k % 7 != 0) for k in range(300)], "device_id bigint, signal_ord bigint, at_s double, eligible boolean")
    same(rows, st.prompts(shuffled(df), late="1 day"), mo.prompts(df), "device_id", "signal_ord", "at_s")


def test_a_chunk_split_over_batches_is_matched_once(spark, rows, shuffled):
    rng = random.Random(8)
    voice = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    data = [(m, "remote", c, f"Speaker {k + 1}", [x + rng.gauss(0, 0.1) for x in voice[(k + c * m) % 4]]) for m in range(3) for c in range(5) for k in range(3)]
    df = spark.createDataFrame(data, "meeting_id bigint, namespace string, chunk_index int, speaker string, embedding array<double>")
    same(rows, st.reconcile(shuffled(df, 3), late="10 days"), rc.reconcile(df), "meeting_id", "namespace", "chunk_index", "speaker", "global_speaker")


def test_released_in_order_while_the_stream_runs(spark, rows):
    """Rows are released as the watermark passes, late rows are dropped, and the order inside a key is that of event time."""
    path = scratch_dir(spark, "running")
    for part in ([(1, 1000), (1, 700)], [(1, 0), (1, 500), (1, 20_000)], [(1, 10_000), (1, 600)], [(1, 650), (1, 21_000)]):
        spark.createDataFrame(part, "session_id int, failed_at_s bigint").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema("session_id int, failed_at_s bigint").option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(st.collect_appended(st.retry_streaks(stream, late="2 hours"), "running-out"), "failed_at_s", "retry_count")
    assert got == [(0, 1), (500, 2), (600, 3), (700, 4), (1000, 5), (10_000, 1), (20_000, 1), (21_000, 1)]        # 650 came too late


def test_state_does_not_follow_the_keys(spark, rows):
    """Keys share slots: timers and rows of the state are fewer than keys, and every key is still told apart."""
    path, out = scratch_dir(spark, "many"), scratch_dir(spark, "many-out")
    df = spark.range(60_000).selectExpr("cast(id % 20000 as int) as session_id", "id % 20000 * 7 + floor(id / 20000) * 5000 as failed_at_s")
    df.write.parquet(path)
    q = (st.retry_streaks(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-state").trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress) < 10_000
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 60_000
    same(rows, st.retry_streaks(spark.readStream.schema(df.schema).parquet(path)), mo.retry_streaks(df), "session_id", "failed_at_s", "retry_count")


def test_a_long_key_is_released_in_packs(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 11 // 10, k * 37) for k in range(25_000)], "session_id int, failed_at_s bigint")
    same(rows, st.retry_streaks(shuffled(df), late="30 days"), mo.retry_streaks(df), "session_id", "failed_at_s", "retry_count")


def test_rows_of_a_null_key_leave_the_others_alone(spark, rows, shuffled):
    df = spark.createDataFrame([(k % 3 if k % 4 else None, 40 * k * (1 + k % 3)) for k in range(120)], "session_id int, failed_at_s bigint")
    same(rows, st.retry_streaks(shuffled(df, 2), late="30 days"), mo.retry_streaks(df.where("session_id IS NOT NULL")), "session_id", "failed_at_s", "retry_count")


def test_a_key_is_kept_for_a_row_that_waits(spark, rows, shuffled):
    """Days lie between the chunks of a meeting, and the last one is still held when the first are long released."""
    data = [(m, "remote", c, f"Speaker {k}", [float(k == 1), float(k == 2), 0.1 * m]) for m in range(3) for c in (0, 1, 500) for k in (1, 2)][::-1]
    df = spark.createDataFrame(data[:-1], "meeting_id bigint, namespace string, chunk_index int, speaker string, embedding array<double>")
    same(rows, st.reconcile(shuffled(df, 1)), rc.reconcile(df), "meeting_id", "namespace", "chunk_index", "speaker", "global_speaker")


def most_timers(spark, df, stream):
    """The most timers that a batch left behind."""
    path, out = scratch_dir(spark, "timed"), scratch_dir(spark, "timed-out")
    df.write.parquet(path)
    q = (stream(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return max(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress)


def test_timers_do_not_follow_the_chunks_of_a_track(spark):
    df = spark.range(20_000).selectExpr("cast(id % 3 as int) as track_id", "cast(floor(id / 3) as int) as chunk_index", "id as buffer_ord",
                                        "1L as pad_frames", "1L as data_frames", "480D as rate")
    assert 0 < most_timers(spark, df, lambda s: st.pad_alarm(s, ["track_id", "chunk_index"])) < 10_000


def test_timers_do_not_follow_the_tracks(spark):
    df = spark.range(20_000).selectExpr("cast(id as int) as track_id", "id as cb_ord", "id * 10000000 as host_nanos", "48000D as declared_rate", "7200 as frames")
    assert 0 < most_timers(spark, df, lambda s: st.rate_drift(s, ["track_id"])) < 10_000


@pytest.fixture
def finished(spark):
    """finished(purpose): the checkpoint of a stream that ran to the end of its input, its rows all in one file."""
    def run(purpose):
        path = scratch_dir(spark, "whole")
        df = spark.createDataFrame([(k % 3, 40 * k * (1 + k % 3)) for k in range(120)], "session_id int, failed_at_s bigint").coalesce(1)
        df.write.parquet(path)
        purpose = f"{purpose}-{uuid.uuid4().hex}"
        got = st.collect_appended(st.retry_streaks(spark.readStream.schema(df.schema).parquet(path)), purpose)
        assert got.count() == 120
        [state] = glob.glob(os.path.join(scratch_root(spark), f"{purpose}-*-state"))
        return state
    return run


def test_the_end_of_the_input_takes_three_batches(spark, finished):
    """The rows, the mark, and the one after the mark; nothing is left over for the session's other streams."""
    before = spark.conf.get(st.ROWLESS)
    assert len(glob.glob(finished("batches") + "/commits/[0-9]*")) == 3
    assert spark.conf.get(st.ROWLESS) == before
