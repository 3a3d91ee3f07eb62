"""Cases in which a whole plan would name the wrong person, lose rows or depend on how data arrives."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from talkweave.operators import echo, evaluation as ev, monitors as mo
from talkweave.plans import chunked, oneshot
from talkweave.session import scratch_dir
from talkweave.streaming import streams as st

SEGMENTS = "meeting_id bigint, chunk_index int, source string, seg_ord int, start_s double, end_s double, text string, confidence double"


def plan_inputs(spark, segments, turns):
    return (spark.createDataFrame(segments, SEGMENTS),
            spark.createDataFrame([], "meeting_id bigint, chunk_index int, source string, seg_ord int, word_ord int, w_start double, w_end double, word string"),
            spark.createDataFrame(turns, "meeting_id bigint, chunk_index int, source string, turn_ord int, t_start double, t_end double, speaker string, quality_score double"),
            spark.createDataFrame([], "meeting_id bigint, chunk_index int, source string, r_start double, r_end double, probability double"))


def test_a_chunk_without_microphone_keeps_its_own_voices(spark):
    """Chunk 1 has lost its microphone and brings a new remote voice: it must not become the remote voice of chunk 0."""
    segments = [(1, 0, "remote", 0, 0.0, 5.0, "good morning", 0.9), (1, 0, "local", 1, 6.0, 9.0, "hello there", 0.9), (1, 1, "remote", 2, 0.0, 5.0, "someone new speaks", 0.9)]
    turns = [(1, c, s, k, a, b, "S0", 0.9) for k, (_, c, s, _, a, b, _, _) in enumerate(segments)]
    voices = spark.createDataFrame([(1, 0, "remote", "Speaker 1", [1.0, 0.0, 0.0]), (1, 0, "local", "Speaker 1", [0.0, 1.0, 0.0]), (1, 1, "remote", "Speaker 1", [0.0, 0.0, 1.0])],
                                   "meeting_id bigint, chunk_index int, source string, speaker string, embedding array<double>")
    chunks = spark.createDataFrame([(1, 0, True), (1, 1, False)], "meeting_id bigint, chunk_index int, is_dual_stream boolean")
    rows = chunked.processed_chunks(*plan_inputs(spark, segments, turns), voices, chunks)
    assert {(r.chunk_index, r.source, r.speaker) for r in rows.collect()} == {(0, "remote", "Remote Speaker 1"), (0, "local", "Local Speaker 1"), (1, "remote", "Speaker 1")}
    begun = F.lit("2024-01-01").cast("timestamp")
    done = chunked.finalize(rows, voices, chunks, begun, begun)
    assert {(r.chunk_index, r.source): r.speaker for r in done.collect()} == {
        (0, "remote"): "Remote Speaker 1", (0, "local"): "Local Speaker 1", (1, "remote"): "Remote Speaker 2"}


def test_unknown_is_resolved_over_the_whole_recording(spark):
    """Two remote voices in two chunks, one each: an Unknown row stays Unknown. The one local voice resolves its own."""
    labeled = spark.createDataFrame([
        (1, 0, "remote", 0, 0.0, 2.0, "Speaker 1", "a b c"), (1, 0, "remote", 1, 3.0, 4.0, "Unknown", "d e f"), (1, 1, "remote", 2, 0.0, 2.0, "Speaker 1", "g h i"),
        (1, 0, "local", 3, 5.0, 6.0, "Speaker 1", "j k l"), (1, 1, "local", 4, 5.0, 6.0, "Unknown", "m n o")],
        "meeting_id bigint, chunk_index int, source string, seg_ord int, start_s double, end_s double, speaker string, text string")
    voices = spark.createDataFrame([(1, 0, "remote", "Speaker 1", [1.0, 0.0, 0.0]), (1, 1, "remote", "Speaker 1", [0.0, 1.0, 0.0]), (1, 0, "local", "Speaker 1", [0.0, 0.0, 1.0])],
                                   "meeting_id bigint, chunk_index int, source string, speaker string, embedding array<double>")
    offsets = spark.createDataFrame([(1, 0, 0.0), (1, 1, 40.0)], "meeting_id bigint, chunk_index int, offset_s double")
    got = {r.seg_ord: r.speaker for r in oneshot.transcript(labeled, voices, offsets, ["seg_ord"]).collect()}
    assert got == {0: "Remote Speaker 1", 1: "Remote Unknown", 2: "Remote Speaker 2", 3: "Local Speaker 1", 4: "Local Speaker 1"}


def test_equal_similarity_goes_to_the_smaller_label(spark):
    rows = [(1, s, n, [1.0, 1.0]) for s, n in (("local", "L"), ("remote", "Beta 2"), ("remote", "Alfa 9"), ("remote", "Alfa 10"))]
    voices = spark.createDataFrame(rows, "meeting_id bigint, source string, speaker string, embedding array<double>")
    assert [r.remote for r in echo.best_remote(voices, ["meeting_id"]).collect()] == ["Alfa 9"]


def test_failures_of_one_moment_have_an_order(spark):
    rows = spark.createDataFrame([(1, 100, k) for k in (3, 1, 2)] + [(1, 200, 0)], "session_id int, failed_at_s bigint, nth int")
    got = mo.retry_streaks(rows, ties=("nth",)).orderBy("failed_at_s", "nth").collect()
    assert [(r.nth, r.retry_count) for r in got] == [(1, 1), (2, 2), (3, 3), (0, 4)]


def test_chunks_rotate_from_the_recordings_own_start(spark):
    path = scratch_dir(spark, "rotation")
    spark.sql("SELECT 1L AS session_id, timestamp(x) AS ts, timestamp('2024-01-01 10:10:00') AS begun FROM VALUES "
              "('2024-01-01 10:15:00'), ('2024-01-01 10:35:00'), ('2024-01-01 10:50:00') v(x)").write.parquet(path)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = st.collect_latest(st.chunk_counts(events, F.col("begun")), ["session_id", "chunk_index"], "rotated").collect()
    assert {(r.chunk_index, r.events) for r in got} == {(0, 2), (1, 1)}


def test_a_chunk_may_land_in_parts(spark):
    path = scratch_dir(spark, "parts")
    for k, part in enumerate(([(1, 0, "remote", 0, 0.0, 1.0, "old", 0.5)], [(1, 0, "remote", 1, 1.0, 2.0, "second", 0.5)], [(1, 0, "remote", 0, 0.0, 1.0, "new", 0.5)])):
        spark.createDataFrame(part, SEGMENTS).coalesce(1).write.mode("append").parquet(path)
        import time
        time.sleep(1.1 if k < 2 else 0)         # files land in this order
    landed = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = st.process_landing(landed, lambda rows: rows, "parts").collect()
    assert {(r.seg_ord, r.text) for r in got} == {(0, "new"), (1, "second")}


def test_banded_distance_equals_the_full_table():
    r = np.random.default_rng(3)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = [([], []), (["a"], []), ([], ["b"]), (list("kitten"), list("sitting"))]
    for _ in range(150):
        a = [str(x) for x in r.integers(0, int(r.integers(2, 60)), int(r.integers(0, 60)))]
        b = [w for w in a if r.random() > 0.2] + [str(x) for x in r.integers(0, 9, int(r.integers(0, 30)))] if r.random() < 0.7 else [str(x) for x in r.integers(0, 9, int(r.integers(0, 60)))]
        pairs.append((a, b))
    got = ev._distances(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs])).tolist()
    assert got == [full(a, b) for a, b in pairs]
    long = [str(k) for k in range(20000)]
    assert ev._distances(pd.Series([long]), pd.Series([long[:100] + ["x"] + long[101:15000] + long[15002:]])).tolist() == [3]
