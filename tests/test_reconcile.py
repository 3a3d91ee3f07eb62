import random

import numpy as np

from talkweave.operators import merge as mg, reconcile as rc
from talkweave.session import scratch_dir
from talkweave.streaming import streams as st

VOICE = "meeting_id bigint, namespace string, chunk_index int, speaker string, embedding array<float>"


def run(spark, rows, **kw):
    out = rc.reconcile(spark.createDataFrame(rows, VOICE), **kw).collect()
    return {(r.meeting_id, r.namespace, r.chunk_index, r.speaker): r.global_speaker for r in out}


def replay(rows, threshold=0.65):
    """Chunk by chunk, straight from the rules."""
    out, number = {}, lambda s: int(s.split()[-1])
    for channel in {r[:2] for r in rows}:
        known, nxt = {}, 0
        for chunk in sorted({r[2] for r in rows if r[:2] == channel}):
            here = {r[3]: np.array(r[4], dtype=np.float32).astype(float) for r in rows if r[:3] == (*channel, chunk)}
            if not known:
                known, nxt = dict(here), max(number(s) for s in here) + 1
                names = {s: s for s in here}
            else:
                cos = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
                pairs = sorted((-cos(v, k), number(s), number(g), s, g) for s, v in here.items() for g, k in known.items())
                names = {}
                for c, _, _, s, g in pairs:
                    if -c >= threshold and s not in names and g not in names.values():
                        names[s] = g
                        known[g] = 0.9 * known[g] + 0.1 * here[s]
                for s in sorted(here, key=number):
                    if s not in names:
                        names[s] = f"Speaker {nxt}"
                        known[names[s]], nxt = here[s], nxt + 1
            out.update({(*channel, chunk, s): g for s, g in names.items()})
    return out


def voices(seed, meetings=6, chunks=12):
    rng = random.Random(seed)
    rows = []
    for m in range(meetings):
        people = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
        for side in ("local", "remote"):
            for c in range(chunks):
                who = rng.sample(range(4), rng.randrange(0, 4))
                rows += [(m, side, c, f"Speaker {i + 1}", [x + rng.gauss(0, 0.25) for x in people[p]]) for i, p in enumerate(who)]
    return rows


def test_matches_a_direct_replay(spark):
    rows = voices(1)
    assert run(spark, rows) == replay(rows)


def test_seed_is_identity_and_new_numbers_continue(spark):
    rows = [(1, "", 0, "Speaker 3", [1.0, 0.0, 0.0]), (1, "", 1, "Speaker 1", [0.0, 1.0, 0.0]), (1, "", 1, "Speaker 2", [1.0, 0.1, 0.0])]
    assert run(spark, rows) == {(1, "", 0, "Speaker 3"): "Speaker 3", (1, "", 1, "Speaker 1"): "Speaker 4", (1, "", 1, "Speaker 2"): "Speaker 3"}


def test_one_to_one_and_channels_never_mix(spark):
    rows = [(1, "a", 0, "Speaker 1", [1.0, 0.0]), (1, "a", 1, "Speaker 1", [1.0, 0.3]), (1, "a", 1, "Speaker 2", [1.0, 0.1]), (1, "b", 1, "Speaker 5", [1.0, 0.0])]
    got = run(spark, rows)
    assert got[1, "a", 1, "Speaker 2"] == "Speaker 1" and got[1, "a", 1, "Speaker 1"] == "Speaker 2" and got[1, "b", 1, "Speaker 5"] == "Speaker 5"


def test_keys_follow_the_chunk_and_values_the_channel(spark):
    v = spark.createDataFrame([(1, 0, "remote", "Speaker 1", [1.0, 0.0]), (1, 1, "remote", "Speaker 4", [1.0, 0.0]), (1, 0, "local", "Speaker 1", [1.0, 0.0]),
                               (2, 0, "remote", "Speaker 1", [1.0])], "meeting_id bigint, chunk_index int, source string, speaker string, embedding array<float>")
    c = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, False)], "meeting_id bigint, chunk_index int, is_dual_stream boolean")
    got = {(r.meeting_id, r.chunk_index, r.speaker): r["global"] for r in rc.channel_mapping(v, c).collect()}
    assert got == {(1, 0, "Remote Speaker 1"): "Remote Speaker 1", (1, 1, "Speaker 4"): "Remote Speaker 1", (1, 0, "Local Speaker 1"): "Local Speaker 1",
                   (2, 0, "Speaker 1"): "Speaker 1"}


def test_stream_over_many_batches_equals_batch(spark):
    rows = voices(2, meetings=3, chunks=6)
    path = scratch_dir(spark, "voices")
    for c in range(6):
        spark.createDataFrame([r for r in rows if r[2] == c], VOICE).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(VOICE).option("maxFilesPerTrigger", 1).parquet(path)
    got = st.collect_appended(st.reconcile(stream), "ids").collect()
    assert {(r.meeting_id, r.namespace, r.chunk_index, r.speaker): r.global_speaker for r in got} == replay(rows)


def test_merge_shifts_and_reports_misses(spark):
    seg = spark.createDataFrame([(1, 0, "remote", 0, 1.0, 2.0, "Speaker 1", "a"), (1, 1, "remote", 1, 1.0, 2.0, "Speaker 2", "b"), (1, 1, "remote", 2, 3.0, 4.0, "Remote Unknown", "c")],
                                "meeting_id bigint, chunk_index int, source string, seg_ord int, start_s double, end_s double, speaker string, text string")
    mapping = spark.createDataFrame([(1, 1, "Speaker 9", "Speaker 1")], "meeting_id bigint, chunk_index int, speaker string, global string")
    assert [tuple(r) for r in mg.unmapped_labels(seg, mapping).collect()] == [(1, 1, "Speaker 2")]
    from pyspark.sql import functions as F
    at = lambda s: F.timestamp_seconds(s)
    got = mg.in_order(mg.merge(seg, mapping, at(F.col("chunk_index") * 1800), at(F.lit(0)))).collect()
    assert [r.elapsed for r in got] == [1.0, 1801.0, 1803.0]
