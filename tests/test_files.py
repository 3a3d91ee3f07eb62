"""Sources, sinks, recovery and documents."""

import json
import os
import struct

from pyspark.sql import functions as F

from talkweave.operators import documents as dc, evaluation as ev, recovery as rv
from talkweave.session import scratch_dir
from talkweave.sources import capture, documents as docs, reference as rf, sessions as ss


def folder(spark, name, files):
    path = scratch_dir(spark, name)
    os.makedirs(path)
    for f, body in files.items():
        with open(os.path.join(path, f), "wb") as out:
            out.write(body if isinstance(body, bytes) else body.encode())
    return path


def wav(payload, declared=None, rate=16000):
    n = payload if declared is None else declared
    return b"RIFF" + struct.pack("<I", n + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", n) + b"\0" * payload


def test_audio_inventory_and_audit(spark):
    path = folder(spark, "audio", {"x-0.wav": wav(32000), "x-1.wav": wav(64000, declared=0), "x-1_mic.wav": wav(0), "bad-0.wav": b"short", "note.txt": "n"})
    inv = capture.audio_files(spark, path)
    assert sorted(r.file_name for r in inv.collect()) == ["bad-0.wav", "x-0.wav", "x-1.wav", "x-1_mic.wav"]
    got = {os.path.basename(r.path): (r.is_wav, r.needs_repair, r.duration_s) for r in capture.audited_audio(spark, path).collect()}
    assert got == {"x-0.wav": (True, False, 1.0), "x-1.wav": (True, True, 2.0), "x-1_mic.wav": (True, False, None), "bad-0.wav": (False, False, None)}
    assert sorted((r.idx, r.is_dual_stream) for r in rv.paired(inv).where("session_id = 'x'").collect()) == [(0, False), (1, True)]


def test_sessions_old_and_broken(spark):
    chunk = {"index": 0, "startTime": "2024-01-01T00:00:00Z", "audioPath": "a.m4a", "segments": [{"start": 0, "end": 1.5, "text": "hi", "speaker": "Local Speaker 1", "source": "local"}],
             "speakerDatabase": {"Speaker 1": [1, 0]}}
    doc = {"sessionId": "s", "meetingStart": "2024-01-01T00:00:00Z", "engine": "e", "chunkDurationMinutes": 30, "chunks": [chunk, {**chunk, "index": 1, "is_dual_stream": False, "echo_segments_removed": 3}]}
    path = folder(spark, "sessions", {"a.json": json.dumps(doc, indent=1), "b.json": "{ not json"})
    chunks, bad = ss.read_sessions(spark, path)
    got = [(r.chunk_index, r.is_dual_stream, r.echo_segments_removed, dict(r.local_speaker_database)) for r in chunks.orderBy("chunk_index").collect()]
    assert got == [(0, True, 0, {}), (1, False, 3, {})]
    assert [os.path.basename(r.file) for r in bad.collect()] == ["b.json"]
    assert ss.chunk_segments(chunks).count() == 2
    assert [(r.source, r.speaker) for r in ss.chunk_voices(chunks).collect()] == [("remote", "Speaker 1")] * 2


def test_documents_round_trip(spark):
    rows = [(1, i, i + 1, float(i), i + 0.5, "Speaker 1", f"t{i}", "local" if i % 2 else "", 0.5 if i else None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "meeting_id bigint, seg_ord int, place bigint, start double, end double, speaker string, text string, source string, confidence double, language string")
    meta = spark.range(1, 2).select(F.col("id").alias("meeting_id"), F.struct(F.lit("srt").alias("output_format")).alias("metadata"))
    path = scratch_dir(spark, "docs")
    docs.write_lines(dc.document_lines(df, meta), path)
    body = "".join(open(os.path.join(d, f)).read() for d, _, fs in sorted(os.walk(path)) for f in sorted(fs) if f.startswith("part-"))
    whole = json.loads(body)
    assert whole["metadata"] == {"output_format": "srt"} and len(whole["segments"]) == 5
    assert whole["segments"][0] == {"start": 0.0, "end": 0.5, "speaker": "Speaker 1", "text": "t0"}
    assert docs.filled(docs.read_document_rows(spark, path), ["meeting_id"]).where("source = ''").count() == 3
    single = folder(spark, "document", {"a.json": body})
    back = docs.read_documents(spark, single)
    assert docs.sample_rows(back, ["file"]).where("source = 'remote'").count() == 3
    assert docs.summary_rows(back, ["file"]).where("source = ''").count() == 3


def test_a_long_meeting_is_one_document(spark):
    df = spark.range(12000).select(F.lit(1).cast("bigint").alias("meeting_id"), (F.col("id") + 1).alias("place"), F.col("id").cast("double").alias("start"),
                                   (F.col("id") + 1).cast("double").alias("end"), F.lit("S").alias("speaker"), F.lit("t").alias("text"), F.lit("").alias("source"),
                                   F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("language"))
    meta = spark.range(1, 2).select(F.col("id").alias("meeting_id"), F.struct(F.lit("srt").alias("output_format")).alias("metadata"))
    path = scratch_dir(spark, "docs")
    docs.write_lines(dc.document_lines(df, meta), path)
    body = "".join(open(os.path.join(d, f)).read() for d, _, fs in sorted(os.walk(path)) for f in sorted(fs) if f.startswith("part-"))
    assert [s["start"] for s in json.loads(body)["segments"]] == [float(k) for k in range(12000)]
    assert docs.read_document_rows(spark, path).where("metadata.output_format = 'srt'").count() == 12000
    heads = spark.range(1, 2).select(F.col("id").alias("meeting_id"), dc.message_head(F.lit("m"), F.lit("2024-01-01"), F.lit(7260.0), F.lit("S, T")).alias("head"))
    lines = [r.value for r in dc.prompt_lines(df, heads, F.lit(False)).orderBy("place").collect()]
    assert lines[:6] == ["Meeting: m", "Date: 2024-01-01", "Duration: 2h 1m", "Participants: S, T", "", "--- TRANSCRIPT ---"]
    assert len(lines) == 12006 and lines[6] == "[00:00:00] S: t" and lines[-1].endswith("S: t")


def test_a_meeting_without_rows_has_a_document(spark):
    shape = "meeting_id bigint, place bigint, start double, end double, speaker string, text string, source string, confidence double, language string"
    df = spark.createDataFrame([(1, 1, 0.0, 1.0, "S", "t", "", None, None), (3, 1, 0.0, 1.0, "S", "t", "", None, None)], shape)
    meta = spark.range(1, 3).select(F.col("id").alias("meeting_id"), F.struct(F.lit("srt").alias("output_format")).alias("metadata"))
    body: dict[int, str] = {}
    for r in dc.document_lines(df, meta).orderBy("meeting_id", "place").collect():
        body[r.meeting_id] = body.get(r.meeting_id, "") + r.value
    found = {k: json.loads(v) for k, v in body.items()}
    assert found[2] == {"metadata": {"output_format": "srt"}, "segments": []}
    assert found[3]["metadata"] == {} and len(found[1]["segments"]) == len(found[3]["segments"]) == 1


def test_exports(spark):
    rows = [(1, i, i + 1, float(i), i + 0.5, "Speaker 1", f"t{i}", "local" if i % 2 else "", 0.5 if i else None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "meeting_id bigint, seg_ord int, place bigint, start double, end double, speaker string, text string, source string, confidence double, language string")
    out = scratch_dir(spark, "srt")
    docs.write_lines(dc.cue_lines(df), out)
    text = "".join(open(os.path.join(d, f)).read() for d, _, fs in sorted(os.walk(out)) for f in sorted(fs) if f.startswith("part-"))
    assert text.startswith("1\n00:00:00,000 --> 00:00:00,500\nSpeaker 1: t0\n\n2\n00:00:01,000")


def test_locating_samples(spark):
    chunks = spark.createDataFrame([(1, 0, 1800.0), (1, 1, 1281.0), (2, 0, 100.0), (2, 1, None), (2, 2, 100.0)], "meeting_id bigint, chunk_index int, duration_s double")
    placed = rv.start_offsets(chunks, ["meeting_id"], "chunk_index", "duration_s")
    asked = [(1, 0, 100.0, 150.0), (1, 1, 1900.0, 1950.0), (1, 2, 1800.0, 1810.0), (1, 3, 1790.0, 1900.0), (1, 4, -1.0, 5.0), (1, 5, 5.0, 5.0), (1, 6, 4000.0, 4001.0), (2, 7, 10.0, 12.0), (2, 8, 150.0, 160.0)]
    s = spark.createDataFrame(asked, "meeting_id bigint, i int, start_s double, end_s double")
    got = {r.i: (r.chunk_index, r.local_start, r.local_end) for r in rv.located(s, placed, ["i"]).collect()}
    assert got == {0: (0, 100.0, 115.0), 1: (1, 100.0, 115.0), 2: (1, 0.0, 10.0), 3: (0, 1790.0, 1800.0), 7: (0, 10.0, 12.0)}


def test_orphans_indices_and_quota(spark):
    stamp = "2024-01-01 00:00:00"
    files = spark.createDataFrame([("s-0.wav", 10), ("s-2.wav", 10), ("s-2_mic.wav", 10), ("s-5.wav", 10), ("other.wav", 10)], "file_name string, length bigint").withColumn("modified", F.lit(stamp).cast("timestamp"))
    inv = rv.chunk_inventory(files).where("has_system")
    done = spark.createDataFrame([("s", 0)], "session_id string, idx int")
    assert sorted(r.idx for r in rv.orphans(inv, done).collect()) == [2, 5]
    assert sorted(r.missing for r in rv.index_gaps(inv, ["session_id"]).collect()) == [1, 3, 4]
    far = spark.createDataFrame([("s", 0), ("s", 3), ("s", 2_000_000_000)], "session_id string, idx int")
    assert sorted((r.first_missing, r.last_missing) for r in rv.gap_ranges(far, ["session_id"]).collect()) == [(1, 2), (4, 1_999_999_999)]
    near = spark.createDataFrame([("s", 0), ("s", 8)], far.schema)
    assert sorted(r.missing for r in rv.index_gaps(near, ["session_id"], step=3).collect()) == [1, 2, 3, 4, 5, 6, 7]
    sessions = spark.createDataFrame([("s", 9), ("empty", 0)], "session_id string, sentinel_index int")
    got = {r.session_id: (r.next_free, r.safe_restart) for r in rv.next_free_index(sessions, done, inv).collect()}
    assert got == {"s": (6, 10), "empty": (0, 1)}
    bases = spark.createDataFrame([("s", True), ("none", True), ("old", False)], "session_id string, zero_indexed boolean")
    assert sorted(r.system_file for r in rv.discovered(files, bases).collect()) == ["none-0.wav", "old.wav", "s-0.wav", "s-2.wav", "s-5.wav"]
    f = spark.createDataFrame([("d", i, 100, i == 1) for i in range(5)], "d string, n int, length bigint, protected boolean").withColumn("modified", F.timestamp_seconds(F.col("n") * 10))
    assert sorted(r.n for r in rv.evictions(f, ["d"], F.lit(250), ["modified", "n"]).collect()) == [0, 2, 3]
    assert rv.evictions(f, ["d"], F.lit(500), ["modified", "n"]).count() == 0


def test_samples_fall_back_to_crosstalk(spark):
    rows = [(1, 0, "A", 0.0, 5.0), (1, 1, "B", 4.8, 9.0), (1, 2, "B", 20.0, 30.0), (1, 3, "A", 25.0, 60.0), (1, 4, "C", 26.0, 27.0), (1, 5, "A", 3.0, 4.9)]
    flagged = dc.clean_flags(spark.createDataFrame(rows, "meeting_id bigint, i int, speaker string, start_s double, end_s double"), ["i"])
    got = {(r.speaker, r["rank"]): r.i for r in dc.ranked_samples(flagged, ["i"], k=2).collect()}
    assert got == {("A", 1): 0, ("A", 2): 5, ("B", 1): 1, ("B", 2): 2, ("C", 1): 4}


def test_ground_truth_ratios_and_telemetry(spark):
    path = folder(spark, "truth", {"t.json": json.dumps({"note": "bare", "en": [{"file": "a.wav", "text": "x"}, {"file": "b.wav"}], "fr": [{"file": "c.wav", "text": "[y]"}]})})
    assert sorted((r.language, r.file_name) for r in rf.read_ground_truth(spark, path).collect()) == [("en", "a.wav"), ("fr", "c.wav")]
    path = folder(spark, "ratios", {"new.json": '{"m": {"ratio": 2.5, "isSeed": false}}', "old.json": '{"n": 3.25}', "bad.json": "nope"})
    assert sorted(tuple(r) for r in rf.read_ratios(spark, path).collect()) == [("m", 2.5, False), ("n", 3.25, True)]
    path = folder(spark, "telemetry", {"a.csv": "elapsed_s,kb_per_transfer,transfers_per_sec,mb_per_sec\n1,2,x,4\n2,,5,6\n"})
    got = [tuple(r) for r in rf.read_telemetry(spark, path, "iostat").orderBy("elapsed_s").collect()]
    assert got == [(1.0, 2.0, None, 4.0), (2.0, None, 5.0, 6.0)]
    path = folder(spark, "diar", {"d.json": '{"segments": [{"start": 0.5, "end": 1, "speaker": "S1"}], "speakers": {"S1": 1}}'})
    assert [(r.t_start, r.speaker) for r in rf.read_diarizer(spark, path).collect()] == [(0.5, "S1")]


def test_only_the_header_of_a_recording_is_read(spark):
    size = 5 << 30                   # sparse, and more than could be loaded
    path = folder(spark, "long", {"long one-0.wav": wav(0, declared=size // 4), "gap-1.wav": b"RIF"})
    with open(os.path.join(path, "long one-0.wav"), "r+b") as out:
        out.truncate(size)
    got = {os.path.basename(r.path): r for r in capture.audited_audio(spark, path).collect()}
    assert got["long one-0.wav"].real_bytes == size - 44 and got["long one-0.wav"].declared_bytes == size // 4
    assert got["long one-0.wav"].needs_repair and got["long one-0.wav"].duration_s == (size - 44) / 32000
    assert not got["gap-1.wav"].is_wav
    head, gone = capture._first_bytes([os.path.join(path, "long one-0.wav"), f"file:{path}/no.wav"], 44)
    assert len(head) == 44 and gone is None


SEGMENTS = "meeting_id bigint, place bigint, start double, end double, speaker string, text string, source string, confidence double, language string"


def test_packed_documents_and_damaged_lines(spark):
    df = spark.createDataFrame([(m, k, float(k), k + 0.5, "S", f"a\nb{k}", "", None, None) for m in range(1, 301) for k in range(1, 4)], SEGMENTS)
    meta = spark.range(1, 302).select(F.col("id").alias("meeting_id"), F.struct(F.lit("srt").alias("output_format")).alias("metadata"))
    path = scratch_dir(spark, "packed")
    docs.write_packed(dc.document_lines(df, meta), path)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.read_packed(spark, path)
    assert packed.where("meeting_id = 301").count() == 2        # a meeting without rows has its document
    rows, bad = docs.document_rows(packed)
    assert bad.count() == 0 and rows.count() == 900 and rows.where("metadata.output_format = 'srt' AND s.text LIKE 'a\\nb%'").count() == 900
    out = scratch_dir(spark, "out")
    docs.hand_out(packed, [7, 301], out)
    body = {d: "".join(open(os.path.join(out, d, f)).read() for f in sorted(os.listdir(os.path.join(out, d))) if f.startswith("part-")) for d in os.listdir(out) if "=" in d}
    assert [s["text"] for s in json.loads(body["meeting_id=7"])["segments"]] == ["a\nb1", "a\nb2", "a\nb3"]
    assert json.loads(body["meeting_id=301"]) == {"metadata": {"output_format": "srt"}, "segments": []}
    cut = F.when((F.col("meeting_id") == 1) & (F.col("place") == 0), '{"metadata":{"output').when((F.col("meeting_id") == 2) & (F.col("place") == 2), ',{"start":').otherwise(F.col("value"))
    rows, bad = docs.document_rows(packed.withColumn("value", cut))
    assert sorted((r.meeting_id, r.place) for r in bad.collect()) == [(1, 0), (2, 2)]
    assert rows.where("meeting_id = 1 AND metadata IS NULL").count() == 3 and rows.where("meeting_id = 2").count() == 2
    lines = docs.text_of(spark.createDataFrame([(1, 0, "x\n\ny")], "meeting_id bigint, place bigint, value string"))
    assert [r.value for r in lines.collect()] == ["x", "", "y"]


def test_document_metadata(spark):
    shape = ("meeting_id bigint, audio_paths array<string>, output_format string, language string, num_speakers int, diarization boolean, dual_stream boolean, "
             "software_version string, recorded_at timestamp, echo_segments_removed int, provenance struct<engine:string,retries:bigint,mic_device:string>")
    known = spark.createDataFrame([(1, ["/r/a-0.wav", "b.wav"], "json", "en", 3, True, False, "v2", None, 4, ("tap", 2, None)),
                                   (2, [], "txt", "fr", None, False, True, "v2", None, 0, None)], shape)
    known = known.withColumn("recorded_at", F.when(F.col("meeting_id") == 1, F.lit("2024-05-01 10:00:00").cast("timestamp")))
    got = {r.meeting_id: json.loads(r.m) for r in dc.document_metadata(known).select("meeting_id", F.to_json("metadata").alias("m")).collect()}
    sealed = {"summary_generated": False, "transcript_transmitted": False}
    assert got[1] == {"audio_files": ["a-0.wav", "b.wav"], "audio_paths": ["/r/a-0.wav", "b.wav"], "output_format": "json", "language": "en", "num_speakers": 3, "diarization": True,
                      "dual_stream": False, "software_version": "v2", "recorded_at": "2024-05-01T10:00:00Z", "echo_segments_removed": 4,
                      "capture_provenance": {"engine": "tap", "retries": 2}, "disclosure": sealed}
    assert got[2] == {"audio_files": [], "audio_paths": [], "output_format": "txt", "language": "fr", "num_speakers": "auto", "diarization": False, "dual_stream": True,
                      "software_version": "v2", "disclosure": sealed}


def test_matrix_report(spark):
    runs = [("b.wav", "en", "x", 0.0625, 2.25, None), ("b.wav", "en", "y", None, 3.0, "timeout"), ("a.wav", "fr", "x", None, 1.0, None), ("c.wav", "en", "x", 0.1, 4.0, None)]
    df = spark.createDataFrame(runs, "file_name string, language string, engine string, wer double, rtf double, error string")
    got = [r.value for r in ev.matrix_report(df, ["x", "y"], "today").orderBy("section", "name").collect()]
    assert got == ["# ASR Engine Benchmark Matrix", "", "Date: today", "", "| File | Lang | x WER | x RTF | y WER | y RTF |", "|------|------|---:|---:|---:|---:|",
                   "| a.wav | fr | - | 1.0x | - | - |", "| b.wav | en | 6.2% | 2.2x | ERR | - |", "| c.wav | en | 10.0% | 4.0x | - | - |",
                   "", "## Average by Language", "", "| Language | x WER | y WER |", "|----------|---:|---:|", "| en | 8.1% | - |", "| fr | - | - |"]
