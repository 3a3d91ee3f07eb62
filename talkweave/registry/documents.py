"""Documents and sinks: S1-S8, S19, P9-P12, P24, P25, A2-A4, A16, A18, A19, A23, W18."""

from pyspark.sql import functions as F

from ..functions import usage as us
from ..operators import aggregates as ag, documents as dc, merge as mg, monitors as mo
from ..session import scratch_dir, written
from ..sources import capture, documents as docs, sessions as ss
from .base import query
from .echo import _starts, tagged
from .monitors import PROVENANCE
from .scalars import CLOCK
from .tables import _d, define

define("r_rows", ("r_tagged",), """
SELECT *, chunk_index * 40 + start_s AS start, chunk_index * 40 + end_s AS "end", CASE meeting_id % 4 WHEN 0 THEN 'srt' WHEN 1 THEN 'txt' WHEN 2 THEN 'json' ELSE 'pdf' END AS output_format,
       row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_index * 40 + start_s, source, seg_ord) AS place FROM r_tagged""")


def rows(t):
    placed = mg.places(mg.shifted(tagged(t), *_starts()))
    return placed.select("meeting_id", "seg_ord", "place", F.col("elapsed").alias("start"), F.col("elapsed_end").alias("end"), "speaker", "text",
                         "source", F.col("confidence"), F.lit(None).cast("string").alias("language"))


def formats(t):
    fmt = F.element_at(F.array(*map(F.lit, ("srt", "txt", "json", "pdf"))), (F.col("meeting_id") % 4 + 1).cast("int"))
    return t.chunks.select("meeting_id").distinct().withColumn("output_format", fmt)


MS = "CAST(trunc({0} * 1000) AS BIGINT)"
SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"
START, END = SRT.format(MS.format("start")), SRT.format(MS.format('"end"'))


@query("w18_srt_numbers", "SELECT meeting_id, seg_ord, place FROM r_rows WHERE output_format = 'srt'", ("r_rows",))
def w18(t):
    return rows(t).join(formats(t).where("output_format = 'srt'"), "meeting_id").select("meeting_id", "seg_ord", "place")


@query("s5_srt_export", f"""
SELECT meeting_id, unnest([CAST(place AS VARCHAR), {START} || ' --> ' || {END}]) AS line FROM r_rows WHERE output_format = 'srt'
UNION ALL SELECT meeting_id, unnest(string_split(speaker || ': ' || text, chr(10))) FROM r_rows WHERE output_format = 'srt'
UNION ALL SELECT meeting_id, '' FROM r_rows WHERE output_format = 'srt'""", ("r_rows",))
def s5(t):
    path = scratch_dir(t.spark, "srt")
    lines = dc.export_lines(rows(t), formats(t))
    docs.write_packed(lines.where("format = 'srt'"), path)
    return docs.text_of(docs.read_packed(t.spark, path)).select("meeting_id", F.col("value").alias("line"))


@query("s6_txt_export", f"""
SELECT meeting_id, unnest(string_split('[' || {CLOCK.format('CAST(trunc(start) AS BIGINT)')} || '] ' || speaker || ': ' || text, chr(10))) AS line FROM r_rows WHERE output_format = 'txt'""", ("r_rows",))
def s6(t):
    path = scratch_dir(t.spark, "txt")
    lines = dc.export_lines(rows(t), formats(t))
    docs.write_packed(lines.where("format = 'txt'"), path)
    return docs.text_of(docs.read_packed(t.spark, path)).select("meeting_id", F.col("value").alias("line"))


@query("s7_format_dispatch", """
SELECT meeting_id, output_format AS format, count(*) AS entries FROM r_rows WHERE output_format IN ('srt', 'txt') GROUP BY ALL""", ("r_rows",))
def s7(t):
    return dc.export_lines(rows(t), formats(t)).groupBy("meeting_id", "format").agg(F.count(F.lit(1)).alias("entries"))


def meetings(t):
    """What is known about each meeting's recording, without its diagnostics."""
    m = F.col("meeting_id")
    path = F.concat(F.lit("/r/m"), m.cast("string"), F.lit("-"), F.col("chunk_index").cast("string"), F.lit(".wav"))
    paths = F.sort_array(F.collect_list(F.struct("chunk_index", path.alias("path"))))       # a handful of chunks per meeting
    about = t.chunks.groupBy("meeting_id").agg(F.transform(paths, lambda p: p["path"]).alias("audio_paths"), F.bool_or("is_dual_stream").alias("dual_stream"))
    start = F.timestamp_seconds(F.lit(1704067200) + m * 3600)
    return about.join(formats(t), "meeting_id").select(
        "*", F.lit("en").alias("language"), F.when(m % 3 == 1, F.lit(2)).alias("num_speakers"), F.lit(True).alias("diarization"), F.lit("v1").alias("software_version"),
        F.when(m % 5 != 0, start).alias("recorded_at"), F.when(m % 3 == 0, 2).otherwise(0).alias("echo_segments_removed"))


def captured(t):
    """Each session's capture, as its diagnostics tell."""
    told = ag.provenance(t.capture_events, ["session_id"])
    return told.select("session_id", F.struct(F.lit("tap").alias("engine"), *[c for c in told.columns if c != "session_id"]).alias("provenance"))


def stored_documents(t):
    path = scratch_dir(t.spark, "documents")
    meta = dc.document_metadata(meetings(t).withColumn("provenance", F.lit(None)))
    docs.write_packed(dc.document_lines(written(rows(t), "rows"), meta), path)
    return docs.document_rows(docs.read_packed(t.spark, path))[0]


@query("s4_document_sink", """
SELECT output_format, CAST(CASE WHEN meeting_id % 3 = 0 THEN 2 END AS INTEGER) AS echo_segments_removed, CAST(count(*) AS INTEGER) AS segments, round(max("end"), 6) AS last_end,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM r_rows GROUP BY meeting_id, output_format""", ("r_rows",))
def s4(t):
    d = stored_documents(t)
    return d.groupBy("meeting_id", "metadata.output_format", "metadata.echo_segments_removed").agg(
        F.count(F.lit(1)).cast("int").alias("segments"), F.round(F.max("s.end"), 6).alias("last_end"),
        F.sum(F.length("s.text")).alias("chars")).drop("meeting_id")


@query("s3_document_scan", """
SELECT speaker, source, text, round(start, 6) AS start_s FROM r_rows""", ("r_rows",))
def s3(t):
    return docs.filled(stored_documents(t), ["meeting_id"]).select("speaker", "source", "text", F.round("start", 6).alias("start_s"))


@query("p24_document_metadata", f"""
SELECT meeting_id, '{{"audio_files":["' || files || '"],"audio_paths":["' || paths || '"],"output_format":"' || output_format || '","language":"en","num_speakers":' ||
       CASE WHEN meeting_id % 3 = 1 THEN '2' ELSE '"auto"' END || ',"diarization":true,"dual_stream":' || dual || ',"software_version":"v1"' ||
       CASE WHEN meeting_id % 5 <> 0 THEN ',"recorded_at":"' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(meeting_id), '%Y-%m-%dT%H:%M:%SZ') || '"' ELSE '' END ||
       CASE WHEN meeting_id % 3 = 0 THEN ',"echo_segments_removed":2' ELSE '' END ||
       CASE WHEN p.session_id IS NULL THEN '' ELSE ',"capture_provenance":{{"engine":"tap","route_changes":' || route_changes || ',"retries":' || retries || ',"recovered":' || recovered ||
         ',"anomaly_count":' || anomaly_count || ',"quality_anomaly_count":' || quality_anomaly_count || ',"system_audio_unrecovered":' || system_audio_unrecovered || '}}' END ||
       ',"disclosure":{{"summary_generated":false,"transcript_transmitted":false}}}}' AS metadata
FROM (SELECT meeting_id, string_agg('m' || meeting_id || '-' || chunk_index || '.wav', '","' ORDER BY chunk_index) AS files, bool_or(is_dual_stream) AS dual,
             string_agg('/r/m' || meeting_id || '-' || chunk_index || '.wav', '","' ORDER BY chunk_index) AS paths,
             CASE meeting_id % 4 WHEN 0 THEN 'srt' WHEN 1 THEN 'txt' WHEN 2 THEN 'json' ELSE 'pdf' END AS output_format FROM v_chunks GROUP BY meeting_id)
LEFT JOIN (SELECT session_id, {PROVENANCE} FROM v_capture_events GROUP BY session_id) p ON p.session_id = meeting_id""", ("v_chunks", "v_capture_events"))
def p24(t):
    known = captured(t).withColumnRenamed("session_id", "meeting_id")
    return dc.document_metadata(meetings(t).join(known, "meeting_id", "left")).select("meeting_id", F.to_json("metadata").alias("metadata"))


@query("p25_audio_paths", """
SELECT m.meeting_id, CASE WHEN m.meeting_id % 2 = 0 THEN 'archive/m' || m.meeting_id || '.m4a' ELSE 'raw/m' || m.meeting_id || '.wav' END AS path,
       CASE WHEN m.meeting_id % 2 = 0 THEN 'm' || m.meeting_id || '.m4a' ELSE 'm' || m.meeting_id || '.wav' END AS file FROM (SELECT DISTINCT meeting_id FROM v_segments) m""", ("v_segments",))
def p25(t):
    ids = t.chunks.select("meeting_id").distinct()
    name = F.concat(F.lit("m"), F.col("meeting_id").cast("string"))
    meta = ids.select("meeting_id", F.struct(F.array(F.concat(F.lit("raw/"), name, F.lit(".wav"))).alias("audio_paths"),
                                             F.array(F.concat(name, F.lit(".wav"))).alias("audio_files")).alias("metadata"))
    archive = ids.where("meeting_id % 2 = 0").select("meeting_id", F.array(F.concat(F.lit("archive/"), name, F.lit(".m4a"))).alias("new_paths"))
    out = dc.with_audio_paths(meta, archive)
    return out.select("meeting_id", F.get("metadata.audio_paths", F.lit(0)).alias("path"), F.get("metadata.audio_files", F.lit(0)).alias("file"))


def _stored_sessions(t):
    """Session files as an older build wrote them: some without the channel flag, some cut off."""
    s = t.segments
    seg = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", F.lit("Speaker 1").alias("speaker"), "source")
    parts = s.groupBy("meeting_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("seg_ord", seg.alias("s")))).alias("a"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("chunk_index") * 40)
    chunk = F.struct(F.col("chunk_index").alias("index"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTime"), F.lit("a.m4a").alias("audioPath"),
                     F.transform("a", lambda x: x["s"]).alias("segments"), F.create_map(F.lit("Speaker 1"), F.array(F.lit(0.5), F.lit(1.0))).alias("speakerDatabase"),
                     F.when(F.col("meeting_id") % 2 == 0, F.lit(False)).alias("is_dual_stream"))
    doc = F.to_json(F.struct(F.concat(F.lit("m"), F.col("meeting_id").cast("string")).alias("sessionId"), F.lit("2024-01-01T00:00:00Z").alias("meetingStart"),
                             F.lit("fluid").alias("engine"), F.lit(30).alias("chunkDurationMinutes"), F.array(chunk).alias("chunks")))
    cut = F.when(F.col("meeting_id") % 7 == 3, F.expr("substring(doc, 1, length(doc) - 5)")).otherwise(F.col("doc"))
    path = scratch_dir(t.spark, "sessions")
    parts.withColumn("doc", doc).select(cut.alias("value")).write.text(path)
    return ss.read_sessions(t.spark, path, multi_line=False)


@query("s1_session_scan", """
SELECT 'm' || meeting_id AS session_id, chunk_index, CAST(0 AS INTEGER) AS echo_segments_removed, CASE WHEN meeting_id % 2 = 0 THEN FALSE ELSE is_dual_stream END AS is_dual_stream,
       CAST(segments AS INTEGER) AS segments, CAST(0 AS INTEGER) AS local_voices, CAST(1704067200 + chunk_index * 40 AS BIGINT) AS start_s FROM v_chunks WHERE meeting_id % 7 <> 3""", ("v_chunks",))
def s1(t):
    chunks, _ = _stored_sessions(t)
    return chunks.select("session_id", "chunk_index", "echo_segments_removed", "is_dual_stream", F.size("segments").alias("segments"),
                         F.size("local_speaker_database").alias("local_voices"), F.unix_seconds("start_time").alias("start_s"))


@query("s1_session_quarantine", "SELECT count(*) AS n FROM v_chunks WHERE meeting_id % 7 = 3", ("v_chunks",))
def s1_bad(t):
    return _stored_sessions(t)[1].groupBy().agg(F.count(F.lit(1)).alias("n"))


@query("s2_session_sink", """
SELECT session_id, chunk_index, CAST(count(*) AS BIGINT) AS n, max(stamp) AS stamp FROM (
  SELECT 'm' || meeting_id AS session_id, chunk_index, CASE WHEN chunk_index = 1 THEN 'second' ELSE 'first' END AS stamp FROM v_segments) GROUP BY ALL""", ("v_segments",))
def s2(t):
    path = scratch_dir(t.spark, "chunks")
    out = t.segments.select(F.concat(F.lit("m"), F.col("meeting_id").cast("string")).alias("session_id"), "chunk_index", "seg_ord", "text")
    ss.write_chunks(out.withColumn("stamp", F.lit("first")), path, 1)
    ss.write_chunks(out.where("chunk_index = 1").withColumn("stamp", F.lit("second")), path, 2)
    return ss.read_chunks(t.spark, path).groupBy("session_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.max("stamp").alias("stamp"))


@query("s8_diagnostics_lines", """
SELECT origin, kind, severity, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM v_capture_events WHERE event_ord % 50 <> 0""", ("v_capture_events",))
def s8(t):
    path = scratch_dir(t.spark, "events")
    line = F.when(F.col("event_ord") % 50 == 0, "{not json").otherwise(mo.event_json())
    t.capture_events.select(line.alias("value")).write.text(path)
    return capture.read_events(t.spark, path).select("origin", "kind", "severity", F.unix_seconds("ts").alias("at_s"))


@query("s19_prompts", f"""
SELECT meeting_id, CAST(place AS BIGINT) AS place, '[' || {CLOCK.format('CAST(trunc(start) AS BIGINT)')} || '] ' || speaker || ' (' || source || '): ' || text AS value FROM r_rows
UNION ALL
SELECT meeting_id, unnest(range(-5, 1)) AS place, unnest(['Meeting: m' || meeting_id, 'Date: 2024-01-01', 'Duration: ' ||
  CASE WHEN d // 3600 > 0 THEN printf('%dh %dm', d // 3600, d % 3600 // 60) ELSE printf('%dm', d % 3600 // 60) END, 'Participants: ' || who, '', '--- TRANSCRIPT ---']) AS value
FROM (SELECT meeting_id, CAST(arg_max("end", place) AS BIGINT) AS d FROM r_rows GROUP BY meeting_id)
JOIN (SELECT meeting_id, string_agg(speaker, ', ' ORDER BY f) AS who FROM (SELECT meeting_id, speaker, min(place) AS f FROM r_rows GROUP BY ALL) GROUP BY meeting_id) USING (meeting_id)""", ("r_rows",))
def s19(t):
    r = written(rows(t), "rows")
    people = ag.participants(r, ["place"])
    who = people.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "speaker"))), lambda p: p["speaker"]), ", ").alias("who"))
    about = who.join(ag.meeting_length(r, ["place"], "end"), "meeting_id")
    name = F.concat(F.lit("m"), F.col("meeting_id").cast("string"))
    heads = about.select("meeting_id", dc.message_head(name, F.lit("2024-01-01"), F.col("duration_s"), F.col("who")).alias("head"))
    return dc.prompt_lines(r, heads, F.lit(True))


@query("p9_renamed", """
SELECT meeting_id, seg_ord, CASE WHEN speaker = 'Local Speaker 1' AND meeting_id % 2 = 0 THEN 'Ana ' || meeting_id ELSE speaker END AS speaker FROM r_tagged""", ("r_tagged",))
def p9(t):
    names = t.chunks.select("meeting_id").distinct().where("meeting_id % 2 = 0").select(
        "meeting_id", F.lit("Local Speaker 1").alias("speaker"), F.concat(F.lit("Ana "), F.col("meeting_id").cast("string")).alias("new_name"))
    return dc.renamed(tagged(t), names).select("meeting_id", "seg_ord", "speaker")


@query("a18_name_record", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS b FROM customer""")
def a18(t):
    k, text = F.col("c_custkey"), F.lit("a")
    existing = F.create_map(text, F.lit("old"))
    incoming = F.create_map(text, F.when(k % 2 == 0, "new").otherwise("a"), F.lit("b"), F.when(k % 3 == 0, "b").otherwise(F.col("c_mktsegment")))
    names = dc.recorded_names(existing, incoming)
    return t.raw("customer").select("c_custkey", F.try_element_at(names, F.lit("a")).alias("a"), F.try_element_at(names, F.lit("b")).alias("b"))


@query("p10_disclosure", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'local (127.0.' || page_id % 256 || '.1:' || 1000 + page_id || ')' WHEN 1 THEN 'local (localhost)' WHEN 2 THEN 'remote (127.0.0.300)' WHEN 3 THEN 'remote (unknown)' WHEN 4 THEN 'local (::1:11434)'
  ELSE 'remote (' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) || ')' END AS label, page_id % 6 IN (2, 3, 5) AS transmitted FROM pages""")
def p10(t):
    k = F.col("page_id")
    url = (F.when(k % 6 == 0, F.concat(F.lit("http://127.0."), (k % 256).cast("string"), F.lit(".1:"), (1000 + k).cast("string"), F.lit("/v1")))
           .when(k % 6 == 1, "http://localhost/v1").when(k % 6 == 2, "https://127.0.0.300/x").when(k % 6 == 3, "not an address").when(k % 6 == 4, "http://[::1]:11434/api").otherwise(F.col("url")))
    return t.raw("pages").select("page_id", us.disclosure(url).alias("d")).select("page_id", "d.*")


@query("p11_recording_date", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('millisecond', ts)) WHEN 2 THEN epoch_us(ts + INTERVAL 1 DAY) ELSE 1767225600000000 END AS at_us FROM events""")
def p11(t):
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 2, "yesterday")
    file_date = F.when(k == 2, ts + F.expr("INTERVAL 1 DAY"))
    return t.raw("events").select("event_id", F.unix_micros(dc.recording_date(raw, file_date, F.lit("2026-01-01 00:00:00").cast("timestamp"))).alias("at_us"))


define("r_paths", ("v_segments",), """
SELECT meeting_id, CAST(pos AS INT) AS pos, CASE WHEN meeting_id % 5 = 0 AND pos = 0 THEN '/r/a.M4A' WHEN meeting_id % 3 = 0 AND pos = 1 THEN '/r/a_mic.wav' WHEN meeting_id % 11 = 0 THEN '/r/b_mic.wav' ELSE '/r/c.wav' END AS path
FROM (SELECT DISTINCT meeting_id FROM v_segments), range(3) r(pos) WHERE pos <= meeting_id % 3 OR (meeting_id % 3 = 0 AND pos = 1)""")


@query("p12_audio_layout", """
SELECT meeting_id, CASE WHEN bool_or(suffix(lower(path), '.m4a')) THEN 'chunks' WHEN count(*) = 2 AND bool_or(pos = 1 AND suffix(path, '_mic.wav')) THEN 'dual'
  WHEN count(*) = 1 AND NOT bool_or(suffix(path, '_mic.wav')) THEN 'single' ELSE 'chunks' END AS layout FROM r_paths GROUP BY meeting_id""", ("r_paths",))
def p12(t):
    m = F.col("meeting_id")
    p = t.chunks.select("meeting_id").distinct().withColumn("pos", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    p = p.where("pos <= meeting_id % 3 OR (meeting_id % 3 = 0 AND pos = 1)")
    path = (F.when((m % 5 == 0) & (F.col("pos") == 0), "/r/a.M4A").when((m % 3 == 0) & (F.col("pos") == 1), "/r/a_mic.wav").when(m % 11 == 0, "/r/b_mic.wav").otherwise("/r/c.wav"))
    return dc.audio_layout(p.withColumn("path", path), ["meeting_id"])


@query("a2_participants", "SELECT meeting_id, speaker, min(seg_ord) AS first_ord FROM r_tagged GROUP BY ALL", ("r_tagged",))
def a2(t):
    return ag.participants(tagged(t), ["seg_ord"]).select("meeting_id", "speaker", F.col("seg_ord").alias("first_ord"))


@query("a3_meeting_length", """SELECT meeting_id, arg_max("end", place) AS duration_s FROM r_rows GROUP BY meeting_id""", ("r_rows",))
def a3(t):
    return ag.meeting_length(rows(t), ["place"], "end")


@query("a4_language_verdict", """
SELECT source, doc_id % 97 AS batch, CASE WHEN count(DISTINCT l) = 0 THEN 'auto' WHEN count(DISTINCT l) = 1 THEN min(l) ELSE 'multilingual' END AS language
FROM (SELECT *, CASE WHEN n_chars % 4 = 0 THEN lang END AS l FROM documents) GROUP BY ALL""")
def a4(t):
    d = t.raw("documents").withColumn("language", F.when(F.col("n_chars") % 4 == 0, F.col("lang"))).withColumn("batch", F.col("doc_id") % 97)
    return ag.language_verdict(d, ["source", "batch"])


@query("a16_significant_speakers", """
SELECT meeting_id, speaker, n_rows FROM (SELECT meeting_id, speaker, count(*) AS n_rows FROM r_tagged WHERE trim(text) <> '' GROUP BY ALL)
QUALIFY n_rows >= 3 OR max(n_rows) OVER (PARTITION BY meeting_id) < 3""", ("r_tagged",))
def a16(t):
    return ag.significant_speakers(tagged(t), 3)


@query("a19_speech_ratio", """
SELECT meeting_id, chunk_index, source, round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS speech_ratio FROM v_speech GROUP BY ALL""", ("v_speech",))
def a19(t):
    return ag.speech_ratio(t.speech, ["meeting_id", "chunk_index", "source"]).withColumn("speech_ratio", F.round("speech_ratio", 6))


@query("a23_session_totals", "SELECT meeting_id, count(*) AS chunks, bool_or(is_dual_stream) AS dual_stream FROM v_chunks GROUP BY meeting_id", ("v_chunks",))
def a23(t):
    return ag.session_totals(t.chunks)
