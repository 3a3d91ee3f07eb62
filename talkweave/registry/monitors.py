"""Capture monitors in batch: A1, A20, P13-P15, W9, W10, W12-W16, W19, U2, U4, U5."""

from pyspark.sql import functions as F

from ..operators import aggregates as ag, documents as dc, monitors as mo
from ..operators.ordered import blocks_of
from .base import query
from .tables import _d, define

PROVENANCE = """count(*) FILTER (WHERE kind = 'restartInPlace') AS route_changes, count(*) FILTER (WHERE kind = 'retry') AS retries,
  bool_or(kind = 'launchRecovery') AS recovered, count(*) FILTER (WHERE severity = 'anomaly') AS anomaly_count,
  count(*) FILTER (WHERE kind IN ('excessivePadding', 'rateDrift', 'sustainedFormatDrop', 'systemAudioUnrecovered', 'restartFailed', 'captureSourceFallback')) AS quality_anomaly_count,
  bool_or(kind = 'systemAudioUnrecovered') AS system_audio_unrecovered"""


@query("a1_provenance", f"SELECT session_id, {PROVENANCE} FROM v_capture_events GROUP BY session_id", ("v_capture_events",))
def a1(t):
    return ag.provenance(t.capture_events, ["session_id"])


@query("p13_quality_notice", """
SELECT session_id, CASE WHEN n > 0 THEN 'Transcription Complete — capture anomalies' ELSE 'Transcription Complete' END AS title,
  CASE WHEN n > 0 THEN f || ' — ' || n || ' capture ' || CASE WHEN n = 1 THEN 'anomaly' ELSE 'anomalies' END || ' recorded; audio may be affected' ELSE f END AS body
FROM (SELECT session_id, 's' || session_id || '.json' AS f, count(*) FILTER (WHERE kind = 'excessivePadding') // 10 AS n FROM v_capture_events GROUP BY session_id)""",
       ("v_capture_events",))
def p13(t):
    n = F.floor(F.col("quality_anomaly_count") / 10)
    p = ag.provenance(t.capture_events, ["session_id"])
    name = F.concat(F.lit("s"), F.col("session_id").cast("string"), F.lit(".json"))
    return p.select("session_id", dc.quality_notice(name, F.when(n > 0, n)).alias("q")).select("session_id", "q.*")


@query("p14_clock_risk", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'drift' WHEN rate IN (8000, 16000, 24000, 32000) THEN 'degraded_rate'
  WHEN event_type = 'click' THEN 'bluetooth' WHEN event_type = 'view' THEN 'virtual' ELSE 'keep' END AS risk
FROM (SELECT *, CASE WHEN value < 20 THEN 16000 WHEN value < 30 THEN 44100 WHEN value < 40 THEN 8000 ELSE 48000 END AS rate FROM events)""")
def p14(t):
    v = F.col("value")
    rate = F.when(v < 20, 16000).when(v < 30, 44100).when(v < 40, 8000).otherwise(48000)
    return t.raw("events").select("event_id", mo.clock_risk(
        rate, F.col("event_type") == "click", F.col("event_type") == "view", F.col("event_id") % 11 == 0).alias("risk"))


@query("p15_writer_compatible", """
SELECT a.buffer_ord, a.sample_rate = 48000 AND a.channels = 1 AS compatible FROM v_formats a""", ("v_formats",))
def p15(t):
    return t.formats.select("buffer_ord", mo.same_format(F.col("sample_rate"), F.col("channels"), F.lit(48000), F.lit(1)).alias("compatible"))


@query("a20_frame_level", """
SELECT vec_id, round(rms, 6) AS rms, round(CASE WHEN rms > 0 THEN least(greatest((20 * log10(rms) + 50) / 50, 0), 1) ELSE 0 END, 6)::DOUBLE AS level
FROM (SELECT vec_id, sqrt(avg(x * x)) AS rms FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)""")
def a20(t):
    samples = t.raw("embeddings").select("vec_id", F.explode("embedding").alias("x"))
    lv = ag.level(samples, ["vec_id"], F.col("x").cast("double"))
    return lv.select("vec_id", F.round("rms", 6).alias("rms"), F.round("level", 6).alias("level"))


define("r_lines", ("v_capture_events",), """
SELECT *, '{"detail":{},"kind":"' || kind || '","origin":"' || origin || '","severity":"' || severity || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS line
FROM v_capture_events""")


@query("w9_ring_retained", """
SELECT session_id, event_ord FROM (
  SELECT *, count(*) OVER w AS n, sum(strlen(line) + 1) OVER w AS b FROM r_lines WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, event_ord DESC ROWS UNBOUNDED PRECEDING))
WHERE n = 1 OR (n <= 40 AND b <= 4000)""", ("r_lines",))
def w9(t):
    kept = mo.retained(t.capture_events, F.octet_length(mo.event_json()) + 1, max_events=40, max_bytes=4000)
    return kept.select("session_id", "event_ord")


@query("w10_merged_events", """
SELECT session_id, event_ord, origin, row_number() OVER (PARTITION BY session_id ORDER BY ts, origin, event_ord) AS place FROM v_capture_events""", ("v_capture_events",))
def w10(t):
    e = t.capture_events
    both = mo.merged_in_time(e.where("origin = 'app'"), e.where("origin = 'helper'"))
    return both.select("session_id", "event_ord", "origin", "place")


@query("w12_retry_streaks", """
SELECT session_id, failed_at_s, n AS retry_count, n > 2 AS give_up FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY failed_at_s) AS n FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY failed_at_s) AS island
    FROM (SELECT *, failed_at_s - lag(failed_at_s) OVER (PARTITION BY session_id ORDER BY failed_at_s) AS gap FROM v_failures)))""", ("v_failures",))
def w12(t):
    return mo.retry_streaks(t.failures)


@query("w13_format_changes", """
SELECT session_id, buffer_ord, CASE WHEN p IS NULL THEN 'first' WHEN p = sample_rate THEN 'unchanged' ELSE 'changed' END AS observation,
       CASE WHEN p <> sample_rate THEN p END AS from_rate
FROM (SELECT *, lag(sample_rate) OVER (PARTITION BY session_id ORDER BY buffer_ord) AS p FROM v_formats)""", ("v_formats",))
def w13(t):
    return mo.format_changes(t.formats, ["session_id"]).select("session_id", "buffer_ord", "observation", "from_rate")


@query("w14_sticky_drops", """
SELECT session_id, chunk_index, buffer_ord, sample_rate, cfg AS configured_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, chunk_index, grp, ok ORDER BY buffer_ord) AS run FROM (
    SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, chunk_index ORDER BY buffer_ord) AS grp FROM (
      SELECT *, sample_rate = first_value(sample_rate) OVER (PARTITION BY session_id ORDER BY buffer_ord) AS ok,
             first_value(sample_rate) OVER (PARTITION BY session_id ORDER BY buffer_ord) AS cfg FROM v_formats)))
WHERE NOT ok AND run = 100""", ("v_formats",))
def w14(t):
    return mo.sticky_drops(t.formats, ["session_id"], ["session_id", "chunk_index"]).select(
        "session_id", "chunk_index", "buffer_ord", "sample_rate", "configured_rate")


define("r_padded", ("v_frames",), """
SELECT *, CAST(g - coalesce(lag(g) OVER (PARTITION BY track_id, chunk_index ORDER BY buffer_ord), 0) AS BIGINT) AS pad_frames FROM (
  SELECT *, max(greatest(target_frame - s, 0)) OVER (PARTITION BY track_id, chunk_index ORDER BY buffer_ord) AS g FROM (
    SELECT *, coalesce(sum(data_frames) OVER (PARTITION BY track_id, chunk_index ORDER BY buffer_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_frames))""")
TRACK = ["track_id", "chunk_index"]


@query("w15_silence_padding", "SELECT track_id, chunk_index, buffer_ord, pad_frames FROM r_padded", ("r_padded",))
def w15(t):
    return mo.clamped_padding(t.frames, TRACK)


define("r_bursty", ("v_frames",), """
SELECT track_id, CAST(chunk_index AS BIGINT) AS chunk_index, buffer_ord, data_frames, target_frame * CASE WHEN chunk_index % 4 = 0 THEN 3 ELSE 1 END AS target_frame, CAST(7 AS DOUBLE) AS rate FROM v_frames""")


@query("u4_clamped_padding", """
SELECT track_id, chunk_index, buffer_ord, pad_frames FROM (
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY track_id, chunk_index ORDER BY buffer_ord) AS k FROM r_bursty),
r AS (
  SELECT track_id, chunk_index, buffer_ord, k, CAST(greatest(0, least(target_frame, 420)) AS BIGINT) AS pad_frames,
         CAST(greatest(0, least(target_frame, 420)) + data_frames AS BIGINT) AS written FROM o WHERE k = 1
  UNION ALL
  SELECT o.track_id, o.chunk_index, o.buffer_ord, o.k, CAST(greatest(0, least(o.target_frame - r.written, 420)) AS BIGINT),
         CAST(r.written + greatest(0, least(o.target_frame - r.written, 420)) + o.data_frames AS BIGINT)
  FROM r JOIN o ON o.track_id = r.track_id AND o.chunk_index = r.chunk_index AND o.k = r.k + 1)
SELECT * FROM r)""", ("r_bursty",))
def u4(t):
    target = F.when(F.col("chunk_index") % 4 == 0, F.col("target_frame") * 3).otherwise(F.col("target_frame"))
    bursty = t.frames.withColumn("target_frame", target).withColumn("rate", _d(7)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    return mo.clamped_padding(bursty, TRACK)


@query("w16_pad_alarm", """
SELECT track_id, chunk_index, min(buffer_ord) AS buffer_ord, round(arg_min(p / tot, buffer_ord), 6) AS ratio, round(arg_min(p / rate, buffer_ord), 6) AS padded_s, round(arg_min(tot / rate, buffer_ord), 6) AS total_s
FROM (SELECT *, sum(pad_frames) OVER w AS p, sum(pad_frames + data_frames) OVER w AS tot FROM r_padded WINDOW w AS (PARTITION BY track_id, chunk_index ORDER BY buffer_ord))
WHERE tot > 0 AND tot / rate >= 30 AND p / rate >= 15 AND p / tot > 0.1 GROUP BY track_id, chunk_index""", ("r_padded",))
def w16(t):
    padded = t.frames.join(mo.clamped_padding(t.frames, TRACK), [*TRACK, "buffer_ord"])
    a = mo.pad_alarm(padded, TRACK)
    return a.select(*TRACK, "buffer_ord", *[F.round(c, 6).alias(c) for c in ("ratio", "padded_s", "total_s")])


@query("w19_liveness", """
SELECT session_id, max(ts) FILTER (WHERE kind = 'captureStart') IS NOT NULL AND
       coalesce(max(ts) FILTER (WHERE kind = 'captureStart') > max(ts) FILTER (WHERE kind = 'streamStopError'), FALSE) AS resumed
FROM v_capture_events GROUP BY session_id HAVING max(ts) FILTER (WHERE kind = 'streamStopError') IS NOT NULL""", ("v_capture_events",))
def w19(t):
    e = t.capture_events
    probes = e.where("kind = 'streamStopError'").groupBy("session_id").agg(F.max("ts").alias("probe_start"))
    arrivals = e.where("kind = 'captureStart'").select("session_id", F.col("ts").alias("arrived"))
    return mo.alive(arrivals, probes, ["session_id"]).select("session_id", "resumed")


@query("u2_rate_drift", """
SELECT track_id, cb_ord, verdict, round(ratio, 6) AS ratio FROM (
WITH RECURSIVE c AS (SELECT *, sum(frames) OVER (PARTITION BY track_id ORDER BY cb_ord) AS s FROM v_callbacks),
nx AS (SELECT a.track_id, a.cb_ord, min(b.cb_ord) AS nxt FROM c a JOIN c b ON a.track_id = b.track_id AND b.host_nanos - a.host_nanos >= 5000000000 AND b.host_nanos - a.host_nanos < 6000000000 GROUP BY ALL),
step AS (SELECT a.track_id, a.cb_ord, b.cb_ord AS nxt, a.s AS s0, a.frames AS f0, b.s AS s1, (b.host_nanos - a.host_nanos) / 1e9 AS dt
         FROM nx JOIN c a USING (track_id, cb_ord) JOIN c b ON b.track_id = nx.track_id AND b.cb_ord = nx.nxt),
r AS (
  SELECT track_id, nxt AS cb_ord, (s1 - s0 + f0) / dt / 48000 AS ratio FROM step WHERE (track_id, cb_ord) IN (SELECT (track_id, min(cb_ord)) FROM c GROUP BY track_id)
  UNION ALL
  SELECT step.track_id, step.nxt, (step.s1 - step.s0) / step.dt / 48000 FROM r JOIN step ON step.track_id = r.track_id AND step.cb_ord = r.cb_ord
  WHERE r.ratio BETWEEN 0.95 AND 1.05)
SELECT track_id, cb_ord, CASE WHEN ratio BETWEEN 0.95 AND 1.05 THEN 'healthy' ELSE 'drift' END AS verdict, ratio FROM r)""", ("v_callbacks",))
def u2(t):
    return mo.rate_drift(t.callbacks, ["track_id"]).withColumn("ratio", F.round("ratio", 6))


define("r_signals", (), """
SELECT user_id % 15 + 15 * (event_id // 5000) AS device_id, event_id AS signal_ord, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS at_s,
       event_type IN ('click', 'view', 'purchase') AND event_id % 7 <> 0 AS eligible FROM events""")


@query("u5_prompts", """
SELECT device_id, signal_ord, at_s FROM (
WITH RECURSIVE e AS (SELECT * FROM r_signals WHERE eligible),
nx AS (SELECT a.device_id, a.signal_ord, a.at_s, b.signal_ord AS n_ord, b.at_s AS n_at FROM (SELECT *, at_s + 300 AS t300 FROM e) a ASOF LEFT JOIN e b ON a.device_id = b.device_id AND a.t300 <= b.at_s),
r AS (SELECT * FROM nx QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY at_s, signal_ord) = 1
  UNION ALL SELECT nx.* FROM r JOIN nx ON nx.device_id = r.device_id AND nx.signal_ord = r.n_ord)
SELECT * FROM r)""", ("r_signals",))
def u5(t):
    eligible = mo.meeting_signal(F.lit(True), F.col("event_id") % 7 == 0, F.col("event_type").isin("click", "view"), F.lit(True)) | (
        (F.col("event_type") == "purchase") & (F.col("event_id") % 7 != 0))
    signals = t.raw("events").select((F.col("user_id") % 15 + 15 * F.floor(F.col("event_id") / 5000)).alias("device_id"), F.col("event_id").alias("signal_ord"),
                                     (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at_s"), eligible.alias("eligible"))
    return mo.prompts(signals)
