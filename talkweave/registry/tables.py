"""Meeting-shaped inputs derived from the given tables.

Every input exists twice: as a DataFrame (one scan of its source table each) and as SQL text for the oracle.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MEETING = ["meeting_id"]
CHUNK = ["meeting_id", "chunk_index"]
STREAM = ["meeting_id", "chunk_index", "source"]
SEGMENT = ["meeting_id", "chunk_index", "source", "seg_ord"]


def _d(x: Column | int | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))

    @cached_property
    def segments(self) -> DataFrame:
        """Recognised segments; the ``local`` copies of remote speech are echoes picked up by the microphone."""
        c = self.raw("conversations")
        turn, n = F.col("turn"), F.length("text") % 13
        chunk = F.floor(turn / 4).cast("int")
        base = _d(turn % 4 * 10)

        def row(keep, seg_ord, source, start, end, confidence):
            return F.when(keep, F.struct(
                F.col("conv_id").alias("meeting_id"), chunk.alias("chunk_index"),
                seg_ord.cast("int").alias("seg_ord"), source.alias("source"), start.alias("start_s"),
                end.alias("end_s"), F.col("text").alias("text"), confidence.alias("confidence")))

        spoken = row(F.lit(True), turn * 2, F.when(F.col("role") == "user", "local").otherwise("remote"),
                     base, _d(turn % 4 * 10 + n), _d(0.5) + _d(F.length("text") % 50) / 100)
        echo = row((F.col("role") != "user") & (n > 2) & (turn % 2 == 1), turn * 2 + 1, F.lit("local"),
                   base + _d(0.25), _d(turn % 4 * 10 + n), _d(0.5))
        rows = F.filter(F.array(spoken, echo), lambda r: r.isNotNull())
        return c.select(F.inline(rows))

    @cached_property
    def words(self) -> DataFrame:
        """One row per recognised word; its leading blank belongs to it."""
        pos = self.segments.select(*SEGMENT, "start_s",
                                   F.posexplode(F.split("text", " ")).alias("word_ord", "token"))
        start = F.col("start_s") + F.col("word_ord") * _d(0.3)
        return pos.select(*SEGMENT, "word_ord", start.alias("w_start"), (start + _d(0.25)).alias("w_end"),
                          F.concat(F.lit(" "), "token").alias("word"))

    @cached_property
    def turns(self) -> DataFrame:
        """Diarized turns: two per segment, meeting at its middle; every second one has no quality."""
        half = F.col("start_s") + _d(0.5) * (F.col("end_s") - F.col("start_s"))
        quality = _d(F.length("text") % 10) / 10

        def turn(order, start, end, shift, q):
            label = F.concat(F.lit("S"), ((F.col("seg_ord") + shift) % 3 + 2).cast("string"))
            return F.struct(order.alias("turn_ord"), start.alias("t_start"), end.alias("t_end"),
                            label.alias("speaker"), q.alias("quality_score"))

        pair = F.array(turn(F.col("seg_ord") * 2, F.col("start_s") - _d(0.5), half, 0, quality),
                       turn(F.col("seg_ord") * 2 + 1, half, F.col("end_s") + _d(0.5), 1, F.lit(None).cast("double")))
        return self.segments.select(*STREAM, F.inline(pair))

    @cached_property
    def speech(self) -> DataFrame:
        return self.segments.select(*STREAM, F.col("start_s").alias("r_start"),
                                    (F.col("start_s") + _d(2)).alias("r_end"),
                                    (_d(F.col("seg_ord") % 10) / 10).alias("probability"))

    @cached_property
    def chunks(self) -> DataFrame:
        return self.segments.groupBy(*CHUNK).agg(
            F.max("end_s").alias("last_end"), F.count(F.lit(1)).alias("segments"),
            F.bool_or(F.col("source") == "local").alias("is_dual_stream"))

    @cached_property
    def speaker_embeddings(self) -> DataFrame:
        """Two voices per channel and chunk; ``Speaker 1`` has the same voice on both channels."""
        vectors = self.raw("embeddings")
        total = vectors.agg(F.count(F.lit(1))).scalar()
        voices = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f"Speaker {k}").alias("speaker"), F.lit(d).alias("d"))
                           for s, k, d in (("remote", 1, 0), ("remote", 2, 1), ("local", 1, 0), ("local", 2, 2))])
        chunks = self.segments.select(*CHUNK).distinct()
        wanted = chunks.select(*CHUNK, F.inline(voices)).withColumn(
            "vec_id", (F.col("meeting_id") * 5 + F.col("d") + F.col("chunk_index")) % total)
        return wanted.join(vectors, "vec_id").select(*STREAM, "speaker", "embedding")

    @cached_property
    def capture_events(self) -> DataFrame:
        kind = (F.when(F.col("event_type") == "error", "streamStopError")
                .when(F.col("event_type") == "click", "excessivePadding")
                .when(F.col("event_type") == "view", "restartInPlace")
                .when(F.col("event_type") == "purchase", "retry").otherwise("captureStart"))
        severity = (F.when(F.col("event_type").isin("error", "click"), "anomaly")
                    .when(F.col("event_type") == "purchase", "warning").otherwise("info"))
        return self.raw("events").select(
            F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
            F.when(F.col("event_id") % 2 == 0, "app").otherwise("helper").alias("origin"),
            kind.alias("kind"), severity.alias("severity"), F.col("event_id").alias("event_ord"))

    @cached_property
    def frames(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            (e % 3).cast("int").alias("track_id"), F.floor(e / 250).cast("int").alias("chunk_index"),
            e.alias("buffer_ord"), (F.floor(F.col("value") * 10) * (1 + e % 3)).cast("bigint").alias("data_frames"),
            (e % 250 * 250).cast("bigint").alias("target_frame"), _d(480).alias("rate"))

    @cached_property
    def callbacks(self) -> DataFrame:
        e, slow = F.col("event_id"), (F.col("event_id") % 15 % 4 == 0) & (F.col("event_id") > 500)
        return self.raw("events").select(
            (e % 15).cast("int").alias("track_id"), e.alias("cb_ord"), (e * 10000000).alias("host_nanos"),
            _d(48000).alias("declared_rate"), F.when(slow, 3600).otherwise(7200).cast("int").alias("frames"))

    @cached_property
    def failures(self) -> DataFrame:
        return self.raw("events").where("event_type = 'purchase'").select(
            (F.col("user_id") % 15 + 15 * F.floor(F.col("event_id") / 5000)).cast("int").alias("session_id"), (F.col("event_id") * 8).alias("failed_at_s"))

    @cached_property
    def formats(self) -> DataFrame:
        e = F.col("event_id")
        rate = F.when(F.floor(e / 150) % 3 == 1, 24000).otherwise(48000)
        return self.raw("events").select(
            F.floor(e / 3000).cast("int").alias("session_id"), F.floor(e / 500).cast("int").alias("chunk_index"),
            e.alias("buffer_ord"), rate.cast("int").alias("sample_rate"), F.lit(1).alias("channels"))

    @cached_property
    def files(self) -> DataFrame:
        """Recording files: one session per user, several copies of an index are later rewrites."""
        mic = F.when(F.col("event_type") == "view", "_mic").otherwise("")
        session = F.concat(F.lit("m"), F.col("user_id").cast("string"))
        return self.raw("events").select(
            F.concat(session, F.lit("-"), (F.col("event_id") % 7).cast("string"), mic, F.lit(".wav")).alias("file_name"),
            (F.floor(F.col("value") * 1000) + 44).cast("bigint").alias("length"),
            F.col("ts").cast("timestamp").alias("modified"), F.col("event_id").alias("file_ord"))

    @cached_property
    def eval_pairs(self) -> DataFrame:
        item, text = F.col("item_id"), F.col("text")
        lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "pt", "es"))), (item % 4 + 1).cast("int"))
        runs = F.array(
            F.struct(F.lit("fluid").alias("engine"), F.replace(text, F.lit("the"), F.lit("teh")).alias("hypothesis")),
            F.struct(F.lit("other").alias("engine"), F.replace(text, F.lit(" th"), F.lit(" an th")).alias("hypothesis")))
        return (self.raw("benchmark")
                .select(F.concat(lang, F.lit("-"), item.cast("string"), F.lit(".wav")).alias("file_name"),
                        text.alias("reference"), _d(1 + F.length(text) % 7).alias("wall_s"),
                        _d(F.length(text)).alias("audio_s"), F.inline(runs))
                .select("file_name", "engine", "reference", "hypothesis", "wall_s", "audio_s"))

    @cached_property
    def usage(self) -> DataFrame:
        e, v = F.col("event_id"), F.col("value")
        kind = F.when(e % 97 == 0, "forced").when(e % 31 == 0, "seed").otherwise("real")
        return self.raw("events").select(
            F.col("event_type").alias("model"), e.alias("call_ord"), F.floor(v * 100).cast("bigint").alias("input_chars"),
            F.floor(v * 100 / (2 + e % 4)).cast("bigint").alias("input_tokens"), kind.alias("kind"))

    @cached_property
    def calendar(self) -> DataFrame:
        start = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            F.col("event_id").alias("cal_id"), start.alias("starts_at"),
            (start + F.expr("INTERVAL 45 MINUTES")).alias("ends_at"), (F.col("event_id") % 10 == 0).alias("all_day"),
            (F.col("event_type") == "error").alias("declined"))


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_segments": ((), """
SELECT conv_id AS meeting_id, CAST(floor(turn / 4) AS INT) AS chunk_index, CAST(turn * 2 AS INT) AS seg_ord,
       CASE WHEN role = 'user' THEN 'local' ELSE 'remote' END AS source,
       CAST((turn % 4) * 10 AS DOUBLE) AS start_s, CAST((turn % 4) * 10 + length(text) % 13 AS DOUBLE) AS end_s,
       text, CAST(0.5 AS DOUBLE) + CAST(length(text) % 50 AS DOUBLE) / 100 AS confidence
FROM conversations
UNION ALL
SELECT conv_id, CAST(floor(turn / 4) AS INT), CAST(turn * 2 + 1 AS INT), 'local',
       CAST((turn % 4) * 10 AS DOUBLE) + CAST(0.25 AS DOUBLE),
       CAST((turn % 4) * 10 + length(text) % 13 AS DOUBLE), text, CAST(0.5 AS DOUBLE)
FROM conversations WHERE role <> 'user' AND length(text) % 13 > 2 AND turn % 2 = 1"""),
    "v_words": (("v_segments",), """
SELECT meeting_id, chunk_index, source, seg_ord, CAST(p - 1 AS INT) AS word_ord,
       start_s + (p - 1) * CAST(0.3 AS DOUBLE) AS w_start,
       start_s + (p - 1) * CAST(0.3 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS w_end, ' ' || token AS word
FROM v_segments, unnest(string_split(text, ' ')) WITH ORDINALITY AS u(token, p)"""),
    "v_turns": (("v_segments",), """
SELECT meeting_id, chunk_index, source, seg_ord * 2 AS turn_ord, start_s - CAST(0.5 AS DOUBLE) AS t_start,
       start_s + CAST(0.5 AS DOUBLE) * (end_s - start_s) AS t_end,
       'S' || CAST(seg_ord % 3 + 2 AS VARCHAR) AS speaker,
       CAST(length(text) % 10 AS DOUBLE) / 10 AS quality_score
FROM v_segments
UNION ALL
SELECT meeting_id, chunk_index, source, seg_ord * 2 + 1, start_s + CAST(0.5 AS DOUBLE) * (end_s - start_s),
       end_s + CAST(0.5 AS DOUBLE), 'S' || CAST((seg_ord + 1) % 3 + 2 AS VARCHAR), CAST(NULL AS DOUBLE)
FROM v_segments"""),
    "v_speech": (("v_segments",), """
SELECT meeting_id, chunk_index, source, start_s AS r_start, start_s + CAST(2 AS DOUBLE) AS r_end,
       CAST(seg_ord % 10 AS DOUBLE) / 10 AS probability FROM v_segments"""),
    "v_chunks": (("v_segments",), """
SELECT meeting_id, chunk_index, max(end_s) AS last_end, count(*) AS segments,
       bool_or(source = 'local') AS is_dual_stream FROM v_segments GROUP BY ALL"""),
    "v_speaker_embeddings": (("v_segments",), """
SELECT m.meeting_id, m.chunk_index, s.source, 'Speaker ' || CAST(s.k AS VARCHAR) AS speaker, e.embedding
FROM (SELECT DISTINCT meeting_id, chunk_index FROM v_segments) m
CROSS JOIN (VALUES ('remote', 1, 0), ('remote', 2, 1), ('local', 1, 0), ('local', 2, 2)) s(source, k, d)
JOIN embeddings e ON e.vec_id = (m.meeting_id * 5 + s.d + m.chunk_index) % (SELECT count(*) FROM embeddings)"""),
    "v_capture_events": ((), """
SELECT user_id AS session_id, ts, CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'helper' END AS origin,
       CASE event_type WHEN 'error' THEN 'streamStopError' WHEN 'click' THEN 'excessivePadding'
            WHEN 'view' THEN 'restartInPlace' WHEN 'purchase' THEN 'retry' ELSE 'captureStart' END AS kind,
       CASE WHEN event_type IN ('error', 'click') THEN 'anomaly' WHEN event_type = 'purchase' THEN 'warning'
            ELSE 'info' END AS severity, event_id AS event_ord FROM events"""),
    "v_frames": ((), """
SELECT CAST(event_id % 3 AS INT) AS track_id, CAST(floor(event_id / 250) AS INT) AS chunk_index,
       event_id AS buffer_ord, CAST(floor(value * 10) AS BIGINT) * (1 + event_id % 3) AS data_frames,
       CAST((event_id % 250) * 250 AS BIGINT) AS target_frame, CAST(480 AS DOUBLE) AS rate FROM events"""),
    "v_callbacks": ((), """
SELECT CAST(event_id % 15 AS INT) AS track_id, event_id AS cb_ord, event_id * 10000000 AS host_nanos,
       CAST(48000 AS DOUBLE) AS declared_rate,
       CAST(CASE WHEN (event_id % 15) % 4 = 0 AND event_id > 500 THEN 3600 ELSE 7200 END AS INT) AS frames
FROM events"""),
    "v_failures": ((), """
SELECT CAST(user_id % 15 + 15 * (event_id // 5000) AS INT) AS session_id, event_id * 8 AS failed_at_s FROM events
WHERE event_type = 'purchase'"""),
    "v_formats": ((), """
SELECT CAST(floor(event_id / 3000) AS INT) AS session_id, CAST(floor(event_id / 500) AS INT) AS chunk_index,
       event_id AS buffer_ord,
       CAST(CASE WHEN floor(event_id / 150) % 3 = 1 THEN 24000 ELSE 48000 END AS INT) AS sample_rate,
       1 AS channels FROM events"""),
    "v_files": ((), """
SELECT 'm' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) ||
       CASE WHEN event_type = 'view' THEN '_mic' ELSE '' END || '.wav' AS file_name,
       CAST(floor(value * 1000) AS BIGINT) + 44 AS length, ts AS modified, event_id AS file_ord FROM events"""),
    "v_eval": ((), """
SELECT CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'pt' ELSE 'es' END || '-' ||
       CAST(item_id AS VARCHAR) || '.wav' AS file_name, e.engine, b.text AS reference,
       CASE WHEN e.engine = 'fluid' THEN replace(b.text, 'the', 'teh')
            ELSE replace(b.text, ' th', ' an th') END AS hypothesis,
       CAST(1 + length(b.text) % 7 AS DOUBLE) AS wall_s, CAST(length(b.text) AS DOUBLE) AS audio_s
FROM benchmark b CROSS JOIN (VALUES ('fluid'), ('other')) e(engine)"""),
    "v_usage": ((), """
SELECT event_type AS model, event_id AS call_ord, CAST(floor(value * 100) AS BIGINT) AS input_chars,
       CAST(floor(value * 100 / (2 + event_id % 4)) AS BIGINT) AS input_tokens,
       CASE WHEN event_id % 97 = 0 THEN 'forced' WHEN event_id % 31 = 0 THEN 'seed' ELSE 'real' END AS kind
FROM events"""),
    "v_calendar": ((), """
SELECT event_id AS cal_id, ts AS starts_at, ts + INTERVAL 45 MINUTE AS ends_at, event_id % 10 = 0 AS all_day,
       event_type = 'error' AS declined FROM events"""),
}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a named oracle step that later oracles may build on."""
    if name in VIEWS:
        raise ValueError(name)
    VIEWS[name] = (needs, sql)


def with_views(*names: str, body: str) -> str:
    """``body`` preceded by the named views and everything they need, as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in VIEWS[name][0]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{body.strip()}" if order else body.strip()
