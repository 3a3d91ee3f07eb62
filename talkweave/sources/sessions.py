"""Session files: one JSON object per session, or one line per part of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SESSION


def read_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, quarantined). Later-added fields get their defaults; unreadable sessions are set aside whole."""
    reader = spark.read.schema(SESSION).option("multiLine", multi_line).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record")
    raw = reader.json(path).select("*", F.col("_metadata.file_path").alias("file"))
    whole = F.col("_corrupt_record").isNull() & F.col("sessionId").isNotNull() & F.col("meetingStart").isNotNull() & F.col("chunks").isNotNull()
    rows = raw.where(whole).select(F.col("sessionId").alias("session_id"), F.col("meetingStart").alias("meeting_start"), "engine",
                                   F.explode_outer("chunks").alias("c"))
    infer = F.exists("c.segments", lambda s: s["source"] == "local")
    chunks = rows.select(
        "session_id", "meeting_start", "engine", F.col("c.index").alias("chunk_index"), F.col("c.startTime").alias("start_time"),
        F.col("c.audioPath").alias("audio_path"), F.col("c.segments").alias("segments"), F.col("c.speakerDatabase").alias("speaker_database"),
        F.coalesce("c.localSpeakerDatabase", F.create_map().cast("map<string,array<float>>")).alias("local_speaker_database"),
        F.coalesce("c.echo_segments_removed", F.lit(0)).alias("echo_segments_removed"),
        F.coalesce("c.is_dual_stream", infer).alias("is_dual_stream"))
    return chunks.where("chunk_index IS NOT NULL"), raw.where(~whole).select("file", "_corrupt_record")


def chunk_segments(chunks: DataFrame) -> DataFrame:
    """Segments of stored chunks, in stored order."""
    return chunks.select("session_id", "chunk_index", "is_dual_stream", F.posexplode("segments").alias("seg_ord", "s")).select(
        "session_id", "chunk_index", "is_dual_stream", "seg_ord", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"),
        "s.text", "s.speaker", "s.source", F.col("s.qualityScore").alias("quality_score"))


def chunk_voices(chunks: DataFrame) -> DataFrame:
    """Both speaker tables of stored chunks as rows."""
    both = F.create_map(F.lit("remote"), F.col("speaker_database"), F.lit("local"), F.col("local_speaker_database"))
    return (chunks.select("session_id", "chunk_index", F.explode(both).alias("source", "db"))
            .select("session_id", "chunk_index", "source", F.explode("db").alias("speaker", "embedding")))


def write_chunks(chunks: DataFrame, path: str, version: int) -> None:
    """Store chunks under a new version. Writing a version again replaces it, so a retried job is harmless.

    Chunks are not folders: millions of meetings would mean millions of tiny files. A chunk written again is
    superseded when read.
    """
    chunks.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk in its newest version."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("session_id", "chunk_index").agg(F.max("version").alias("version"))
    return rows.join(newest, ["session_id", "chunk_index", "version"], "left_semi").drop("version")
