"""Per-chunk, per-meeting and per-session rollups. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params

STREAM = ["meeting_id", "chunk_index", "source"]


def channel_speakers(speakers: DataFrame) -> DataFrame:
    """Diarized speakers per channel of a chunk; input has one row per speaker."""
    return speakers.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n_speakers"))


def provenance(events: DataFrame, keys: list[str]) -> DataFrame:
    kind, severity = F.col("kind"), F.col("severity")
    return events.groupBy(*keys).agg(
        F.count_if(kind == "restartInPlace").alias("route_changes"), F.count_if(kind == "retry").alias("retries"),
        F.bool_or(kind == "launchRecovery").alias("recovered"),
        F.count_if(severity == "anomaly").alias("anomaly_count"),
        F.count_if(kind.isin(*params.QUALITY_KINDS)).alias("quality_anomaly_count"),
        F.bool_or(kind == "systemAudioUnrecovered").alias("system_audio_unrecovered"))


def participants(rows: DataFrame, order: list[str]) -> DataFrame:
    """Speakers of a meeting with their first appearance."""
    named = rows.where(F.col("speaker") != "")
    return named.groupBy("meeting_id", "speaker").agg(F.min(F.struct(*order)).alias("f")).select(
        "meeting_id", "speaker", "f.*")


def meeting_length(rows: DataFrame, order: list[str], end: str) -> DataFrame:
    """End of the last row in order, which need not be the largest end."""
    return rows.groupBy("meeting_id").agg(F.max_by(end, F.struct(*order)).alias("duration_s"))


def language_verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One language, ``multilingual``, or ``auto`` when none is known."""
    lo, hi = F.min("language"), F.max("language")
    return rows.groupBy(*keys).agg(F.when(lo.isNull(), "auto").when(lo == hi, lo).otherwise("multilingual").alias("language"))


def session_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("chunks"), F.bool_or("is_dual_stream").alias("dual_stream"))


def speech_ratio(speech: DataFrame, keys: list[str]) -> DataFrame:
    return speech.groupBy(*keys).agg(
        F.avg((F.col("probability") >= params.SPEECH_PROBABILITY).cast("int")).alias("speech_ratio"))


def level(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Root mean square per frame and its place between -50 dB and 0 dB."""
    rms = samples.groupBy(*keys).agg(F.sqrt(F.avg(value * value)).alias("rms"))
    db = 20 * F.log10("rms")
    place = F.least(F.greatest((db + 50) / 50, F.lit(0.0)), F.lit(1.0))
    return rms.withColumn("level", F.when(F.col("rms") > 0, place).otherwise(F.lit(0.0)))


def significant_speakers(rows: DataFrame, minimum: int) -> DataFrame:
    """Speakers with enough non-blank rows; all of them where none has enough."""
    from ..functions.text import is_blank
    counts = rows.where(~is_blank(F.col("text"))).groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("n_rows"))
    any_ok = counts.groupBy("meeting_id").agg(F.bool_or(F.col("n_rows") >= minimum).alias("any_ok"))
    return counts.join(any_ok, "meeting_id").where((F.col("n_rows") >= minimum) | ~F.col("any_ok")).drop("any_ok")


def telemetry_summary(samples: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    v = F.col(metric)
    return samples.groupBy(*keys).agg(F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
