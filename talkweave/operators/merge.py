"""From chunk rows to one transcript per meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_unknown
from .ordered import blocks_of, numbered

CHUNK = ["meeting_id", "chunk_index"]
CHUNK_ROW = ["meeting_id", "chunk_index", "source", "seg_ord", "start_s", "end_s", "speaker", "text"]


def chunk_rows(labeled: DataFrame) -> DataFrame:
    """Labelled rows as a chunk stores them: confidence becomes the quality score, language is not kept."""
    keep = [c for c in (*CHUNK_ROW, "piece") if c in labeled.columns]
    return labeled.select(*keep, F.col("confidence").alias("quality_score"))


def chunk_places(rows: DataFrame) -> DataFrame:
    """Position by start time within the chunk."""
    return numbered(rows, CHUNK, ["start_s", "seg_ord"], "place", blocks_of(F.col("start_s"), 3600))


def remap(rows: DataFrame, mapping: DataFrame, keys: list[str], label: str = "speaker") -> DataFrame:
    """Replace the label where ``mapping(keys, speaker, global)`` knows it."""
    m = mapping.select(*keys, F.col("speaker").alias(label), F.col("global").alias("__g"))
    return rows.join(m, [*keys, label], "left").withColumn(label, F.coalesce("__g", label)).select(*rows.columns)


def unmapped_labels(rows: DataFrame, mapping: DataFrame, keys: list[str] = CHUNK) -> DataFrame:
    """Labels a chunk's mapping misses. Chunks without any mapping, and Unknown, are no miss."""
    labels = rows.where(~is_unknown(F.col("speaker"))).select(*keys, "speaker").distinct()
    mapped_chunks = mapping.select(*keys).distinct()
    return labels.join(mapped_chunks, keys, "left_semi").join(mapping, [*keys, "speaker"], "left_anti")


def shifted(rows: DataFrame, chunk_start: Column, meeting_start: Column) -> DataFrame:
    """Chunk-relative seconds to meeting-relative seconds and wall-clock time."""
    offset = (F.unix_micros(chunk_start) - F.unix_micros(meeting_start)) / F.lit(1e6)
    elapsed = offset + F.col("start_s")
    stamp = F.timestamp_micros(F.unix_micros(meeting_start) + F.round(elapsed * 1000000).cast("bigint"))
    return (rows.withColumn("elapsed", elapsed).withColumn("elapsed_end", offset + F.col("end_s"))
            .withColumn("timestamp", stamp))


def merge(rows: DataFrame, mapping: DataFrame, chunk_start: Column, meeting_start: Column) -> DataFrame:
    return shifted(remap(rows, mapping, CHUNK), chunk_start, meeting_start)


def in_order(transcript: DataFrame) -> DataFrame:
    """Transcript order through a range shuffle, so a long meeting spreads over several sorted partitions."""
    return transcript.orderBy("meeting_id", "elapsed", "source", "seg_ord")


def places(transcript: DataFrame, order: list[str] | None = None) -> DataFrame:
    """1-based position of each row within its meeting."""
    return numbered(transcript, ["meeting_id"], order or ["elapsed", "source", "seg_ord"], "place",
                    blocks_of(F.col("elapsed"), 3600))


def global_voices(voices: DataFrame, mapping: DataFrame) -> DataFrame:
    """One embedding per global label: the one from its earliest chunk."""
    keys = ["meeting_id", "chunk_index", "source"]
    named = voices.join(mapping.select(*keys, "speaker", "global"), [*keys, "speaker"])
    return named.groupBy("meeting_id", "source", "global").agg(
        F.min_by("embedding", F.struct("chunk_index", "speaker")).alias("embedding"))


def merge_maps(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two keyed maps; an existing entry wins."""
    both = existing.withColumn("__p", F.lit(0)).unionByName(incoming.withColumn("__p", F.lit(1)))
    values = [c for c in existing.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*values), "__p").alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in values])
