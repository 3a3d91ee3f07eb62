"""One-shot and recovered recordings: speakers are reconciled first, echoes are removed over the whole meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import echo, labeling, merge, reconcile
from ..session import written

SEGMENT = ["meeting_id", "chunk_index", "source"]


def transcript(labeled: DataFrame, voices: DataFrame, offsets: DataFrame, ident: list[str],
               dim: int | None = None, limits: echo.Thresholds = echo.Thresholds()) -> DataFrame:
    """Unknown rows are resolved where a channel has one voice over the whole recording. ``labeled`` carries per-segment labels; ``offsets(meeting_id, chunk_index, offset_s)`` places the segments."""
    mapped = reconcile.reconcile(voices.withColumn("namespace", F.col("source")))
    mapping = mapped.select("meeting_id", "chunk_index", F.col("namespace").alias("source"), "speaker",
                            F.col("global_speaker").alias("global"))
    mapping = written(mapping, "identities")  # the fold runs once, the mapping is needed twice
    rows = merge.remap(labeled, mapping, SEGMENT).join(offsets, ["meeting_id", "chunk_index"])
    placed = rows.withColumn("start_s", F.col("start_s") + F.col("offset_s")).withColumn(
        "end_s", F.col("end_s") + F.col("offset_s")).drop("offset_s")
    everyone = merge.global_voices(voices, mapping).withColumnRenamed("global", "speaker")
    channel = ["meeting_id", "source"]
    counts = everyone.groupBy(*channel).agg(F.count(F.lit(1)).alias("n_speakers"))
    tagged = written(labeling.tag_source(labeling.resolve_unknowns(placed, counts, ["start_s", *ident], channel)), "labeled")
    return echo.remove_echo(tagged, everyone, ["meeting_id"], ident, limits, dim)
