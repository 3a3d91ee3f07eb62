"""Chunked sessions: label each chunk, drop echoes, reconcile speakers, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import echo, labeling, merge, reconcile
from ..operators.aggregates import channel_speakers
from ..session import written

CHUNK = ["meeting_id", "chunk_index"]


def unite(system: DataFrame, mic: DataFrame) -> DataFrame:
    return system.unionByName(mic)


def processed_chunks(segments: DataFrame, words: DataFrame, turns: DataFrame, speech: DataFrame, voices: DataFrame,
                     chunks: DataFrame, limits: echo.Thresholds = echo.Thresholds()) -> DataFrame:
    """Labelled rows of both channels without echoes, as a chunk stores them.

    ``chunks(meeting_id, chunk_index, is_dual_stream)``: only a chunk with two channels has its labels prefixed, its unknown
    speakers resolved and its echoes removed. A chunk that is not listed counts as one channel.
    """
    clean = labeling.drop_empty_and_repeats(segments)
    # Three later steps read the labelled rows: they are stored once, as a chunk is stored when it is done.
    labeled = written(labeling.label_streams(clean, words, turns, speech), "labeled")
    two = chunks.where("is_dual_stream").select(*CHUNK).distinct()
    both, single = labeled.join(two, CHUNK, "left_semi"), labeled.join(two, CHUNK, "left_anti")
    counts = channel_speakers(labeling.speaker_names(turns))
    tagged = labeling.tag_source(labeling.resolve_unknowns(both, counts, ["start_s", "seg_ord", "piece"]))
    heard = echo.remove_echo(tagged, voices, CHUNK, ["seg_ord", "piece"], limits)
    return heard.unionByName(single.select(heard.columns))


def finalize(rows: DataFrame, voices: DataFrame, chunks: DataFrame, chunk_start: Column, meeting_start: Column) -> DataFrame:
    """Merged transcript rows under global speaker names."""
    mapping = reconcile.channel_mapping(voices, chunks)
    return merge.merge(rows, mapping.select(*CHUNK, "speaker", "global"), chunk_start, meeting_start)
