"""One speaker identity across the chunks of a meeting.

Chunk k's matches depend on the reference voices left behind by chunks 0..k-1, so a meeting's channel is a fold
over its chunks. Only the speaker tables (a handful of vectors per chunk) pass through it, never segments, and
they stream: memory holds the reference voices of one channel.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from ..functions import vectors as vc
from .ordered import Fold, sorted_fold

CHANNEL = ["meeting_id", "namespace"]


class ReferenceVoices(Fold):
    """Greedy one-to-one matching of a chunk's speakers to the voices known so far."""

    def __init__(self, threshold: float, keep: float):
        self.threshold, self.keep = threshold, keep
        self.known: dict[str, np.ndarray] = {}
        self.next_number = 0
        self.chunk: list = []

    @staticmethod
    def natural(label: str) -> tuple[str, int]:
        text = label.rstrip("0123456789")
        digits = label[len(text):]
        return text, int(digits) if digits else -1

    def push(self, row):
        out = self.close() if self.chunk and self.chunk[-1].chunk_index != row.chunk_index else []
        self.chunk.append(row)
        return out

    def finish(self):
        return self.close() if self.chunk else []

    def close(self):
        rows, self.chunk = sorted(self.chunk, key=lambda r: self.natural(r.speaker)), []
        voices = {r.speaker: np.asarray(r.embedding, dtype=np.float64) for r in rows}
        named = self.match(voices) if self.known else self.seed(voices)
        return [(r.meeting_id, r.namespace, r.chunk_index, r.speaker, named[r.speaker]) for r in rows]

    def seed(self, voices):
        for label, voice in voices.items():
            self.known[label] = voice
            self.next_number = max(self.next_number, self.natural(label)[1] + 1)
        return {label: label for label in voices}

    @staticmethod
    def similarity(a, b):
        if len(a) != len(b) or len(a) == 0:
            return 0.0
        scale = np.sqrt(a @ a) * np.sqrt(b @ b)
        return float(a @ b / scale) if scale > 0 else 0.0

    def match(self, voices):
        scored = [(-self.similarity(v, ref), self.natural(local), self.natural(known), local, known)
                  for local, v in voices.items() for known, ref in self.known.items()]
        named: dict[str, str] = {}
        taken: set[str] = set()
        for minus, _, _, local, known in sorted(s for s in scored if -s[0] >= self.threshold):
            if local not in named and known not in taken:
                named[local] = known
                taken.add(known)
                self.known[known] = self.keep * self.known[known] + (1 - self.keep) * voices[local]
        for local, voice in voices.items():
            if local not in named:
                named[local] = f"Speaker {self.next_number}"
                self.next_number += 1
                self.known[named[local]] = voice
        return named

    def snapshot(self):
        return self.next_number, {label: [float(x) for x in voice] for label, voice in self.known.items()}

    def restore(self, kept):
        self.next_number = kept[0]
        self.known = {label: np.asarray(voice, dtype=np.float64) for label, voice in kept[1].items()}


def reconcile(voices: DataFrame, threshold: float = params.RECONCILE_COSINE, keep: float = params.RECONCILE_KEEP) -> DataFrame:
    """``voices``: meeting_id, namespace, chunk_index, speaker, embedding -> ... speaker, global_speaker."""
    schema = "meeting_id bigint, namespace string, chunk_index int, speaker string, global_speaker string"
    rows = voices.select(*CHANNEL, F.col("chunk_index").cast("int").alias("chunk_index"), "speaker", "embedding")
    return sorted_fold(rows, CHANNEL, ["chunk_index", "speaker"], partial(ReferenceVoices, threshold, keep), schema)


def channel_mapping(voices: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mapping as segments carry it: meeting_id, chunk_index, source, speaker, global.

    In a meeting with any two-channel chunk the channels never mix and global labels carry their channel; the
    labels of a chunk carry it only if that chunk itself had two channels. Otherwise one plain namespace.
    """
    dual = chunks.groupBy("meeting_id").agg(F.bool_or("is_dual_stream").alias("dual"))
    known = voices.join(dual, "meeting_id").where("dual OR source <> 'local'")
    side = F.when(F.col("source") == "local", "Local ").otherwise("Remote ")
    spaced = known.withColumn("namespace", F.when(F.col("dual"), side).otherwise(""))
    mapped = reconcile(spaced).join(chunks.select("meeting_id", "chunk_index", "is_dual_stream"), ["meeting_id", "chunk_index"])
    tagged = (F.col("namespace") == "Local ") | F.col("is_dual_stream")
    return mapped.select("meeting_id", "chunk_index",
                         F.when(F.col("namespace") == "Local ", "local").otherwise("remote").alias("source"),
                         F.concat(F.when(tagged, F.col("namespace")).otherwise(""), "speaker").alias("speaker"),
                         F.concat("namespace", "global_speaker").alias("global"))


def reconcile_segments(voices: DataFrame) -> DataFrame:
    """Recovery form over per-segment voice tables: keys are ``<segment>:<label>``."""
    keyed = reconcile(voices.withColumn("namespace", F.col("source")))
    return keyed.select("meeting_id", "namespace", F.concat_ws(":", F.col("chunk_index").cast("string"), "speaker").alias("segment_label"), "global_speaker")


def candidates(chunk_voices: DataFrame, references: DataFrame, keys: list[str], threshold: float = params.RECONCILE_COSINE) -> DataFrame:
    """Similarity report of chunk speakers against given reference voices."""
    a = chunk_voices.withColumn("n", vc.norm(F.col("embedding")))
    b = references.select(*keys, F.col("speaker").alias("reference"), F.col("embedding").alias("re"), vc.norm(F.col("embedding")).alias("rn"))
    sim: Column = F.when(F.size("embedding") == F.size("re"), vc.cosine_from(
        vc.dot(F.col("embedding"), F.col("re")), F.col("n"), F.col("rn"))).otherwise(F.lit(0.0))
    return a.join(b, keys).withColumn("similarity", sim).where(F.col("similarity") >= threshold).drop("embedding", "re", "n", "rn")
