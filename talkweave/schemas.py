"""Explicit schemas of every file the engine reads. Nothing is inferred."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)


def struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


D, S, B, I, L = DoubleType(), StringType(), BooleanType(), IntegerType(), LongType()
VOICES = MapType(S, ArrayType(FloatType()))

CHUNK_SEGMENT = struct(start=D, end=D, text=S, speaker=S, source=S, qualityScore=FloatType())
STORED_CHUNK = struct(index=I, startTime=TimestampType(), audioPath=S, segments=ArrayType(CHUNK_SEGMENT), speakerDatabase=VOICES,
                      localSpeakerDatabase=VOICES, echo_segments_removed=I, is_dual_stream=B)
SESSION = struct(sessionId=S, meetingStart=TimestampType(), engine=S, chunkDurationMinutes=I, chunks=ArrayType(STORED_CHUNK),
                 _corrupt_record=S)

EVENT = struct(timestamp=TimestampType(), origin=S, kind=S, severity=S, detail=MapType(S, S), _corrupt_record=S)

DOC_SEGMENT = struct(start=D, end=D, speaker=S, text=S, source=S, confidence=D, language=S)
DOC_METADATA = struct(audio_files=ArrayType(S), audio_paths=ArrayType(S), output_format=S, language=S, num_speakers=S, diarization=B,
                      dual_stream=B, software_version=S, recorded_at=S, echo_segments_removed=I,
                      capture_provenance=struct(engine=S, route_changes=L, retries=L, recovered=B, anomaly_count=L, quality_anomaly_count=L,
                                                system_audio_unrecovered=B, system_format=S, mic_format=S, mic_device=S),
                      disclosure=struct(summary_generated=B, summary_endpoint=S, transcript_transmitted=B), speaker_names=MapType(S, S))
DOCUMENT = struct(metadata=DOC_METADATA, segments=ArrayType(DOC_SEGMENT), _corrupt_record=S)

DIARIZER = struct(segments=ArrayType(struct(start=D, end=D, speaker=S)), speakers=MapType(S, I))
MANIFEST = struct(repo=S, commit_sha=S, last_modified=S, downloaded_at=TimestampType(), sdk_label=S,
                  files=ArrayType(struct(relativePath=S, size=L, sha256=S)))
TELEMETRY = {"system": ("elapsed_s", "cpu_power_mw", "gpu_power_mw", "ane_power_mw"),
             "process": ("elapsed_s", "pid", "cpu_pct", "mem_mb", "vsize_mb"),
             "iostat": ("elapsed_s", "kb_per_transfer", "transfers_per_sec", "mb_per_sec")}
