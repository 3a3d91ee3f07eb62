"""Files on disk against sessions: discovery, orphans, offsets, location, quota, header audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from ..functions import naming
from .intervals import overlap_pairs
from .ordered import Scan, block_scan, blocks_of, numbered


def chunk_files(files: DataFrame) -> DataFrame:
    """Recording files with session_id, idx and is_mic; other names are left out."""
    parsed = files.select("*", naming.session_of(F.col("file_name")).alias("session_id"),
                          naming.index_of(F.col("file_name")).alias("idx"), naming.is_mic(F.col("file_name")).alias("is_mic"))
    return parsed.where("session_id IS NOT NULL AND idx IS NOT NULL")


def chunk_inventory(files: DataFrame) -> DataFrame:
    """One row per session and index on disk: earliest system file time, and whether a mic file lies beside it."""
    return chunk_files(files).groupBy("session_id", "idx").agg(
        F.bool_or(~F.col("is_mic")).alias("has_system"), F.bool_or("is_mic").alias("has_mic"),
        F.min(F.when(~F.col("is_mic"), F.col("modified"))).alias("created"))


def discovered(files: DataFrame, bases: DataFrame) -> DataFrame:
    """Segments to stitch per ``bases(session_id, zero_indexed)``, in order, whatever the gaps.

    Numbering from zero takes every index; the older one takes the bare file and then indices from 2 on. A session
    without any numbered file keeps its original pair (index null).
    """
    found = chunk_inventory(files).where("has_system").select("session_id", "idx")
    numbered_ones = bases.join(found, "session_id", "left").where("idx IS NULL OR zero_indexed OR idx >= 2")
    bare = bases.where(~F.col("zero_indexed")).withColumn("idx", F.lit(None).cast("int"))
    rows = numbered_ones.where("zero_indexed OR idx IS NOT NULL").unionByName(bare)
    name = F.when(F.col("idx").isNull(), F.concat("session_id", F.when(F.col("zero_indexed"), "-0").otherwise(""))).otherwise(
        F.concat("session_id", F.lit("-"), F.col("idx").cast("string")))
    return rows.select("session_id", "idx", F.concat(name, F.lit(".wav")).alias("system_file"), F.concat(name, F.lit("_mic.wav")).alias("mic_file"))


def gap_ranges(present: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Missing indices between the smallest and the largest as ranges: first_missing, last_missing. A far-off index makes one
    long range, not a row for each number."""
    one = present.select(*keys, F.col(idx).cast("bigint").alias("i")).distinct()
    ahead = block_scan(one, keys, ["i"], [Scan("next_i", "min", F.col("i"), inclusive=False, reverse=True)], blocks_of(F.col("i"), 65536))
    return ahead.where(F.col("next_i") > F.col("i") + 1).select(
        *keys, (F.col("i") + 1).alias("first_missing"), (F.col("next_i") - 1).alias("last_missing"))


def index_gaps(present: DataFrame, keys: list[str], idx: str = "idx", step: int = 65536) -> DataFrame:
    """The missing indices one by one. A range is listed in pieces of ``step``, so no row ever holds more of them."""
    pieces = gap_ranges(present, keys, idx).select(
        *keys, "last_missing", F.explode(F.sequence("first_missing", "last_missing", F.lit(step).cast("bigint"))).alias("from"))
    until = F.least(F.col("last_missing"), F.col("from") + (step - 1))
    return pieces.select(*keys, F.explode(F.sequence(F.col("from"), until)).alias("missing"))


def paired(files: DataFrame) -> DataFrame:
    """System chunks with or without their microphone file."""
    inv = chunk_inventory(files).where("has_system")
    name = F.concat("session_id", F.lit("-"), F.col("idx").cast("string"))
    return inv.select("session_id", "idx", F.when(F.col("has_mic"), F.concat(name, F.lit("_mic.wav"))).alias("mic_file"),
                      F.col("has_mic").alias("is_dual_stream"))


def orphans(on_disk: DataFrame, completed: DataFrame) -> DataFrame:
    return on_disk.join(completed, ["session_id", "idx"], "left_anti")


def recoverable(sessions: DataFrame, completed: DataFrame, orphaned: DataFrame) -> DataFrame:
    """Sessions with a finished or an orphaned chunk."""
    keys = completed.select("session_id").unionByName(orphaned.select("session_id"))
    return sessions.join(keys, "session_id", "left_semi")


def next_free_index(sessions: DataFrame, completed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Largest index seen anywhere plus one, 0 for a session without any; never below the sentinel's plus one."""
    used = completed.select("session_id", "idx").unionByName(on_disk.select("session_id", "idx"))
    top = used.groupBy("session_id").agg(F.max("idx").alias("top"))
    free = F.coalesce(F.col("top") + 1, F.lit(0))
    return sessions.join(top, "session_id", "left").select(
        "session_id", free.alias("next_free"), F.greatest(free, F.col("sentinel_index") + 1).alias("safe_restart"))


def meeting_starts(sessions: DataFrame, orphaned: DataFrame, now: Column) -> DataFrame:
    """Recorded start, else the earliest orphan's time, else ``now``."""
    first = orphaned.groupBy("session_id").agg(F.min("created").alias("first_created"))
    return sessions.join(first, "session_id", "left").withColumn(
        "meeting_start", F.coalesce("meeting_start", "first_created", now)).drop("first_created")


def recovery_names(session_base: Column, index: Column) -> Column:
    """The interrupted chunk keeps its index, recording goes on at the next."""
    name = lambda i: F.concat(session_base, F.lit("-"), i.cast("string"))
    return F.struct(index.alias("orphan_index"), (index + 1).alias("recovery_index"), name(index).alias("orphan_name"),
                    name(index + 1).alias("recovery_name"))


def segment_durations(duration: Column, transcript_end: Column, chunk_s: float = params.CHUNK_MINUTES * 60.0) -> Column:
    return F.coalesce(duration, transcript_end, F.lit(float(chunk_s)))


def start_offsets(chunks: DataFrame, key: list[str], idx: str, duration: str) -> DataFrame:
    """Where each chunk begins: the lengths of all chunks before it. Also whether all lengths so far are known."""
    usable = F.coalesce(F.col(duration) > 0, F.lit(False))
    scans = [Scan("offset_s", "sum", F.coalesce(F.col(duration), F.lit(0.0)), inclusive=False),
             Scan("__bad", "max", (~usable).cast("int"))]
    out = block_scan(chunks, key, [idx], scans, blocks_of(F.col(idx), 4096))
    return out.withColumn("offset_s", F.col("offset_s").cast("double")).withColumn("anchored", F.col("__bad") == 0).drop("__bad")


def located(samples: DataFrame, chunks: DataFrame, ident: list[str], max_s: float | None = params.SAMPLE_MAX_S) -> DataFrame:
    """Chunk and chunk-relative range of each (meeting, start_s, end_s); unlocatable samples are absent.

    ``chunks`` comes from :func:`start_offsets`: chunks after one of unknown length anchor nothing.
    """
    anchored = chunks.where("anchored").select("meeting_id", "chunk_index", "offset_s", (F.col("offset_s") + F.col("duration_s")).alias("until_s"))
    asked = samples.where("start_s >= 0 AND end_s > start_s").withColumn("__at", F.col("start_s"))
    pairs = overlap_pairs(asked, anchored, ["meeting_id"], "start_s", "__at", "offset_s", "until_s", touching=True, width=1800.0)
    hit = pairs.where("offset_s <= start_s AND start_s < until_s")
    lo = F.col("start_s") - F.col("offset_s")
    hi = F.least(F.col("end_s") - F.col("offset_s"), F.col("until_s") - F.col("offset_s"))
    hi = hi if max_s is None else F.least(hi, lo + max_s)
    out = hit.select("meeting_id", *ident, "chunk_index", lo.alias("local_start"), hi.alias("local_end"))
    return out.where("local_end > local_start")


def playable(found: DataFrame, files: DataFrame, source: str = "source") -> DataFrame:
    """Located samples whose file exists; a raw wav chunk has no microphone channel to play."""
    there = found.join(files, ["meeting_id", "chunk_index"])
    return there.where((F.col(source) != "local") | F.lower("path").endswith(".m4a"))


def quota_bytes(hours: Column, kbps: Column) -> Column:
    return (F.floor(hours * kbps * 1000 / 8) * 3600).cast("bigint")


def usage_bytes(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.sum("length").cast("bigint").alias("bytes"))


def evictions(files: DataFrame, keys: list[str], quota: Column, order: list[str]) -> DataFrame:
    """Which files to delete, oldest first, until the rest fits; protected files are passed over."""
    total = files.groupBy(*keys).agg(F.sum("length").alias("__total"))
    open_ones = files.where("NOT protected")
    run = block_scan(open_ones, keys, order, [Scan("__before", "sum", F.col("length"), inclusive=False)],
                     blocks_of(F.unix_seconds(order[0]), 86400 * 7))
    return run.join(total, keys).where(F.col("__total") - F.col("__before") > quota).drop("__before", "__total")


def little_endian(content: Column, at: int, size: int) -> Column:
    """Unsigned number of ``size`` bytes at byte offset ``at``."""
    h = F.hex(F.substring(content, at + 1, size))
    flipped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(h) == 2 * size, F.conv(flipped, 16, 10).cast("bigint"))


def wav_audit(files: DataFrame) -> DataFrame:
    """Declared against real payload from the first bytes of each file (``content``, ``length``); nothing is rewritten."""
    head = F.col("content")
    ok = (F.substring(head, 1, 4) == F.lit(b"RIFF")) & (F.substring(head, 9, 4) == F.lit(b"WAVE")) & (F.col("length") >= params.WAV_HEADER_BYTES)
    byte_rate, declared = little_endian(head, 28, 4), little_endian(head, 40, 4)
    real = F.col("length") - params.WAV_HEADER_BYTES
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, ok.alias("is_wav"), F.when(ok, declared).alias("declared_bytes"), F.when(ok, real).alias("real_bytes"),
                        F.coalesce(ok & (real > declared), F.lit(False)).alias("needs_repair"),
                        F.when(ok & (byte_rate > 0) & (real > 0), real / byte_rate).alias("duration_s"))


def with_audio(chunks: DataFrame) -> DataFrame:
    """Chunks with anything beyond the header, or with a microphone file."""
    return chunks.where((F.col("length") > params.WAV_HEADER_BYTES) | F.col("mic_file").isNotNull())


def verified_archives(archives: DataFrame, sources: DataFrame, keys: list[str], tolerance: float = params.ARCHIVE_TOLERANCE_S) -> DataFrame:
    """Archives that may replace their source; otherwise the source path stays."""
    both = sources.join(archives, keys, "left")
    good = (F.col("archive_bytes") > 0) & F.col("has_track") & (F.abs(F.col("archive_s") - F.col("source_s")) <= tolerance)
    good = F.coalesce(good, F.lit(False))
    return both.select(*keys, good.alias("verified"), F.when(good, F.col("archive_path")).otherwise(F.col("source_path")).alias("path"))


def ordered_inventory(files: DataFrame, keys: list[str]) -> DataFrame:
    return numbered(files, keys, ["idx"], "place", blocks_of(F.col("idx"), 65536))
