"""Transcript documents, exports, prompts and renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions import timing as tm, usage
from ..functions.text import trim_blank
from .intervals import overlap_pairs
from .ordered import numbered

def joined_text(rows: DataFrame, keys: list[str], order: list[str], sep: str = " ") -> DataFrame:
    """Texts of a key joined in order; for keys bounded by nature, such as one channel of one chunk."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), sep).alias("text"))

def document_lines(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """One JSON document per meeting, as lines: meeting_id, place, value.

    ``rows`` needs start, end, speaker, text, source, confidence, language and place (1, 2, ...); ``metadata`` one struct per
    meeting. The lines of a meeting, in order, are its document, however long it is: a head, a line per segment, an end. A meeting
    without rows has a document without segments.
    Missing optional fields are absent from the JSON.
    """
    optional = F.when(F.col("source") != "", F.col("source"))
    segment = F.to_json(F.struct("start", "end", "speaker", "text", optional.alias("source"), "confidence", "language"))
    body = rows.select("meeting_id", F.col("place").cast("bigint").alias("place"), F.concat(F.when(F.col("place") == 1, "").otherwise(","), segment).alias("value"))
    ends = (rows.groupBy("meeting_id").agg(F.max("place").cast("bigint").alias("last")).join(metadata.select("meeting_id", "metadata"), "meeting_id", "full")
            .withColumn("last", F.coalesce("last", F.lit(0).cast("bigint"))))
    head = F.concat(F.lit('{"metadata":'), F.coalesce(F.to_json("metadata"), F.lit("{}")), F.lit(',"segments":['))
    frame = F.array(F.struct(F.lit(0).cast("bigint").alias("place"), head.alias("value")), F.struct((F.col("last") + 1).alias("place"), F.lit("]}").alias("value")))
    return body.unionByName(ends.select("meeting_id", F.inline(frame)))

def cue_lines(rows: DataFrame) -> DataFrame:
    """SRT: one cue per row, numbered by ``place``."""
    who = F.when(F.col("speaker") == "", "").otherwise(F.concat("speaker", F.lit(": ")))
    cue = F.concat(F.col("place").cast("string"), F.lit("\n"), tm.srt_clock(F.col("start")), F.lit(" --> "),
                   tm.srt_clock(F.col("end")), F.lit("\n"), who, "text", F.lit("\n"))
    return rows.select("meeting_id", "place", cue.alias("value"))

def text_lines(rows: DataFrame) -> DataFrame:
    """TXT: ``[HH:MM:SS] speaker: text``."""
    who = F.when(F.col("speaker") == "", "").otherwise(F.concat("speaker", F.lit(": ")))
    return rows.select("meeting_id", "place", F.concat(F.lit("["), tm.clock(F.col("start")), F.lit("] "), who, "text").alias("value"))

def export_lines(rows: DataFrame, formats: DataFrame) -> DataFrame:
    """Lines for the meetings whose document asks for srt or txt; json and unknown formats give nothing."""
    wanted = rows.join(formats, "meeting_id")
    srt = cue_lines(wanted.where("output_format = 'srt'")).withColumn("format", F.lit("srt"))
    txt = text_lines(wanted.where("output_format = 'txt'")).withColumn("format", F.lit("txt"))
    return srt.unionByName(txt)

def clean_flags(rows: DataFrame, ident: list[str], tolerance: float = params.SAMPLE_TOLERANCE_S) -> DataFrame:
    """Adds ``clean``: no other speaker of the meeting talks over the row for longer than ``tolerance``.

    Any one partner is enough to spoil a row, so pairs are reduced to distinct row identities at once.
    """
    real = rows.where("end_s > start_s")
    a = real.select("meeting_id", *ident, "speaker", "start_s", "end_s")
    b = real.select("meeting_id", F.col("speaker").alias("o_speaker"), F.col("start_s").alias("o0"), F.col("end_s").alias("o1"))
    pairs = overlap_pairs(a, b, ["meeting_id"], "start_s", "end_s", "o0", "o1").where(
        (F.col("speaker") != F.col("o_speaker")) & (F.least("end_s", "o1") - F.greatest("start_s", "o0") > tolerance))
    spoiled = pairs.select("meeting_id", *ident).distinct().withColumn("clean", F.lit(False))
    return real.join(spoiled, ["meeting_id", *ident], "left").withColumn("clean", F.coalesce("clean", F.lit(True)))

def ranked_samples(flagged: DataFrame, ident: list[str], k: int | None = None) -> DataFrame:
    """Clean rows first, then the longest.

    ``k`` keeps the best per speaker; Spark cuts each task's rows to ``k`` per speaker before the shuffle. Without it
    all rows are ranked in blocks of similar length, so one talkative speaker is no single task.
    """
    length = F.col("end_s") - F.col("start_s")
    if k is not None:
        w = Window.partitionBy("meeting_id", "speaker").orderBy(F.col("clean").desc(), length.desc(), *ident)
        return flagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    keyed = flagged.withColumn("__spoiled", (~F.col("clean")).cast("bigint")).withColumn("__short", -length)
    block = F.col("__spoiled") * 1_000_000_000 + F.floor(F.col("__short") * 10)
    ranked = numbered(keyed, ["meeting_id", "speaker"], ["__spoiled", "__short", *ident], "rank", block)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("__spoiled", "__short")


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Apply ``names(meeting_id, speaker, new_name)``."""
    return rows.join(names, ["meeting_id", "speaker"], "left").withColumn(
        "speaker", F.coalesce("new_name", "speaker")).drop("new_name")

def recorded_names(existing: Column, incoming: Column) -> Column:
    """The document's name map after a rename: later entries win, names mapped to themselves are not recorded."""
    changed = F.map_filter(incoming, lambda k, v: k != v)
    kept = F.map_filter(existing, lambda k, v: ~F.map_contains_key(changed, k))
    return F.map_concat(kept, changed)

def message_head(name: Column, date_text: Column, duration_s: Column, speakers: Column) -> Column:
    """The lines of a prompt above its transcript, as an array."""
    return F.array(F.concat(F.lit("Meeting: "), name), F.concat(F.lit("Date: "), date_text), F.concat(F.lit("Duration: "), tm.short_duration(duration_s)),
                   F.concat(F.lit("Participants: "), speakers), F.lit(""), F.lit("--- TRANSCRIPT ---"))

def prompt_lines(rows: DataFrame, heads: DataFrame, dual: Column) -> DataFrame:
    """A meeting's prompt as lines: meeting_id, place, value. The head's lines end at place 0, a segment's is its place.

    ``heads`` has meeting_id and head (``message_head``). No prompt is gathered, however long its meeting is.
    """
    top = heads.select("meeting_id", F.size("head").alias("n"), F.posexplode("head").alias("pos", "value"))
    line = usage.prompt_line(F.col("start"), F.col("speaker"), F.col("source"), F.col("text"), dual)
    return top.select("meeting_id", (F.col("pos") - F.col("n") + 1).cast("bigint").alias("place"), "value").unionByName(
        rows.select("meeting_id", F.col("place").cast("bigint").alias("place"), line.alias("value")))

def recording_date(recorded_at: Column, file_date: Column, now: Column) -> Column:
    return F.coalesce(tm.parse_iso8601(recorded_at), file_date, now)

def quality_notice(file_name: Column, anomalies: Column) -> Column:
    """Struct(title, body); an absent count is zero."""
    n = F.coalesce(anomalies, F.lit(0)).cast("bigint")
    noun = F.when(n == 1, "anomaly").otherwise("anomalies")
    title = F.when(n > 0, "Transcription Complete — capture anomalies").otherwise("Transcription Complete")
    body = F.when(n > 0, F.concat(file_name, F.lit(" — "), n.cast("string"), F.lit(" capture "), noun,
                                  F.lit(" recorded; audio may be affected"))).otherwise(file_name)
    return F.struct(title.alias("title"), body.alias("body"))

def audio_layout(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``paths(keys, pos, path)`` -> layout per document: chunks, dual, single or unavailable. No list is built."""
    lower = F.lower("path")
    mic = F.col("path").rlike(r"(^|/)[^/]*_mic\.wav$")
    seen = paths.groupBy(*keys).agg(F.count("path").alias("n"), F.bool_or(lower.endswith(".m4a")).alias("archive"),
                                    F.bool_or(mic & (F.col("pos") == 1)).alias("second_mic"),
                                    F.bool_or(mic & (F.col("pos") == 0)).alias("first_mic"))
    layout = (F.when(F.col("n") == 0, "unavailable").when(F.col("archive"), "chunks")
              .when((F.col("n") == 2) & F.coalesce("second_mic", F.lit(False)), "dual")
              .when((F.col("n") == 1) & ~F.col("first_mic"), "single").otherwise("chunks"))
    return seen.select(*keys, layout.alias("layout"))

def trimmed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", trim_blank(F.col("text")))


def document_metadata(meetings: DataFrame) -> DataFrame:
    """(meeting_id, metadata): what a document says about its recording. Null fields are absent from the JSON.

    ``meetings``: meeting_id, audio_paths, output_format, language, num_speakers (null: ``"auto"``, else a number),
    diarization, dual_stream, software_version, recorded_at (timestamp), echo_segments_removed and provenance (a struct, or
    null without diagnostics). A count of removed echoes is given only where there are any. A transcript has not left
    the machine when it is put together, and says so.
    """
    names = F.transform("audio_paths", lambda p: F.element_at(F.split(p, "/"), -1))
    speakers = F.parse_json(F.coalesce(F.col("num_speakers").cast("string"), F.lit('"auto"')))
    undisclosed = F.struct(F.lit(False).alias("summary_generated"), F.lit(False).alias("transcript_transmitted"))
    return meetings.select("meeting_id", F.struct(
        names.alias("audio_files"), "audio_paths", "output_format", "language", speakers.alias("num_speakers"), "diarization", "dual_stream",
        "software_version", tm.iso8601(F.col("recorded_at")).alias("recorded_at"),
        F.when(F.col("echo_segments_removed") > 0, F.col("echo_segments_removed")).alias("echo_segments_removed"),
        F.col("provenance").alias("capture_provenance"), undisclosed.alias("disclosure")).alias("metadata"))


def with_audio_paths(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """Point ``metadata`` at the archived files, where ``archives(meeting_id, new_paths)`` has any."""
    both = documents.join(archives, "meeting_id", "left")
    names = F.transform("new_paths", lambda p: F.element_at(F.split(p, "/"), -1))
    moved = F.col("metadata").withField("audio_paths", F.col("new_paths")).withField("audio_files", names)
    return both.withColumn("metadata", F.when(F.col("new_paths").isNull(), F.col("metadata")).otherwise(moved)).drop("new_paths")
