"""Who said what: words and segments against diarized turns and speech regions.

Inputs (one meeting is one ``meeting_id``):
  segments  meeting_id, chunk_index, source, seg_ord, start_s, end_s, text, ...
  words     ... seg_ord, word_ord, w_start, w_end, word
  turns     meeting_id, chunk_index, source, turn_ord, t_start, t_end, speaker, quality_score
  speech    meeting_id, chunk_index, source, r_start, r_end, probability
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import params
from ..functions.text import is_blank, is_punctuation_only, is_unknown, trim_blank, with_source_prefix
from ..functions.timing import overlap_seconds
from .intervals import carried, overlap_pairs

STREAM = ["meeting_id", "chunk_index", "source"]
SEGMENT = [*STREAM, "seg_ord"]
WORD = [*SEGMENT, "word_ord"]
SINGLE = "Speaker 1"


def drop_empty_and_repeats(segments: DataFrame) -> DataFrame:
    """Drop zero-length segments, then segments repeating the text of the one before."""
    kept = segments.where(F.col("start_s") != F.col("end_s")).withColumn("__t", trim_blank(F.col("text")))
    before = F.lag("__t").over(Window.partitionBy(*STREAM).orderBy("seg_ord"))        # a stream ends with its chunk
    seen = kept.withColumn("__p", before)
    return seen.where(F.col("__p").isNull() | (F.col("__p") != F.col("__t"))).drop("__p", "__t")


def speaker_names(turns: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """``Speaker k`` by first appearance. Turns shrink to one row per speaker before any ordering."""
    first = turns.groupBy(*keys, "speaker").agg(F.min("turn_ord").alias("first_ord"))
    w = Window.partitionBy(*keys).orderBy("first_ord")
    return first.select(*keys, "speaker", "first_ord",
                        F.concat(F.lit("Speaker "), F.row_number().over(w).cast("string")).alias("name"))


def _win_rank(overlap: Column, has_mid: Column) -> Column:
    """Largest overlap; on a tie the last turn around the midpoint, else the first turn."""
    tie = F.when(has_mid, F.col("turn_ord")).otherwise(-F.col("turn_ord"))
    return F.struct(overlap, has_mid, tie)


def _measure() -> tuple[Column, Column]:
    """Overlap of a segment with a turn, and whether the turn holds the segment's midpoint (null without a turn)."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    overlap = overlap_seconds(*map(F.col, ("start_s", "end_s", "t_start", "t_end")))
    return overlap, (F.col("t_start") <= mid) & (mid <= F.col("t_end"))


def label_by_overlap(rows: DataFrame, turns: DataFrame, key: list[str] = SEGMENT, evidence: str | None = None) -> DataFrame:
    """Adds owner (Unknown if none), overlap and owner_quality from the turn that overlaps a row most.

    With ``evidence`` naming a column of speakers already known from words, also evidence_quality: the quality of
    that speaker's best-overlapping turn. One join and one aggregation serve both.
    """
    turn = turns.select(*STREAM, "turn_ord", "t_start", "t_end", F.col("speaker").alias("t_speaker"), "quality_score")
    overlap, has_mid = _measure()
    pairs = overlap_pairs(rows, turn, STREAM, "start_s", "end_s", "t_start", "t_end", touching=True, how="left")
    pairs = pairs.select("*", F.when(F.col("turn_ord").isNotNull(), overlap).alias("__overlap"), has_mid.alias("__mid"))
    valid = (F.col("__overlap") > 0) | F.col("__mid")
    best = F.max_by(F.struct("t_speaker", "quality_score", "__overlap"),
                    F.when(valid, _win_rank(F.col("__overlap"), F.col("__mid")))).alias("__b")
    wanted = [best]
    if evidence:
        same = (F.col("t_speaker") == F.col(evidence)) & (F.col("__overlap") > 0)
        wanted.append(F.max_by(F.struct("quality_score"), F.when(same, F.struct("__overlap", -F.col("turn_ord")))).alias("__e"))
    out = pairs.groupBy(*key).agg(*carried(rows, key), *wanted)
    found = [F.coalesce("__b.t_speaker", F.lit(params.UNKNOWN)).alias("owner"), F.col("__b.__overlap").alias("overlap"),
             F.col("__b.quality_score").alias("owner_quality")]
    if evidence:
        found.append(F.col("__e.quality_score").alias("evidence_quality"))
    return out.select(*rows.columns, *found)


def word_owner(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every word with the speaker of its turn; a word in a gap goes to the nearest turn, null without turns.

    The turns of a stream are few, as a chunk ends after minutes: they meet its words as one array, in a single join, and
    the words are moved once. The turns are looked up in a hash table of the task: words that need no sort for it are held
    in memory once, for what follows, and not twice.
    """
    listed = turns.groupBy(*STREAM).agg(F.collect_list(F.struct("t_start", "t_end", "turn_ord", "speaker")).alias("__turns")).hint("shuffle_hash")
    asked = words.select(*WORD, "w_start", "w_end", "word").join(listed, STREAM, "left")
    return asked.select(*WORD, "w_start", "w_end", "word", F.coalesce(_touching(), _nearer()).alias("owner"))


def _touching() -> Column:
    """The speaker of the turn a word overlaps most, by the rule for segments; null if it touches none."""
    mid = (F.col("w_start") + F.col("w_end")) / 2

    def ranked(t: Column) -> Column:
        overlap = F.greatest(F.least(F.col("w_end"), t["t_end"]) - F.greatest(F.col("w_start"), t["t_start"]), F.lit(0.0))
        holds = (t["t_start"] <= mid) & (mid <= t["t_end"]) & (overlap > 0)
        return F.struct(overlap.alias("overlap"), holds.alias("holds"), F.when(holds, t["turn_ord"]).otherwise(-t["turn_ord"]).alias("tie"), t["speaker"].alias("speaker"))

    touching = F.filter("__turns", lambda t: (F.col("w_start") <= t["t_end"]) & (t["t_start"] <= F.col("w_end")))
    return F.array_max(F.transform(touching, ranked))["speaker"]


def _nearer() -> Column:
    """For a word touching no turn: the speaker of the closer of its two neighbours, the earlier-listed on a tie."""
    ended = F.filter("__turns", lambda t: t["t_end"] <= F.col("w_start"))
    begins = F.filter("__turns", lambda t: t["t_start"] >= F.col("w_start"))
    before = F.array_max(F.transform(ended, lambda t: F.struct(t["t_end"].alias("at"), (-t["turn_ord"]).alias("o"), t["speaker"].alias("speaker"))))
    after = F.array_min(F.transform(begins, lambda t: F.struct(t["t_start"].alias("at"), t["turn_ord"].alias("o"), t["speaker"].alias("speaker"))))
    back, ahead = F.col("w_start") - before["at"], after["at"] - F.col("w_end")
    first = after.isNull() | (back < ahead) | ((back == ahead) & (-before["o"] < after["o"]))
    return F.when(before.isNotNull() & first, before["speaker"]).otherwise(after["speaker"])


def word_pieces(owned: DataFrame) -> DataFrame:
    """Number the runs of one owner inside a segment; punctuation and blanks stay with the run they follow.

    The window key is one segment, whose words arrived as one array value.
    """
    w = Window.partitionBy(*SEGMENT).orderBy("w_start", "word_ord")
    # The flag is made before the rows are sorted, so that the text goes along only where it is asked for.
    flagged = owned.withColumn("__mark", is_punctuation_only(F.col("word")) | is_blank(F.col("word")))
    effective = flagged.withColumn("__glue", F.col("__mark") & (F.row_number().over(w) > 1)).drop("__mark")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(~F.col("__glue"), F.struct("owner")), ignorenulls=True).over(so_far)
    opened = (~F.col("__glue")) & (held.isNull() | ~F.col("owner").eqNullSafe(held["owner"]))
    marked = effective.withColumn("__open", opened.cast("int"))
    return marked.withColumn("piece", F.sum("__open").over(w)).drop("__glue", "__open")


def split_at_speaker_changes(segments: DataFrame, owned: DataFrame) -> DataFrame:
    """Segments cut where the owner of their words changes: SEGMENT, piece, start_s, end_s, text, dominant.

    Segments with fewer than two words, or whose stream has no turns at all, pass unchanged. The outer pieces
    keep the segment's own bounds; blank pieces vanish unless nothing else is left.
    """
    pieces = word_pieces(owned)
    by_word = F.sort_array(F.collect_list(F.struct("w_start", "word_ord", "word")))
    text = trim_blank(F.array_join(F.transform(by_word, lambda x: x["word"]), ""))
    last = F.max_by("w_end", F.struct("w_start", "word_ord"))
    opener = F.min_by(F.struct("owner"), F.struct("w_start", "word_ord"))["owner"]
    runs = pieces.groupBy(*SEGMENT, "piece").agg(
        F.min("w_start").alias("p_start"), last.alias("p_end"), text.alias("p_text"), opener.alias("dominant"),
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*SEGMENT)
    runs = runs.select("*", F.count(F.lit(1)).over(whole).alias("n_pieces"), F.sum("n").over(whole).alias("n_words"),
                       F.max(F.col("dominant").isNotNull()).over(whole).alias("evidence"), (F.col("p_text") != "").alias("solid"))
    solid = Window.partitionBy(*SEGMENT, "solid").orderBy("piece")
    solid_down = Window.partitionBy(*SEGMENT, "solid").orderBy(F.col("piece").desc())
    runs = runs.select("*", (F.row_number().over(solid) == 1).alias("is_first"), (F.row_number().over(solid_down) == 1).alias("is_last"),
                       F.max("solid").over(whole).alias("any_solid"))
    usable = runs.where("n_words >= 2 AND evidence AND (n_pieces = 1 OR solid)")
    cut = usable.where("n_pieces = 1 OR any_solid").drop("n", "n_words", "evidence", "solid", "any_solid")
    joined = segments.join(cut, SEGMENT, "left")
    many = F.coalesce(F.col("n_pieces") > 1, F.lit(False))
    return joined.select(
        *SEGMENT, F.coalesce("piece", F.lit(1).cast("bigint")).alias("piece"),
        F.when(many & ~F.col("is_first"), F.col("p_start")).otherwise(F.col("start_s")).alias("start_s"),
        F.when(many & ~F.col("is_last"), F.col("p_end")).otherwise(F.col("end_s")).alias("end_s"),
        F.when(many, F.col("p_text")).otherwise(F.col("text")).alias("text"), "dominant",
        *[c for c in segments.columns if c not in (*SEGMENT, "start_s", "end_s", "text")])


PIECE = [*SEGMENT, "piece"]


def speech_fraction(rows: DataFrame, speech: DataFrame, key: list[str] = SEGMENT,
                    probability: float = params.SPEECH_PROBABILITY) -> DataFrame:
    """Adds fraction: the share of each row covered by likely speech, at most 1; 0 for a row without length."""
    loud = speech.where(F.col("probability") >= probability).select(*STREAM, "r_start", "r_end")
    pairs = overlap_pairs(rows, loud, STREAM, "start_s", "end_s", "r_start", "r_end", how="left")
    piece = overlap_seconds(*map(F.col, ("start_s", "end_s", "r_start", "r_end")))
    covered = F.sum(F.when(F.col("r_start").isNotNull(), piece)).alias("__covered")
    out = pairs.groupBy(*key).agg(*carried(rows, key), covered)
    length = F.col("end_s") - F.col("start_s")
    share = F.least(F.try_divide(F.coalesce("__covered", F.lit(0.0)), length), F.lit(1.0))
    return out.withColumn("fraction", F.when(length > 0, share).otherwise(F.lit(0.0))).drop("__covered")


def decide(speaker: Column, fraction: Column, quality: Column, has_map: Column,
           speech_threshold: float = params.SPEECH_FRACTION, quality_threshold: float = params.QUALITY) -> Column:
    """Struct(speaker, include) from the speech and quality gates; without a speech map everything stays."""
    loud = F.lit(True) if speech_threshold <= 0 else fraction >= speech_threshold
    good = F.coalesce(quality, F.lit(1.0)) >= quality_threshold
    named = F.when(has_map & loud & ~good, F.lit(params.UNKNOWN)).otherwise(speaker)
    return F.struct(named.alias("speaker"), (~has_map | loud | good).alias("include"))


def label_streams(segments: DataFrame, words: DataFrame, turns: DataFrame, speech: DataFrame,
                  speech_threshold: float = params.SPEECH_FRACTION) -> DataFrame:
    """The whole labelling step: split, own, gate, name. One row per kept piece.

    A straight line of joins and aggregations: nothing upstream is computed twice.
    """
    pieces = split_at_speaker_changes(segments, word_owner(words, turns))
    owned = label_by_overlap(pieces, turns, PIECE, evidence="dominant")
    rows = speech_fraction(owned, speech, PIECE)
    by_words = F.col("dominant").isNotNull()
    rows = rows.withColumn("raw", F.coalesce("dominant", "owner")).withColumn(
        "quality", F.when(by_words, F.col("evidence_quality")).otherwise(F.col("owner_quality")))
    names = speaker_names(turns).select(*STREAM, F.col("speaker").alias("raw"), "name")
    mapped = speech.select(*STREAM).distinct().withColumn("has_map", F.lit(True))
    rows = rows.join(names, [*STREAM, "raw"], "left").join(mapped, STREAM, "left")
    verdict = decide(F.coalesce("name", "raw"), F.col("fraction"), F.col("quality"),
                     F.coalesce("has_map", F.lit(False)), speech_threshold)
    judged = rows.withColumn("__v", verdict).where("__v.include")
    extra = [c for c in segments.columns if c not in (*SEGMENT, "start_s", "end_s", "text")]
    return judged.select(*PIECE, "start_s", "end_s", F.col("__v.speaker").alias("speaker"),
                         trim_blank(F.col("text")).alias("text"), *extra)


def single_speaker(segments: DataFrame, speaker: str = SINGLE) -> DataFrame:
    """One fixed label, trimmed text, no source yet."""
    return segments.withColumn("speaker", F.lit(speaker)).withColumn("text", trim_blank(F.col("text"))).withColumn(
        "source", F.lit(""))


def resolve_unknowns(labeled: DataFrame, speaker_counts: DataFrame, order: list[str], keys: list[str] = STREAM) -> DataFrame:
    """Where exactly one speaker was heard under ``keys``, Unknown rows take the first confirmed label."""
    blank = (F.col("speaker") == "") | (F.col("speaker") == params.UNKNOWN)
    confirmed = labeled.where(~blank).groupBy(*keys).agg(F.min_by("speaker", F.struct(*order)).alias("__only"))
    lone = speaker_counts.where("n_speakers = 1").select(*keys).join(confirmed, keys)
    joined = labeled.join(lone, keys, "left")
    return joined.withColumn("speaker", F.when(blank & F.col("__only").isNotNull(), F.col("__only"))
                             .otherwise(F.col("speaker"))).drop("__only")


def tag_source(labeled: DataFrame) -> DataFrame:
    return labeled.withColumn("speaker", with_source_prefix(F.col("speaker"), F.col("source")))


def sentences(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Join tokens into sentences ending in ``.!?``; a dot before a digit does not end one.

    ``keys`` end with a chunk, so one window over them serves both the look ahead and the numbering.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.lead(F.substring("token", 1, 1)).over(w)
    mark = F.expr("right(token, 1)")
    decimal = (mark == ".") & F.coalesce(ahead.rlike(r"^\p{N}"), F.lit(False))
    last = F.lead(F.lit(1)).over(w).isNull()
    flagged = tokens.withColumn("__end", ((mark.isin(".", "!", "?") & ~decimal) | last).cast("bigint"))
    so_far = F.sum("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = flagged.withColumn("sentence", F.coalesce(so_far, F.lit(0).cast("bigint"))).drop("__end")
    parts = F.sort_array(F.collect_list(F.struct(order, "token")))
    text = trim_blank(F.array_join(F.transform(parts, lambda x: x["token"]), ""))
    opened = F.min_by("w_start", F.when(F.col("token") != "", F.col(order)))
    return (grouped.groupBy(*keys, "sentence")
            .agg(F.coalesce(opened, F.max_by("w_start", order)).alias("start_s"),
                 F.max_by("w_end", order).alias("end_s"), text.alias("text"))
            .where("text <> ''"))
