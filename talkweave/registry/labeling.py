"""Labelling: P1-P8, P26, J1-J4, J12, W2-W6, A21, A22, O1, O4, O7."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import labeling as lb
from .base import query
from .scalars import duck_trim
from .tables import SEGMENT, STREAM, define

KEY = "meeting_id, chunk_index, source"
SEG = f"{KEY}, seg_ord"
WORD = f"{SEG}, word_ord"


@query("p1_nonzero_segments", "SELECT meeting_id, seg_ord, start_s, end_s FROM v_segments WHERE start_s <> end_s", ("v_segments",))
def p1(t):
    return t.segments.where("start_s <> end_s").select("meeting_id", "seg_ord", "start_s", "end_s")


@query("p2_single_speaker", f"""
SELECT meeting_id, seg_ord, 'Speaker 1' AS speaker, '' AS source, {duck_trim("' ' || text")} AS text FROM v_segments""", ("v_segments",))
def p2(t):
    s = lb.single_speaker(t.segments.withColumn("text", F.concat(F.lit(" "), "text")))
    return s.select("meeting_id", "seg_ord", "speaker", "source", "text")


@query("p3_stamped_source", "SELECT meeting_id, seg_ord, 'remote' AS source FROM v_segments", ("v_segments",))
def p3(t):
    return lb.single_speaker(t.segments).withColumn("source", F.lit("remote")).select("meeting_id", "seg_ord", "source")


define("r_labels", ("v_segments",), """
SELECT *, CASE seg_ord % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' WHEN 2 THEN 'Local Speaker 3'
          ELSE 'Speaker ' || CAST(seg_ord % 2 + 1 AS VARCHAR) END AS raw_label,
       CASE WHEN seg_ord % 7 = 0 THEN '' ELSE source END AS channel FROM v_segments""")
PREFIXED = """CASE WHEN starts_with(raw_label, 'Local ') OR starts_with(raw_label, 'Remote ') OR channel NOT IN ('local', 'remote') THEN raw_label
  ELSE CASE channel WHEN 'local' THEN 'Local ' ELSE 'Remote ' END || CASE WHEN raw_label IN ('', 'Unknown') THEN 'Unknown' ELSE raw_label END END"""


def _labels(t):
    o = F.col("seg_ord")
    raw = (F.when(o % 5 == 0, "Unknown").when(o % 5 == 1, "").when(o % 5 == 2, "Local Speaker 3")
           .otherwise(F.concat(F.lit("Speaker "), (o % 2 + 1).cast("string"))))
    return t.segments.withColumn("speaker", raw).withColumn("source", F.when(o % 7 == 0, "").otherwise(F.col("source")))


@query("p4_source_prefix", f"SELECT meeting_id, seg_ord, {PREFIXED} AS speaker FROM r_labels", ("r_labels",))
def p4(t):
    return lb.tag_source(lb.tag_source(_labels(t))).select("meeting_id", "seg_ord", "speaker")


@query("p5_unknown_sentinel", f"SELECT meeting_id, seg_ord, suffix({PREFIXED}, 'Unknown') AS unknown FROM r_labels", ("r_labels",))
def p5(t):
    return lb.tag_source(_labels(t)).select("meeting_id", "seg_ord", tx.is_unknown(F.col("speaker")).alias("unknown"))


@query("p8_chunk_rows", """
SELECT meeting_id, chunk_index, seg_ord, start_s, end_s, source, text, confidence AS quality_score FROM v_segments""", ("v_segments",))
def p8(t):
    from ..operators.merge import chunk_rows
    return chunk_rows(t.segments.withColumn("speaker", F.lit("Speaker 1")).withColumn("language", F.lit("en"))).drop("speaker")


define("r_runs", ("v_words",), f"""
SELECT *, CASE WHEN word_ord % 400 = 399 THEN NULL ELSE w_end END AS run_end,
       CASE WHEN word_ord % 300 = 299 THEN trim(word) ELSE word END AS run_text FROM v_words""")


@query("p26_word_timing_trust", f"""
SELECT meeting_id, seg_ord, bool_and(run_end IS NOT NULL) AND
       {duck_trim("string_agg(run_text, '' ORDER BY word_ord)")} = (SELECT {duck_trim('s.text')} FROM v_segments s
         WHERE s.meeting_id = r.meeting_id AND s.seg_ord = r.seg_ord) AS trusted
FROM r_runs r GROUP BY meeting_id, seg_ord""", ("r_runs", "v_segments"))
def p26(t):
    from ..functions.tokens import trusted_words
    tokens = F.transform(F.split("text", " "), lambda tok, i: F.struct(
        (F.col("start_s") + i * 0.3).alias("start"),
        F.when(i % 400 == 399, F.lit(None)).otherwise(F.col("start_s") + i * 0.3 + 0.25).alias("end"),
        F.when(i % 300 == 299, tok).otherwise(F.concat(F.lit(" "), tok)).alias("text")))
    return t.segments.withColumn("runs", tokens).select(
        "meeting_id", "seg_ord", trusted_words(F.col("runs"), tx.trim_blank(F.col("text"))).isNotNull().alias("trusted"))


define("r_doubled", ("v_segments",), """
SELECT * REPLACE (seg_ord * 2 AS seg_ord) FROM v_segments
UNION ALL SELECT * REPLACE (seg_ord * 2 + 1 AS seg_ord, text || ' ' AS text) FROM v_segments WHERE seg_ord % 3 = 0""")


@query("w3_repeats_dropped", f"""
SELECT meeting_id, source, seg_ord FROM (
  SELECT *, lag(t) OVER (PARTITION BY {KEY} ORDER BY seg_ord) AS p
  FROM (SELECT *, {duck_trim('text')} AS t FROM r_doubled WHERE start_s <> end_s)) WHERE p IS NULL OR p <> t""", ("r_doubled",))
def w3(t):
    again = F.when(F.col("seg_ord") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    doubled = t.segments.withColumn("i", F.explode(again)).withColumn("seg_ord", F.col("seg_ord") * 2 + F.col("i"))
    doubled = doubled.withColumn("text", F.when(F.col("i") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return lb.drop_empty_and_repeats(doubled).select("meeting_id", "source", "seg_ord")


define("r_names", ("v_turns",), f"""
SELECT {KEY}, speaker, first_ord, 'Speaker ' || CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY first_ord) AS VARCHAR) AS name
FROM (SELECT {KEY}, speaker, min(turn_ord) AS first_ord FROM v_turns GROUP BY ALL)""")


@query("w2_speaker_names", "SELECT meeting_id, chunk_index, source, speaker, name FROM r_names", ("r_names",))
def w2(t):
    return lb.speaker_names(t.turns).drop("first_ord")


@query("o7_speakers_in_order", """
SELECT meeting_id, speaker, first_ord FROM (SELECT meeting_id, speaker, min(turn_ord) AS first_ord FROM v_turns GROUP BY ALL)""", ("v_turns",))
def o7(t):
    return lb.speaker_names(t.turns, ["meeting_id"]).select("meeting_id", "speaker", "first_ord")


RANK = """ORDER BY overlap DESC, has_mid DESC, CASE WHEN has_mid THEN turn_ord ELSE -turn_ord END DESC"""
define("r_seg_pairs", ("v_segments", "v_turns"), f"""
SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, t.turn_ord, t.speaker, t.quality_score,
       greatest(least(s.end_s, t.t_end) - greatest(s.start_s, t.t_start), 0) AS overlap,
       t.t_start <= (s.start_s + s.end_s) / 2 AND (s.start_s + s.end_s) / 2 <= t.t_end AS has_mid
FROM v_segments s JOIN v_turns t USING (meeting_id, chunk_index, source)""")
define("r_seg_owner", ("r_seg_pairs",), f"""
SELECT * FROM r_seg_pairs WHERE overlap > 0 OR has_mid
QUALIFY row_number() OVER (PARTITION BY {SEG} {RANK}) = 1""")


@query("j1_segment_owner", f"""
SELECT s.meeting_id, s.seg_ord, coalesce(o.speaker, 'Unknown') AS owner, round(o.overlap, 6) AS overlap, o.quality_score AS owner_quality
FROM v_segments s LEFT JOIN r_seg_owner o USING ({SEG})""", ("r_seg_owner", "v_segments"))
def j1(t):
    return lb.label_by_overlap(t.segments, t.turns).select(
        "meeting_id", "seg_ord", "owner", F.round("overlap", 6).alias("overlap"), "owner_quality")


define("r_word_owner", ("v_words", "v_turns"), f"""
SELECT {WORD}, w_start, w_end, word, speaker AS owner FROM (
  SELECT w.*, t.speaker, t.turn_ord, greatest(least(w_end, t_end) - greatest(w_start, t_start), 0) AS overlap,
         t_start <= (w_start + w_end) / 2 AND (w_start + w_end) / 2 <= t_end AND
           greatest(least(w_end, t_end) - greatest(w_start, t_start), 0) > 0 AS has_mid,
         CASE WHEN w_start > t_end THEN w_start - t_end WHEN t_start > w_end THEN t_start - w_end ELSE 0 END AS dist
  FROM v_words w LEFT JOIN v_turns t USING ({KEY}))
QUALIFY row_number() OVER (PARTITION BY {WORD} ORDER BY overlap DESC, has_mid DESC,
  CASE WHEN has_mid THEN -turn_ord ELSE 0 END, CASE WHEN overlap > 0 THEN 0 ELSE dist END, turn_ord) = 1""")


@query("j2_word_owner", "SELECT meeting_id, seg_ord, word_ord, owner FROM r_word_owner", ("r_word_owner",))
def j2(t):
    return lb.word_owner(t.words, t.turns).select("meeting_id", "seg_ord", "word_ord", "owner")


define("r_pieces", ("r_word_owner",), f"""
SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {SEG} ORDER BY w_start, word_ord) AS piece FROM (
  SELECT *, NOT glue AND (held IS NULL OR held.o IS DISTINCT FROM owner) AS opens FROM (
    SELECT *, last_value(CASE WHEN NOT glue THEN {{'o': owner}} END IGNORE NULLS) OVER (PARTITION BY {SEG} ORDER BY w_start, word_ord
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
    FROM (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY w_start, word_ord) > 1 AND
                 NOT regexp_matches({duck_trim('word')}, '[\\p{{L}}\\p{{N}}\\p{{S}}]') AS glue FROM r_word_owner)))""")


@query("w5_word_pieces", "SELECT meeting_id, seg_ord, word_ord, CAST(piece AS BIGINT) AS piece FROM r_pieces", ("r_pieces",))
def w5(t):
    return lb.word_pieces(lb.word_owner(t.words, t.turns)).select("meeting_id", "seg_ord", "word_ord", "piece")


define("r_piece_rows", ("r_pieces",), f"""
SELECT *, count(*) OVER (PARTITION BY {SEG}) AS n_pieces, sum(n) OVER (PARTITION BY {SEG}) AS n_words,
       row_number() OVER (PARTITION BY {SEG}, p_text <> '' ORDER BY piece) = 1 AS is_first,
       row_number() OVER (PARTITION BY {SEG}, p_text <> '' ORDER BY piece DESC) = 1 AS is_last
FROM (SELECT {SEG}, CAST(piece AS BIGINT) AS piece, count(*) AS n, min(w_start) AS p_start, arg_max(w_end, word_ord) AS p_end,
             {duck_trim("string_agg(word, '' ORDER BY w_start, word_ord)")} AS p_text, arg_min(owner, word_ord) AS dominant
      FROM r_pieces GROUP BY {SEG}, piece)""")
def define_split(name: str, segments: str) -> None:
    define(name, ("r_piece_rows", segments), f"""
SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, coalesce(p.piece, 1) AS piece,
       CASE WHEN p.n_pieces > 1 AND NOT p.is_first THEN p_start ELSE s.start_s END AS start_s,
       CASE WHEN p.n_pieces > 1 AND NOT p.is_last THEN p_end ELSE s.end_s END AS end_s,
       CASE WHEN p.n_pieces > 1 THEN p_text ELSE s.text END AS text, p.dominant, s.confidence
FROM {segments} s LEFT JOIN (SELECT * FROM r_piece_rows WHERE n_words >= 2 AND (n_pieces = 1 OR p_text <> '')) p USING ({SEG})""")


define_split("r_split", "v_segments")


@query("w6_split_pieces", """
SELECT meeting_id, seg_ord, piece, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text, dominant FROM r_split""", ("r_split",))
def w6(t):
    s = lb.split_at_speaker_changes(t.segments, lb.word_owner(t.words, t.turns))
    return s.select("meeting_id", "seg_ord", "piece", F.round("start_s", 6).alias("start_s"),
                    F.round("end_s", 6).alias("end_s"), "text", "dominant")


@query("j3_speech_fraction", """
SELECT s.meeting_id, s.seg_ord, round(CASE WHEN s.end_s - s.start_s > 0 THEN least(1.0, coalesce(
   sum(greatest(least(s.end_s, r.r_end) - greatest(s.start_s, r.r_start), 0)) FILTER (WHERE r.probability >= 0.5), 0) / (s.end_s - s.start_s)) ELSE 0 END, 6)::DOUBLE AS fraction
FROM v_segments s LEFT JOIN v_speech r USING (meeting_id, chunk_index, source)
GROUP BY s.meeting_id, s.seg_ord, s.start_s, s.end_s""",
       ("v_segments", "v_speech"))
def j3(t):
    f = lb.speech_fraction(t.segments, t.speech)
    return f.select("meeting_id", "seg_ord", F.round("fraction", 6).alias("fraction"))


@query("j4_evidenced_quality", f"""
SELECT s.meeting_id, s.seg_ord, q.quality_score AS evidence_quality
FROM v_segments s LEFT JOIN (SELECT * FROM r_seg_pairs WHERE overlap > 0 AND speaker = 'S' || CAST(seg_ord % 3 + 2 AS VARCHAR)
   QUALIFY row_number() OVER (PARTITION BY {SEG} ORDER BY overlap DESC, turn_ord) = 1) q USING ({SEG})""", ("v_segments", "r_seg_pairs"))
def j4(t):
    who = F.concat(F.lit("S"), (F.col("seg_ord") % 3 + 2).cast("string"))
    q = lb.label_by_overlap(t.segments.withColumn("dominant", who), t.turns, evidence="dominant")
    return q.select("meeting_id", "seg_ord", "evidence_quality")


@query("j12_named_embeddings", f"""
SELECT v.meeting_id, v.chunk_index, v.source, coalesce(n.name, v.speaker) AS speaker, CAST(len(v.embedding) AS INTEGER) AS dim
FROM (SELECT * REPLACE (CASE speaker WHEN 'Speaker 1' THEN 'S3' ELSE 'S9' END AS speaker) FROM v_speaker_embeddings) v
LEFT JOIN r_names n USING ({KEY}, speaker)""", ("v_speaker_embeddings", "r_names"))
def j12(t):
    from ..operators.merge import remap
    raw = t.speaker_embeddings.withColumn("speaker", F.when(F.col("speaker") == "Speaker 1", "S3").otherwise("S9"))
    named = remap(raw, lb.speaker_names(t.turns).select(*STREAM, "speaker", F.col("name").alias("global")), STREAM)
    return named.select(*STREAM, "speaker", F.size("embedding").alias("dim"))


def define_labeled(name: str, split: str) -> None:
    define(name, (split, "r_names", "v_turns", "v_speech"), f"""
SELECT meeting_id, chunk_index, source, seg_ord, piece, start_s, end_s, text, confidence,
       CASE WHEN loud AND NOT good THEN 'Unknown' ELSE speaker END AS speaker
FROM (
  SELECT p.*, coalesce(n.name, raw) AS speaker, coalesce(f.fraction, 0) >= 0.5 AS loud, coalesce(p.quality, 1.0) >= 0.3 AS good
  FROM (
    SELECT s.*, CASE WHEN s.dominant IS NULL THEN coalesce(o.speaker, 'Unknown') ELSE s.dominant END AS raw,
           CASE WHEN s.dominant IS NULL THEN o.quality_score ELSE e.quality_score END AS quality
    FROM {split} s
    LEFT JOIN (SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, s.piece, t.speaker, t.quality_score, t.turn_ord,
                 greatest(least(s.end_s, t.t_end) - greatest(s.start_s, t.t_start), 0) AS overlap,
                 t.t_start <= (s.start_s + s.end_s) / 2 AND (s.start_s + s.end_s) / 2 <= t.t_end AS has_mid
               FROM {split} s JOIN v_turns t USING ({KEY})
               WHERE greatest(least(s.end_s, t.t_end) - greatest(s.start_s, t.t_start), 0) > 0
                  OR (t.t_start <= (s.start_s + s.end_s) / 2 AND (s.start_s + s.end_s) / 2 <= t.t_end)
               QUALIFY row_number() OVER (PARTITION BY {SEG}, piece {RANK}) = 1) o USING ({SEG}, piece)
    LEFT JOIN (SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, s.piece, t.quality_score
               FROM {split} s JOIN v_turns t USING ({KEY})
               WHERE t.speaker = s.dominant AND least(s.end_s, t.t_end) > greatest(s.start_s, t.t_start)
               QUALIFY row_number() OVER (PARTITION BY {SEG}, piece
                 ORDER BY least(s.end_s, t.t_end) - greatest(s.start_s, t.t_start) DESC, turn_ord) = 1) e USING ({SEG}, piece)) p
  LEFT JOIN (SELECT {KEY}, speaker AS raw, name FROM r_names) n USING ({KEY}, raw)
  LEFT JOIN (SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, s.piece,
               CASE WHEN s.end_s > s.start_s THEN least(1.0, sum(least(s.end_s, r.r_end) - greatest(s.start_s, r.r_start)) / (s.end_s - s.start_s)) ELSE 0 END AS fraction
             FROM {split} s JOIN v_speech r USING ({KEY})
             WHERE r.probability >= 0.5 AND least(s.end_s, r.r_end) > greatest(s.start_s, r.r_start)
             GROUP BY {SEG}, piece, s.start_s, s.end_s) f USING ({SEG}, piece))
WHERE loud OR good""")


define_labeled("r_labeled", "r_split")


@query("p6_gated_labels", f"""
SELECT meeting_id, chunk_index, source, seg_ord, piece, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, speaker,
       {duck_trim('text')} AS text FROM r_labeled""", ("r_labeled",))
def p6(t):
    rows = lb.label_streams(t.segments, t.words, t.turns, t.speech)
    return rows.select(*SEGMENT, "piece", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "speaker", "text")


@query("a21_channel_speakers", f"SELECT {KEY}, count(*) AS n_speakers FROM r_names GROUP BY ALL", ("r_names",))
def a21(t):
    from ..operators.aggregates import channel_speakers
    return channel_speakers(lb.speaker_names(t.turns))


define("r_half_known", ("v_segments",), """
SELECT *, CASE WHEN seg_ord % 3 = 0 THEN 'Unknown' ELSE 'Speaker ' || CAST(chunk_index + 1 AS VARCHAR) END AS speaker FROM v_segments""")


@query("a22_unknowns_resolved", f"""
SELECT s.meeting_id, s.seg_ord, CASE WHEN s.speaker = 'Unknown' AND n.n = 1 THEN coalesce(f.speaker, 'Unknown') ELSE s.speaker END AS speaker
FROM r_half_known s
LEFT JOIN (SELECT {KEY}, count(*) - 1 AS n FROM r_names GROUP BY ALL) n USING ({KEY})
LEFT JOIN (SELECT {KEY}, arg_min(speaker, seg_ord) AS speaker FROM r_half_known WHERE speaker <> 'Unknown' GROUP BY ALL) f USING ({KEY})""",
       ("r_half_known", "r_names"))
def a22(t):
    from ..operators.aggregates import channel_speakers
    who = F.when(F.col("seg_ord") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Speaker "), (F.col("chunk_index") + 1).cast("string")))
    counts = channel_speakers(lb.speaker_names(t.turns)).withColumn("n_speakers", F.col("n_speakers") - 1)
    return lb.resolve_unknowns(t.segments.withColumn("speaker", who), counts, ["seg_ord"]).select("meeting_id", "seg_ord", "speaker")


@query("o4_streams_united", """
SELECT meeting_id, chunk_index, seg_ord, source FROM v_segments WHERE source = 'remote'
UNION ALL SELECT meeting_id, chunk_index, seg_ord, source FROM v_segments WHERE source = 'local'""", ("v_segments",))
def o4(t):
    from ..plans.chunked import unite
    s = t.segments.select("meeting_id", "chunk_index", "seg_ord", "source")
    return unite(s.where("source = 'remote'"), s.where("source = 'local'"))


@query("o1_chunk_order", """
SELECT meeting_id, chunk_index, seg_ord, row_number() OVER (PARTITION BY meeting_id, chunk_index ORDER BY start_s, seg_ord) AS place FROM v_segments""",
       ("v_segments",))
def o1(t):
    from ..operators.merge import chunk_places
    return chunk_places(t.segments).select("meeting_id", "chunk_index", "seg_ord", "place")


define("r_tokens", ("v_words",), """
SELECT meeting_id, chunk_index, source, seg_ord * 100000 + word_ord AS token_ord, w_start, w_end,
       CASE WHEN word_ord % 9 = 4 THEN '3.' WHEN word_ord % 9 = 5 THEN '5 or' WHEN word_ord % 9 = 8 THEN word || '?' ELSE word END AS token
FROM v_words""")


@query("w4_sentences", f"""
SELECT * FROM (
SELECT {KEY}, CAST(sentence AS BIGINT) AS sentence, round(arg_min(w_start, token_ord) FILTER (WHERE token <> ''), 6) AS start_s, round(arg_max(w_end, token_ord), 6) AS end_s,
       {duck_trim("string_agg(token, '' ORDER BY token_ord)")} AS text
FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY token_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
      FROM (SELECT *, nxt IS NULL OR (right(token, 1) IN ('.', '!', '?') AND NOT (right(token, 1) = '.' AND regexp_matches(nxt, '^\\p{{N}}'))) AS ends
            FROM (SELECT *, lead(token) OVER (PARTITION BY {KEY} ORDER BY token_ord) AS nxt FROM r_tokens)))
GROUP BY {KEY}, sentence) WHERE text <> ''""", ("r_tokens",))
def w4(t):
    o = F.col("word_ord")
    token = (F.when(o % 9 == 4, "3.").when(o % 9 == 5, "5 or").when(o % 9 == 8, F.concat("word", F.lit("?"))).otherwise(F.col("word")))
    tokens = t.words.select(*STREAM, (F.col("seg_ord") * 100000 + o).alias("token_ord"), "w_start", "w_end", token.alias("token"))
    s = lb.sentences(tokens, STREAM, "token_ord")
    return s.select(*STREAM, "sentence", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text")
