"""F1-F21 and O5: scalar functions over whole texts and tables."""

from pyspark.sql import functions as F

from ..functions import text as tx, timing as tm, vectors as vc
from .base import query
from .tables import define

WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''))"


def duck_words(expr: str) -> str:
    return WORDS.format(expr)


TRIM = "regexp_replace(regexp_replace({0}, '^[\\p{{Zs}}\\t]+', ''), '[\\p{{Zs}}\\t]+$', '')"


def duck_trim(expr: str) -> str:
    return TRIM.format(expr)


@query("f1_word_set", f"""
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_words, array_to_string(list_sort(ws), ' ') AS words
FROM (SELECT doc_id, {duck_words('text')} AS ws FROM documents)""")
def f1(t):
    d = t.raw("documents").select("doc_id", tx.word_set(F.col("text")).alias("ws"))
    return d.select("doc_id", F.size("ws").alias("n_words"), F.array_join(F.sort_array("ws"), " ").alias("words"))


CLOCK = """printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60)"""


@query("f2_srt_clock", """
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS clock
FROM (SELECT event_id, CAST(trunc(value * 97.531 * 1000) AS BIGINT) AS ms FROM events)""")
def f2(t):
    return t.raw("events").select("event_id", tm.srt_clock(F.col("value") * F.lit(97.531)).alias("clock"))


@query("f3_clock", f"""
SELECT event_id, {CLOCK.format('s')} AS clock
FROM (SELECT event_id, CAST(trunc(value * 97.531) AS BIGINT) AS s FROM events)""")
def f3(t):
    return t.raw("events").select("event_id", tm.clock(F.col("value") * F.lit(97.531)).alias("clock"))


@query("f4_durations", """
SELECT event_id, CASE WHEN s // 3600 > 0 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) ELSE printf('%dm', s % 3600 // 60) END AS length,
       CASE WHEN z // 3600 > 0 THEN printf('%d:%02d:%02d', z // 3600, z % 3600 // 60, z % 60)
            ELSE printf('%02d:%02d', z // 60, z % 60) END AS timer
FROM (SELECT event_id, CAST(trunc(value * 31) AS BIGINT) AS s, greatest(CAST(trunc(value * 31 - 900) AS BIGINT), 0) AS z FROM events)""")
def f4(t):
    s = F.col("value") * F.lit(31)
    return t.raw("events").select("event_id", tm.short_duration(s).alias("length"), tm.timer(s - 900).alias("timer"))


define("r_reply", ("v_segments",), f"""
SELECT a.meeting_id, a.seg_ord, {duck_words('a.text')} AS wa, {duck_words('b.text')} AS wb
FROM v_segments a JOIN v_segments b ON a.meeting_id = b.meeting_id AND b.seg_ord = a.seg_ord + 2""")


def _reply(t):
    s = t.segments.select("meeting_id", "seg_ord", tx.word_set(F.col("text")).alias("wa"))
    nxt = s.select("meeting_id", (F.col("seg_ord") - 2).alias("seg_ord"), F.col("wa").alias("wb"))
    return s.join(nxt, ["meeting_id", "seg_ord"])


@query("f5_jaccard", """
SELECT meeting_id, seg_ord, CASE WHEN len(wa) + len(wb) = 0 THEN 0.0::DOUBLE ELSE
  round(len(list_intersect(wa, wb))::DOUBLE / (len(wa) + len(wb) - len(list_intersect(wa, wb))), 6) END AS jaccard
FROM r_reply""", ("r_reply",))
def f5(t):
    return _reply(t).select("meeting_id", "seg_ord", F.round(tx.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query("f6_containment", """
SELECT meeting_id, seg_ord, CASE WHEN len(wa) = 0 THEN 0.0::DOUBLE ELSE
  round(len(list_intersect(wa, wb))::DOUBLE / len(wa), 6) END AS containment FROM r_reply""", ("r_reply",))
def f6(t):
    return _reply(t).select("meeting_id", "seg_ord",
                            F.round(tx.containment(F.col("wa"), F.col("wb")), 6).alias("containment"))


@query("o5_word_set_overlap", """
SELECT meeting_id, seg_ord, CAST(len(list_intersect(wa, wb)) AS INTEGER) AS shared,
       CAST(len(list_distinct(list_concat(wa, wb))) AS INTEGER) AS either FROM r_reply""", ("r_reply",))
def o5(t):
    return _reply(t).select("meeting_id", "seg_ord", F.size(F.array_intersect("wa", "wb")).alias("shared"),
                            F.size(F.array_union("wa", "wb")).alias("either"))


@query("f7_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f7(t):
    a = t.raw("embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vc.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("f8_overlap_ratio", """
SELECT a.meeting_id, a.seg_ord, CASE WHEN least(a.end_s - a.start_s, b.end_s - b.start_s) > 0 THEN
  round(least(greatest(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 0) / least(a.end_s - a.start_s, b.end_s - b.start_s), 1.0), 6)
  ELSE 0.0::DOUBLE END AS ratio
FROM v_segments a JOIN v_segments b ON a.meeting_id = b.meeting_id AND a.chunk_index = b.chunk_index AND b.seg_ord = a.seg_ord + 1""",
       ("v_segments",))
def f8(t):
    a = t.segments.select("meeting_id", "chunk_index", "seg_ord", "start_s", "end_s")
    b = a.select("meeting_id", "chunk_index", (F.col("seg_ord") - 1).alias("seg_ord"),
                 F.col("start_s").alias("b0"), F.col("end_s").alias("b1"))
    ratio = tm.overlap_ratio(*map(F.col, ("start_s", "end_s", "b0", "b1")))
    return a.join(b, ["meeting_id", "chunk_index", "seg_ord"]).select("meeting_id", "seg_ord", F.round(ratio, 6).alias("ratio"))


@query("f9_sanitized_name", "SELECT page_id, translate(url, '/:' || chr(0), '') AS name FROM pages")
def f9(t):
    return t.raw("pages").select("page_id", tx.sanitize_filename(F.col("url")).alias("name"))


@query("f10_segment_names", """
SELECT file_ord, regexp_replace(stem, '-\\d+$', '') AS base, regexp_replace(stem, '-\\d+$', '') || '-' || CAST(file_ord % 5 AS VARCHAR) AS segment,
       strftime(modified, '%H%M%S') || CASE WHEN file_ord % 2 = 0 THEN '' ELSE '-' || translate(stem, '/:', '') END || '-0' AS session_file,
       strftime(modified, '%Y-%m-%d') AS day
FROM (SELECT *, regexp_replace(file_name, '(_mic)?\\.wav$', '') AS stem FROM v_files)""", ("v_files",))
def f10(t):
    from ..functions import naming
    stem = naming.stem(F.col("file_name"))
    named = F.when(F.col("file_ord") % 2 == 0, "").otherwise(stem)
    return t.files.select("file_ord", naming.base_name(stem).alias("base"),
                          naming.segment_name(stem, F.col("file_ord") % 5).alias("segment"),
                          naming.session_file(F.col("modified"), named).alias("session_file"),
                          F.date_format("modified", "yyyy-MM-dd").alias("day"))


@query("f11_trailing_index", """
SELECT s_suppkey, TRY_CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) AS idx,
       TRY_CAST(regexp_extract(s_name || ' x', '(\\d+)$', 1) AS BIGINT) AS no_idx FROM supplier""")
def f11(t):
    return t.raw("supplier").select("s_suppkey", tx.trailing_index(F.col("s_name")).alias("idx"),
                                    tx.trailing_index(F.concat("s_name", F.lit(" x"))).alias("no_idx"))


CJK = "[\\x{3000}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]"


@query("f12_cjk", f"""
SELECT doc_id, length(text) - length(regexp_replace(text, '{CJK}', '', 'g')) > length(text) // 3 AS cjk FROM documents""")
def f12(t):
    return t.raw("documents").select("doc_id", tx.is_cjk(F.col("text")).alias("cjk"))


def duck_norm(expr: str) -> str:
    return ("trim(regexp_replace(translate(regexp_replace(translate(lower(" + expr + "), '''', chr(57344)), "
            "'\\p{P}', ' ', 'g'), chr(57344), ''''), '[\\p{Zs}\\t]+', ' ', 'g'))")


@query("f13_wer_normalized", f"SELECT doc_id, {duck_norm('text')} AS norm FROM documents")
def f13(t):
    return t.raw("documents").select("doc_id", tx.normalize_for_wer(F.col("text")).alias("norm"))


@query("f15_real_time_factor", """
SELECT file_name, engine, CASE WHEN wall_s > 0 THEN round(audio_s / wall_s, 6) ELSE 0.0::DOUBLE END AS rtf FROM v_eval""", ("v_eval",))
def f15(t):
    return t.eval_pairs.select("file_name", "engine", F.round(tm.real_time_factor(F.col("audio_s"), F.col("wall_s")), 6).alias("rtf"))


@query("f16_token_estimate", """
SELECT doc_id, greatest(CAST(ceil(length(text) / (CAST(2.5 AS DOUBLE) + doc_id % 3)) AS BIGINT), 1) AS tokens FROM documents""")
def f16(t):
    from ..functions import usage
    ratio = F.lit(2.5) + F.col("doc_id") % 3
    return t.raw("documents").select("doc_id", usage.token_estimate(F.length("text"), ratio).alias("tokens"))


@query("f17_prompt_line", f"""
SELECT meeting_id, seg_ord, '[' || {CLOCK.format('CAST(trunc(chunk_index * 40 + start_s) AS BIGINT)')} || '] Speaker ' || CAST(seg_ord % 2 + 1 AS VARCHAR)
       || ' (' || source || '): ' || text AS line, '[' || {CLOCK.format('CAST(trunc(chunk_index * 40 + start_s) AS BIGINT)')} || '] Speaker ' ||
       CAST(seg_ord % 2 + 1 AS VARCHAR) || ': ' || text AS plain_line FROM v_segments""", ("v_segments",))
def f17(t):
    from ..functions import usage
    at = F.col("chunk_index") * 40 + F.col("start_s")
    who = F.concat(F.lit("Speaker "), (F.col("seg_ord") % 2 + 1).cast("string"))
    return t.segments.select("meeting_id", "seg_ord",
                             usage.prompt_line(at, who, F.col("source"), F.col("text"), F.lit(True)).alias("line"),
                             usage.prompt_line(at, who, F.col("source"), F.col("text"), F.lit(False)).alias("plain_line"))


@query("f18_punctuation_only", f"""
SELECT p.doc_id, count(*) FILTER (WHERE {duck_trim('tok')} <> '' AND NOT regexp_matches(tok, '[\\p{{L}}\\p{{N}}\\p{{S}}]')) AS glue_tokens,
       count(*) AS tokens
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS tok FROM documents) p GROUP BY doc_id""")
def f18(t):
    toks = F.split("text", " ")
    return t.raw("documents").select(
        "doc_id", F.size(F.filter(toks, tx.is_punctuation_only)).cast("bigint").alias("glue_tokens"),
        F.size(toks).cast("bigint").alias("tokens"))


@query("f19_trim_blank", f"""
SELECT doc_id, {duck_trim("chr(9) || '  ' || text || chr(10) || ' '")} AS trimmed FROM documents""")
def f19(t):
    padded = F.concat(F.lit("\t  "), "text", F.lit("\n "))
    return t.raw("documents").select("doc_id", tx.trim_blank(padded).alias("trimmed"))


@query("f20_iso8601", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(date_trunc('second', ts)) AS back_us,
       epoch_us(ts) AS frac_us, CAST(NULL AS BIGINT) AS bad_us FROM events""")
def f20(t):
    ts = F.col("ts").cast("timestamp")
    iso = tm.iso8601(ts)
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.raw("events").select("event_id", iso.alias("iso"), F.unix_micros(tm.parse_iso8601(iso)).alias("back_us"),
                                  F.unix_micros(tm.parse_iso8601(frac)).alias("frac_us"),
                                  F.unix_micros(tm.parse_iso8601(F.concat(F.lit("x"), iso))).alias("bad_us"))


@query("f21_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f21(t):
    return t.raw("documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
