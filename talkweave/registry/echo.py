"""Echo removal and speaker identity: J5-J11, J25, J26, A5-A8, O2, O8, P7, W7, U1, U7 and the whole plans."""

from pyspark.sql import functions as F

from ..functions import vectors as vc
from ..operators import echo, labeling as lb, merge as mg, reconcile as rc
from ..plans import chunked, oneshot
from .base import query
from .labeling import define_labeled, define_split
from .scalars import duck_trim, duck_words
from .tables import CHUNK, STREAM, _d, define

IDENT = ["seg_ord"]

define("r_tagged", ("v_segments",), """
SELECT *, CASE source WHEN 'local' THEN 'Local ' ELSE 'Remote ' END || 'Speaker ' || CAST(seg_ord % 2 + 1 AS VARCHAR) AS speaker
FROM v_segments""")


def tagged(t):
    who = F.concat(F.lit("Speaker "), (F.col("seg_ord") % 2 + 1).cast("string"))
    return lb.tag_source(t.segments.withColumn("speaker", who))


def odd_voices(t):
    """Echo segments have odd ordinals, so both channels' second speaker must share a voice to be compared."""
    v = t.speaker_embeddings
    return v.withColumn("speaker", F.when(F.col("source") == "local", F.when(F.col("speaker") == "Speaker 1", "Speaker 2")
                                          .otherwise("Speaker 1")).otherwise(F.col("speaker")))


define("r_voices", ("v_speaker_embeddings",), """
SELECT * REPLACE (CASE WHEN source = 'local' THEN CASE speaker WHEN 'Speaker 1' THEN 'Speaker 2' ELSE 'Speaker 1' END ELSE speaker END AS speaker)
FROM v_speaker_embeddings""")
define("r_best_remote", ("r_voices",), """
SELECT l.meeting_id, l.chunk_index, l.speaker AS local, r.speaker AS remote, list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS similarity
FROM r_voices l JOIN r_voices r ON l.meeting_id = r.meeting_id AND l.chunk_index = r.chunk_index AND l.source = 'local' AND r.source = 'remote'
WHERE list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) > 0.8
QUALIFY row_number() OVER (PARTITION BY l.meeting_id, l.chunk_index, l.speaker ORDER BY similarity DESC, r.speaker) = 1""")


@query("j5_best_remote_voice", "SELECT meeting_id, chunk_index, local, remote, round(similarity, 6) AS similarity FROM r_best_remote", ("r_best_remote",))
def j5(t):
    return echo.best_remote(odd_voices(t), CHUNK).withColumn("similarity", F.round("similarity", 6))


define("r_echo_pairs", ("r_tagged", "r_best_remote"), f"""
SELECT l.meeting_id, l.chunk_index, l.seg_ord AS l_seg_ord, r.seg_ord AS r_seg_ord, r.start_s AS r_start, l.text AS l_text, r.text AS r_text,
       {duck_words('l.text')} AS lw, {duck_words('r.text')} AS rw
FROM r_tagged l
JOIN r_best_remote b ON b.meeting_id = l.meeting_id AND b.chunk_index = l.chunk_index AND 'Local ' || b.local = l.speaker
JOIN r_tagged r ON r.meeting_id = l.meeting_id AND r.chunk_index = l.chunk_index AND r.source = 'remote' AND r.speaker = 'Remote ' || b.remote
WHERE l.source = 'local' AND least(l.end_s - l.start_s, r.end_s - r.start_s) > 0
  AND (least(l.end_s, r.end_s) - greatest(l.start_s, r.start_s)) / least(l.end_s - l.start_s, r.end_s - r.start_s) > 0.5""")


def pairs(t):
    return echo.candidate_pairs(tagged(t), echo.best_remote(odd_voices(t), CHUNK), CHUNK, IDENT)


@query("j6_overlapping_candidates", "SELECT meeting_id, chunk_index, l_seg_ord, r_seg_ord FROM r_echo_pairs", ("r_echo_pairs",))
def j6(t):
    return pairs(t).select("meeting_id", "chunk_index", "l_seg_ord", "r_seg_ord")


HIT = """CASE WHEN len(lw) + len(rw) = 0 THEN FALSE ELSE len(list_intersect(lw, rw)) / (len(lw) + len(rw) - len(list_intersect(lw, rw))) > 0.7
  OR (len(lw) > 0 AND len(list_intersect(lw, rw)) / len(lw) > 0.7) END"""


@query("j7_text_gate", f"SELECT meeting_id, l_seg_ord, r_seg_ord, {HIT} AS hit FROM r_echo_pairs", ("r_echo_pairs",))
def j7(t):
    return pairs(t).select("meeting_id", "l_seg_ord", "r_seg_ord", echo.pair_hit(0.7).alias("hit"))


def duck_window(source: str) -> str:
    return f"""
SELECT meeting_id, chunk_index, l_seg_ord FROM (
  SELECT meeting_id, chunk_index, l_seg_ord, any_value(lw) AS lw, {duck_words("string_agg(r_text, ' ' ORDER BY r_start)")} AS ww
  FROM {source} GROUP BY meeting_id, chunk_index, l_seg_ord HAVING count(*) > 1)
WHERE len(list_intersect(lw, ww)) / (len(lw) + len(ww) - len(list_intersect(lw, ww))) > 0.7"""


# Remote speech cut into two overlapping halves of its words, so only both halves together match the echo.
define("r_halves", ("v_segments",), f"""
SELECT r.meeting_id, r.chunk_index, l.seg_ord AS l_seg_ord, r.start_s + h AS r_start, {duck_words('l.text')} AS lw,
       CASE h WHEN 0 THEN substr(r.text, 1, length(r.text) // 2) ELSE substr(r.text, length(r.text) // 2 + 1) END AS r_text
FROM v_segments r JOIN v_segments l ON l.meeting_id = r.meeting_id AND l.seg_ord = r.seg_ord + 1 AND l.source = 'local' AND r.source = 'remote'
CROSS JOIN (VALUES (0), (1)) s(h)""")


@query("j8_window_gate", duck_window("r_halves"), ("r_halves",))
def j8(t):
    s = t.segments
    local = s.where("source = 'local'").select(*CHUNK, F.col("seg_ord").alias("l_seg_ord"), echo.tx.word_set(F.col("text")).alias("l_words"))
    texts = F.array(F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))"), F.expr("substring(text, CAST(floor(length(text) / 2) AS INT) + 1)"))
    remote = s.where("source = 'remote'").select(*CHUNK, (F.col("seg_ord") + 1).alias("l_seg_ord"), F.posexplode(texts).alias("r_seg_ord", "x"))
    both = local.join(remote, [*CHUNK, "l_seg_ord"]).select(*CHUNK, "l_seg_ord", "r_seg_ord", "l_words", echo.tx.word_set(F.col("x")).alias("r_words"))
    return echo.judged(both, CHUNK, IDENT, 0.7).where("together").select(*CHUNK, "l_seg_ord")


define("r_echoes", ("r_echo_pairs",), f"""
SELECT meeting_id, chunk_index, l_seg_ord AS seg_ord FROM r_echo_pairs WHERE {HIT}
UNION {duck_window('r_echo_pairs')}""")


@query("j9_echo_removed", """
SELECT t.meeting_id, t.chunk_index, t.source, t.seg_ord, t.speaker, t.start_s, t.end_s FROM r_tagged t
ANTI JOIN r_echoes e ON e.meeting_id = t.meeting_id AND e.seg_ord = t.seg_ord""", ("r_tagged", "r_echoes"))
def j9(t):
    kept = echo.remove_echo(tagged(t), odd_voices(t), CHUNK, IDENT)
    return kept.select(*STREAM, "seg_ord", "speaker", "start_s", "end_s")


@query("j9_echo_counts", "SELECT meeting_id, chunk_index, count(*) AS removed FROM r_echoes GROUP BY ALL", ("r_echoes",))
def j9_counts(t):
    return echo.removed_counts(echo.echoes(tagged(t), odd_voices(t), CHUNK, IDENT), CHUNK)


@query("a5_echo_total", "SELECT meeting_id, count(*) AS removed FROM r_echoes GROUP BY ALL", ("r_echoes",))
def a5(t):
    per_chunk = echo.removed_counts(echo.echoes(tagged(t), odd_voices(t), CHUNK, IDENT), CHUNK)
    return per_chunk.groupBy("meeting_id").agg(F.sum("removed").alias("removed"))


@query("a6_ordered_text", """
SELECT meeting_id, chunk_index, source, string_agg(text, ' ' ORDER BY start_s, seg_ord) AS text FROM v_segments GROUP BY ALL""", ("v_segments",))
def a6(t):
    from ..operators.documents import joined_text
    return joined_text(t.segments, STREAM, ["start_s", "seg_ord"])


define("r_stacked", ("v_speaker_embeddings",), """
SELECT meeting_id, source, speaker, flatten(list(embedding ORDER BY chunk_index)) AS e FROM v_speaker_embeddings GROUP BY ALL""")
define("r_width", ("v_speaker_embeddings",), """
SELECT meeting_id, max(d) AS dim FROM (
  SELECT meeting_id, d FROM (SELECT DISTINCT meeting_id, len(embedding) AS n FROM v_speaker_embeddings),
  unnest(range(1, (SELECT max(len(embedding)) + 1 FROM v_speaker_embeddings))) u(d) GROUP BY meeting_id, d HAVING bool_and(n % d = 0)) GROUP BY meeting_id""")
VOICE = ["meeting_id", "source", "speaker"]


@query("a7_centroid", """
SELECT meeting_id, source, speaker, CAST(dim AS INTEGER) AS dim, round(list_avg(list_transform(range(0, len(e) // dim), lambda s: e[s * dim + 1]::DOUBLE)), 4)::DOUBLE AS head,
       round(list_avg(list_transform(range(0, len(e) // dim), lambda s: e[s * dim + dim]::DOUBLE)), 4)::DOUBLE AS tail FROM r_stacked JOIN r_width USING (meeting_id)""", ("r_stacked", "r_width"))
def a7(t):
    v = echo.centroids(t.speaker_embeddings, VOICE, "chunk_index", echo.base_dimension(t.speaker_embeddings, ["meeting_id"]), ["meeting_id"])
    return v.select(*VOICE, F.size("embedding").alias("dim"),
                    F.round(_d(F.element_at("embedding", 1)), 4).alias("head"), F.round(_d(F.element_at("embedding", -1)), 4).alias("tail"))


@query("a8_base_dimension", """
SELECT meeting_id, CAST(max(d) AS INTEGER) AS dim FROM (
  SELECT meeting_id, d FROM (SELECT meeting_id, len(e) + CASE speaker WHEN 'Speaker 1' THEN 32 ELSE 0 END AS n FROM r_stacked),
  unnest(range(1, (SELECT max(len(e)) + 33 FROM r_stacked))) u(d)
  GROUP BY meeting_id, d HAVING bool_and(n % d = 0)) GROUP BY meeting_id""", ("r_stacked",))
def a8(t):
    extra = F.slice("embedding", 1, 32)
    v = echo.stacked(t.speaker_embeddings, VOICE, "chunk_index")
    v = v.withColumn("embedding", F.when(F.col("speaker") == "Speaker 1", F.concat("embedding", extra)).otherwise(F.col("embedding")))
    return echo.base_dimension(v, ["meeting_id"])


define("r_mapping", ("v_chunks",), """
SELECT meeting_id, chunk_index, side || ' Speaker ' || CAST(k AS VARCHAR) AS speaker, side || ' Speaker ' || CAST(k + chunk_index AS VARCHAR) AS global
FROM v_chunks CROSS JOIN (VALUES ('Local', 1), ('Remote', 1), ('Remote', 2)) s(side, k) WHERE (meeting_id + chunk_index) % 3 <> 0""")


def mapping(t):
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("k")) for s, k in (("Local", 1), ("Remote", 1), ("Remote", 2))])
    m = t.chunks.where("(meeting_id + chunk_index) % 3 <> 0").select(*CHUNK, F.inline(sides))
    label = lambda n: F.concat("side", F.lit(" Speaker "), n.cast("string"))
    return m.select(*CHUNK, label(F.col("k")).alias("speaker"), label(F.col("k") + F.col("chunk_index")).alias("global"))


@query("j10_remapped", """
SELECT t.meeting_id, t.chunk_index, t.seg_ord, coalesce(m.global, t.speaker) AS speaker
FROM r_tagged t LEFT JOIN r_mapping m USING (meeting_id, chunk_index, speaker)""", ("r_tagged", "r_mapping"))
def j10(t):
    return mg.remap(tagged(t), mapping(t), CHUNK).select(*CHUNK, "seg_ord", "speaker")


@query("j11_unmapped_labels", """
SELECT DISTINCT t.meeting_id, t.chunk_index, t.speaker FROM r_tagged t SEMI JOIN r_mapping m USING (meeting_id, chunk_index)
ANTI JOIN r_mapping n USING (meeting_id, chunk_index, speaker)""", ("r_tagged", "r_mapping"))
def j11(t):
    return mg.unmapped_labels(tagged(t), mapping(t))


def _starts():
    meeting = F.timestamp_seconds(F.lit(1704067200) + F.col("meeting_id") * 3600)
    chunk = F.timestamp_seconds(F.lit(1704067200) + F.col("meeting_id") * 3600 + F.col("chunk_index") * 40)
    return chunk, meeting


@query("p7_shifted_times", """
SELECT meeting_id, seg_ord, chunk_index * 40 + start_s AS elapsed, chunk_index * 40 + end_s AS elapsed_end,
       strftime(make_timestamp(CAST((1704067200 + meeting_id * 3600 + chunk_index * 40 + start_s) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS at
FROM v_segments""", ("v_segments",))
def p7(t):
    s = mg.shifted(t.segments, *_starts())
    return s.select("meeting_id", "seg_ord", "elapsed", "elapsed_end", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("w7_transcript_order", """
SELECT meeting_id, seg_ord, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_index * 40 + start_s, source, seg_ord) AS place FROM v_segments""",
       ("v_segments",))
def w7(t):
    return mg.places(mg.shifted(t.segments, *_starts())).select("meeting_id", "seg_ord", "place")


@query("o2_chunk_sequence", """
SELECT meeting_id, chunk_index, segments, row_number() OVER (PARTITION BY meeting_id ORDER BY chunk_index) AS place FROM v_chunks""", ("v_chunks",))
def o2(t):
    from ..operators.ordered import blocks_of, numbered
    return numbered(t.chunks.select(*CHUNK, "segments"), ["meeting_id"], ["chunk_index"], "place", blocks_of(F.col("chunk_index"), 4096))


@query("o8_existing_wins", """
SELECT meeting_id, chunk_index, speaker, coalesce(max(global) FILTER (WHERE p = 0), max(global)) AS global FROM (
  SELECT *, 0 AS p FROM r_mapping UNION ALL SELECT DISTINCT meeting_id, chunk_index, speaker, 'kept ' || speaker, 1 FROM r_tagged) GROUP BY ALL""",
       ("r_mapping", "r_tagged"))
def o8(t):
    other = tagged(t).select(*CHUNK, "speaker", F.concat(F.lit("kept "), "speaker").alias("global")).distinct()
    return mg.merge_maps(mapping(t), other, [*CHUNK, "speaker"])


@query("j25_global_voices", """
SELECT v.meeting_id, v.source, 'Global ' || CAST((v.chunk_index + CAST(right(v.speaker, 1) AS INT)) % 3 AS VARCHAR) AS global,
       CAST(arg_min(v.embedding[1], v.chunk_index * 10 + CAST(right(v.speaker, 1) AS INT)) AS FLOAT) AS head
FROM v_speaker_embeddings v GROUP BY ALL""", ("v_speaker_embeddings",))
def j25(t):
    v = t.speaker_embeddings
    m = v.select(*STREAM, "speaker", F.concat(F.lit("Global "), ((F.col("chunk_index") + F.expr("CAST(right(speaker, 1) AS INT)")) % 3).cast("string")).alias("global"))
    return mg.global_voices(v, m).select("meeting_id", "source", "global", F.element_at("embedding", 1).alias("head"))


@query("j26_reconcile_candidates", """
SELECT a.meeting_id, a.source, a.chunk_index, a.speaker, b.speaker AS reference, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM v_speaker_embeddings a JOIN v_speaker_embeddings b ON a.meeting_id = b.meeting_id AND a.source = b.source AND b.chunk_index = 0 AND a.chunk_index > 0
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.65""", ("v_speaker_embeddings",))
def j26(t):
    v = t.speaker_embeddings
    found = rc.candidates(v.where("chunk_index > 0"), v.where("chunk_index = 0").drop("chunk_index"), ["meeting_id", "source"])
    return found.select(*STREAM, "speaker", "reference", F.round("similarity", 6).alias("similarity"))


def define_identities(name: str, voices: str, namespace: str) -> None:
    """Replay of the greedy matching: one recursion step per chunk, the reference voices held as a list."""
    define(name, (voices,), f"""
SELECT meeting_id, namespace, chunk_index, m.s AS speaker, m.g AS global_speaker FROM (
WITH RECURSIVE c AS (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, namespace ORDER BY chunk_index) AS k FROM (
    SELECT meeting_id, {namespace} AS namespace, chunk_index, list({{'s': speaker, 'e': embedding::DOUBLE[]}} ORDER BY speaker) AS locals FROM {voices} GROUP BY ALL)),
r AS (
  SELECT meeting_id, namespace, chunk_index, k, list_transform(locals, lambda l: {{'g': l.s, 'e': l.e}}) AS refs,
         list_max(list_transform(locals, lambda l: CAST(regexp_extract(l.s, '(\\d+)$', 1) AS BIGINT))) + 1 AS nxt,
         list_transform(locals, lambda l: {{'s': l.s, 'g': l.s}}) AS mapping FROM c WHERE k = 1
  UNION ALL
  SELECT meeting_id, namespace, chunk_index, k,
    list_concat(list_transform(refs, lambda f: {{'g': f.g, 'e': CASE WHEN len(list_filter(got, lambda x: x.g = f.g)) = 0 THEN f.e
      ELSE list_transform(list_zip(f.e, list_filter(got, lambda x: x.g = f.g)[1].e), lambda z: 0.9::DOUBLE * z[1] + (1 - 0.9::DOUBLE) * z[2]) END}}),
      list_transform(fresh, lambda l, i: {{'g': 'Speaker ' || (nxt + i - 1), 'e': l.e}})),
    nxt + len(fresh),
    list_concat(list_transform(got, lambda x: {{'s': x.s, 'g': x.g}}), list_transform(fresh, lambda l, i: {{'s': l.s, 'g': 'Speaker ' || (nxt + i - 1)}}))
  FROM (
    SELECT *, list_filter(locals, lambda l: len(list_filter(got, lambda x: x.s = l.s)) = 0) AS fresh FROM (
      SELECT c.meeting_id, c.namespace, c.chunk_index, c.k, c.locals, r.refs, r.nxt,
        list_reduce(list_sort(list_filter(flatten(list_transform(c.locals, lambda l: list_transform(r.refs, lambda f: {{'m': -list_cosine_similarity(l.e, f.e), 's': l.s, 'g': f.g, 'e': l.e}}))), lambda x: x.m <= -0.65)),
          lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s = x.s OR y.g = x.g)) > 0 THEN acc ELSE list_append(acc, x) END,
          CAST([] AS STRUCT(m DOUBLE, s VARCHAR, g VARCHAR, e DOUBLE[])[])) AS got
      FROM r JOIN c ON c.meeting_id = r.meeting_id AND c.namespace = r.namespace AND c.k = r.k + 1)))
SELECT meeting_id, namespace, chunk_index, unnest(mapping) AS m FROM r)""")


define("r_known", ("v_speaker_embeddings", "v_chunks"), """
SELECT e.* REPLACE (CASE WHEN NOT d.dual THEN '' WHEN e.source = 'local' THEN 'Local ' ELSE 'Remote ' END AS source)
FROM v_speaker_embeddings e JOIN (SELECT meeting_id, bool_or(is_dual_stream) AS dual FROM v_chunks GROUP BY meeting_id) d USING (meeting_id) WHERE d.dual OR e.source <> 'local'""")
define_identities("r_channel_identity", "r_known", "source")
define_identities("r_source_identity", "v_speaker_embeddings", "source")
define_identities("r_odd_identity", "r_voices", "source")
define("r_channel_map", ("r_channel_identity", "v_chunks"), """
SELECT i.meeting_id, i.chunk_index, CASE WHEN namespace = 'Local ' THEN 'local' ELSE 'remote' END AS source,
       CASE WHEN namespace = 'Local ' OR c.is_dual_stream THEN namespace ELSE '' END || speaker AS speaker, namespace || global_speaker AS global
FROM r_channel_identity i JOIN v_chunks c USING (meeting_id, chunk_index)""")


@query("u1_reconciled_speakers", "SELECT * FROM r_channel_map", ("r_channel_map",))
def u1(t):
    return rc.channel_mapping(t.speaker_embeddings, t.chunks)


@query("u7_reconciled_segments", """
SELECT meeting_id, namespace, chunk_index || ':' || speaker AS segment_label, global_speaker FROM r_source_identity""", ("r_source_identity",))
def u7(t):
    return rc.reconcile_segments(t.speaker_embeddings)


# A third of the chunks has lost its microphone.
define("r_heard", ("v_segments",), "SELECT * FROM v_segments WHERE source <> 'local' OR (meeting_id + chunk_index) % 3 <> 0")
define("r_heard_chunks", ("r_heard",), "SELECT meeting_id, chunk_index, bool_or(source = 'local') AS is_dual_stream FROM r_heard GROUP BY ALL")
define("r_heard_voices", ("v_speaker_embeddings",), "SELECT * FROM v_speaker_embeddings WHERE source <> 'local' OR (meeting_id + chunk_index) % 3 <> 0")
define("r_heard_known", ("r_heard_voices", "r_heard_chunks"), """
SELECT e.* REPLACE (CASE WHEN NOT d.dual THEN '' WHEN e.source = 'local' THEN 'Local ' ELSE 'Remote ' END AS source)
FROM r_heard_voices e JOIN (SELECT meeting_id, bool_or(is_dual_stream) AS dual FROM r_heard_chunks GROUP BY meeting_id) d USING (meeting_id) WHERE d.dual OR e.source <> 'local'""")
define_identities("r_heard_identity", "r_heard_known", "source")
define("r_heard_map", ("r_heard_identity", "r_heard_chunks"), """
SELECT i.meeting_id, i.chunk_index, CASE WHEN namespace = 'Local ' OR c.is_dual_stream THEN namespace ELSE '' END || speaker AS speaker, namespace || global_speaker AS global
FROM r_heard_identity i JOIN r_heard_chunks c USING (meeting_id, chunk_index)""")


def partly_single(rows):
    """Rows of the remote channel, and of the local one where its chunk still has a microphone."""
    return rows.where("source <> 'local' OR (meeting_id + chunk_index) % 3 <> 0")


def heard_voices(t):
    return partly_single(t.speaker_embeddings)


def heard_chunks(t):
    return partly_single(t.segments).groupBy(*CHUNK).agg(F.bool_or(F.col("source") == "local").alias("is_dual_stream"))


define("r_clean", ("r_heard",), f"""
SELECT * EXCLUDE (t, p) FROM (
  SELECT *, lag(t) OVER (PARTITION BY meeting_id, chunk_index, source ORDER BY seg_ord) AS p
  FROM (SELECT *, {duck_trim('text')} AS t FROM r_heard WHERE start_s <> end_s)) WHERE p IS NULL OR p <> t""")
define_split("r_clean_split", "r_clean")
define_labeled("r_clean_labeled", "r_clean_split")
define("r_landed_all", ("r_clean_labeled", "r_names", "r_heard_chunks"), f"""
SELECT l.* REPLACE (CASE WHEN NOT c.is_dual_stream THEN l.speaker ELSE CASE l.source WHEN 'local' THEN 'Local ' ELSE 'Remote ' END || CASE WHEN l.speaker = 'Unknown' AND n.n = 1 THEN coalesce(f.speaker, 'Unknown') ELSE l.speaker END END AS speaker,
       {duck_trim('l.text')} AS text)
FROM r_clean_labeled l JOIN r_heard_chunks c USING (meeting_id, chunk_index)
LEFT JOIN (SELECT meeting_id, chunk_index, source, count(*) AS n FROM r_names GROUP BY ALL) n USING (meeting_id, chunk_index, source)
LEFT JOIN (SELECT meeting_id, chunk_index, source, arg_min(speaker, start_s * 1000000 + seg_ord * 100 + piece) AS speaker FROM r_clean_labeled WHERE speaker <> 'Unknown' GROUP BY ALL) f USING (meeting_id, chunk_index, source)""")


def define_echo_free(name: str, rows: str, best: str, chunk_key: str, ident: str) -> None:
    """``rows`` without the local ones that repeat the remote speaker ``best`` names for them."""
    keys, ids = chunk_key.split(", "), ident.split(", ")
    on = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys)
    l_ids = ", ".join(f"l.{i} AS l_{i}" for i in ids)
    group = ", ".join([*keys, *[f"l_{i}" for i in ids]])
    define(f"{name}_pairs", (rows, best), f"""
SELECT {', '.join('l.' + k for k in keys)}, {l_ids}, r.start_s AS r_start, r.text AS r_text, {duck_words('l.text')} AS lw, {duck_words('r.text')} AS rw
FROM {rows} l JOIN {best} b ON {on.format('b', 'l')} AND 'Local ' || b.local = l.speaker
JOIN {rows} r ON {on.format('r', 'l')} AND r.source = 'remote' AND r.speaker = 'Remote ' || b.remote
WHERE l.source = 'local' AND least(l.end_s - l.start_s, r.end_s - r.start_s) > 0
  AND (least(l.end_s, r.end_s) - greatest(l.start_s, r.start_s)) / least(l.end_s - l.start_s, r.end_s - r.start_s) > 0.5""")
    define(name, (f"{name}_pairs", rows), f"""
SELECT t.* FROM {rows} t ANTI JOIN (
  SELECT {group} FROM {name}_pairs WHERE {HIT}
  UNION SELECT {group} FROM (SELECT {group}, any_value(lw) AS lw, {duck_words("string_agg(r_text, ' ' ORDER BY r_start)")} AS ww FROM {name}_pairs GROUP BY {group} HAVING count(*) > 1)
  WHERE len(list_intersect(lw, ww)) / (len(lw) + len(ww) - len(list_intersect(lw, ww))) > 0.7) e
ON {on.format('e', 't')} AND {' AND '.join(f'e.l_{i} = t.{i}' for i in ids)}""")


define("r_plain_best", ("v_speaker_embeddings",), """
SELECT l.meeting_id, l.chunk_index, l.speaker AS local, r.speaker AS remote, list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS similarity
FROM v_speaker_embeddings l JOIN v_speaker_embeddings r ON l.meeting_id = r.meeting_id AND l.chunk_index = r.chunk_index AND l.source = 'local' AND r.source = 'remote'
WHERE similarity > 0.8 QUALIFY row_number() OVER (PARTITION BY l.meeting_id, l.chunk_index, l.speaker ORDER BY similarity DESC, r.speaker) = 1""")
define_echo_free("r_landed", "r_landed_all", "r_plain_best", "meeting_id, chunk_index", "seg_ord, piece")


@query("chunked_transcript", """
SELECT l.meeting_id, l.chunk_index, l.source, l.seg_ord, l.piece, round(chunk_index * 40 + l.start_s, 6) AS elapsed, round(chunk_index * 40 + l.end_s, 6) AS elapsed_end, coalesce(m.global, l.speaker) AS speaker, l.text
FROM r_landed l LEFT JOIN r_heard_map m USING (meeting_id, chunk_index, speaker)""", ("r_landed", "r_heard_map"))
def chunked_plan(t):
    chunks, voices = heard_chunks(t), heard_voices(t)
    rows = chunked.processed_chunks(partly_single(t.segments), t.words, t.turns, t.speech, voices, chunks)
    done = chunked.finalize(rows, voices, chunks, *_starts())
    return done.select(*STREAM, "seg_ord", "piece", F.round("elapsed", 6).alias("elapsed"), F.round("elapsed_end", 6).alias("elapsed_end"), "speaker", "text")


define("r_oneshot_map", ("r_odd_identity",), "SELECT * EXCLUDE (namespace), namespace AS source FROM r_odd_identity")
define("r_oneshot_raw", ("v_segments", "r_oneshot_map"), """
SELECT s.meeting_id, s.chunk_index, s.source, s.seg_ord, s.chunk_index * 40 + s.start_s AS start_s, s.chunk_index * 40 + s.end_s AS end_s, s.text, coalesce(m.global_speaker, s.raw) AS speaker
FROM (SELECT *, CASE WHEN seg_ord % 7 = 3 THEN 'Unknown' ELSE 'Speaker ' || (seg_ord % 2 + 1) END AS raw FROM v_segments) s
LEFT JOIN r_oneshot_map m ON m.meeting_id = s.meeting_id AND m.chunk_index = s.chunk_index AND m.source = s.source AND m.speaker = s.raw""")
define("r_oneshot_rows", ("r_oneshot_raw", "r_oneshot_map"), """
SELECT r.* REPLACE (CASE r.source WHEN 'local' THEN 'Local ' ELSE 'Remote ' END || CASE WHEN r.speaker = 'Unknown' THEN coalesce(o.only, 'Unknown') ELSE r.speaker END AS speaker)
FROM r_oneshot_raw r LEFT JOIN (
  SELECT meeting_id, source, arg_min(speaker, start_s * 100000 + seg_ord) AS only FROM r_oneshot_raw
  SEMI JOIN (SELECT meeting_id, source FROM r_oneshot_map GROUP BY ALL HAVING count(DISTINCT global_speaker) = 1) USING (meeting_id, source)
  WHERE speaker <> 'Unknown' GROUP BY ALL) o USING (meeting_id, source)""")
define("r_everyone", ("r_voices", "r_oneshot_map"), """
SELECT v.meeting_id, v.source, m.global_speaker AS speaker, arg_min(v.embedding, v.chunk_index * 100 + CAST(right(v.speaker, 1) AS INT)) AS embedding
FROM r_voices v JOIN r_oneshot_map m USING (meeting_id, chunk_index, source, speaker) GROUP BY ALL""")
define("r_oneshot_best", ("r_everyone",), """
SELECT l.meeting_id, l.speaker AS local, r.speaker AS remote, list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS similarity
FROM r_everyone l JOIN r_everyone r ON l.meeting_id = r.meeting_id AND l.source = 'local' AND r.source = 'remote'
WHERE similarity > 0.8
QUALIFY row_number() OVER (PARTITION BY l.meeting_id, l.speaker ORDER BY similarity DESC, CAST(regexp_extract(r.speaker, '(\\d+)$', 1) AS BIGINT)) = 1""")
define_echo_free("r_oneshot", "r_oneshot_rows", "r_oneshot_best", "meeting_id", "seg_ord")


@query("oneshot_transcript", """
SELECT meeting_id, chunk_index, source, seg_ord, start_s, end_s, speaker, text FROM r_oneshot""", ("r_oneshot",))
def oneshot_plan(t):
    who = F.when(F.col("seg_ord") % 7 == 3, F.lit("Unknown")).otherwise(F.concat(F.lit("Speaker "), (F.col("seg_ord") % 2 + 1).cast("string")))
    offsets = t.chunks.select(*CHUNK, _d(F.col("chunk_index") * 40).alias("offset_s"))
    done = oneshot.transcript(t.segments.withColumn("speaker", who), odd_voices(t), offsets, IDENT)
    return done.select(*STREAM, "seg_ord", "start_s", "end_s", "speaker", "text")
