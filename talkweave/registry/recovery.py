"""Files and recovery: S9-S11, P27, J13-J18, J27, A9-A11, A17, A24, W1, W8, W11, W20, O3, O6."""

from pyspark.sql import functions as F

from ..operators import documents as dc, recovery as rv
from ..operators.merge import shifted
from .base import query
from .echo import tagged
from .tables import _d, define

PARSE = "'^(.*)-(\\d+)(_mic)?\\.wav$'"
define("r_files", ("v_files",), f"""
SELECT *, regexp_extract(file_name, {PARSE}, 1) AS session_id, CAST(regexp_extract(file_name, {PARSE}, 2) AS INT) AS idx,
       suffix(file_name, '_mic.wav') AS is_mic FROM v_files""")
define("r_inventory", ("r_files",), """
SELECT session_id, idx, bool_or(NOT is_mic) AS has_system, bool_or(is_mic) AS has_mic, min(modified) FILTER (WHERE NOT is_mic) AS created
FROM r_files GROUP BY session_id, idx""")
define("r_completed", (), "SELECT DISTINCT 'm' || CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey % 7 AS INT) AS idx FROM orders")


def completed(t):
    return t.raw("orders").select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("session_id"),
                                  (F.col("o_orderkey") % 7).cast("int").alias("idx")).distinct()


def sessions(t):
    return t.raw("customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("session_id"),
                                    (F.col("c_nationkey") % 9).cast("int").alias("sentinel_index"))


@query("s9_audio_inventory", """
SELECT b.session_id, i.idx, b.session_id || CASE WHEN i.idx IS NOT NULL THEN '-' || i.idx WHEN zero_indexed THEN '-0' ELSE '' END || '.wav' AS system_file,
       b.session_id || CASE WHEN i.idx IS NOT NULL THEN '-' || i.idx WHEN zero_indexed THEN '-0' ELSE '' END || '_mic.wav' AS mic_file
FROM (SELECT 'm' || c_custkey AS session_id, c_custkey % 2 = 0 AS zero_indexed FROM customer) b
JOIN (SELECT session_id, idx FROM r_inventory WHERE has_system
      UNION ALL SELECT 'm' || c_custkey, NULL FROM customer) i ON i.session_id = b.session_id
 AND (CASE WHEN i.idx IS NULL THEN NOT zero_indexed OR b.session_id NOT IN (SELECT session_id FROM r_inventory WHERE has_system) ELSE zero_indexed OR i.idx >= 2 END)""", ("r_inventory",))
def s9(t):
    bases = t.raw("customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("session_id"), (F.col("c_custkey") % 2 == 0).alias("zero_indexed"))
    return rv.discovered(t.files, bases)


def _header(declared, byte_rate):
    """A 44-byte header as it lies on disk, numbers little-endian."""
    def le(n):
        h = F.lpad(F.hex(n), 8, "0")
        return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    return F.unhex(F.concat(F.lit("52494646"), le(declared + 36), F.lit("57415645666D74201000000001000100"), F.lit("80BB0000"),
                            le(byte_rate), F.lit("02001000"), F.lit("64617461"), le(declared)))


def wavs(t):
    declared = F.col("length") - 44 - F.when(F.col("file_ord") % 5 == 0, F.least(F.col("length") - 44, F.lit(4096))).otherwise(0)
    rate = F.when(F.col("file_ord") % 2 == 0, 96000).otherwise(32000).cast("bigint")
    return t.files.select("file_ord", "length", _header(declared, rate).alias("content"))


@query("s10_wav_audit", """
SELECT file_ord, declared AS declared_bytes, length - 44 AS real_bytes, length - 44 > declared AS needs_repair
FROM (SELECT *, length - 44 - CASE WHEN file_ord % 5 = 0 THEN least(length - 44, 4096) ELSE 0 END AS declared FROM v_files)""", ("v_files",))
def s10(t):
    return rv.wav_audit(wavs(t)).select("file_ord", "declared_bytes", "real_bytes", "needs_repair")


@query("s11_durations", """
SELECT file_ord, CASE WHEN length > 44 THEN round((length - 44) / CASE WHEN file_ord % 2 = 0 THEN 96000 ELSE 32000 END, 9) END AS duration_s FROM v_files""", ("v_files",))
def s11(t):
    return rv.wav_audit(wavs(t)).select("file_ord", F.round("duration_s", 9).alias("duration_s"))


@query("a9_index_gaps", """
SELECT session_id, CAST(i AS BIGINT) AS missing FROM (SELECT session_id, min(idx) AS lo, max(idx) AS hi FROM r_completed GROUP BY session_id), unnest(range(lo, hi + 1)) u(i)
WHERE (session_id, i) NOT IN (SELECT (session_id, CAST(idx AS BIGINT)) FROM r_completed)""", ("r_completed",))
def a9(t):
    return rv.index_gaps(completed(t), ["session_id"])


@query("o6_index_difference", """
SELECT session_id, idx FROM r_completed EXCEPT SELECT session_id, idx FROM r_inventory WHERE has_system""", ("r_inventory", "r_completed"))
def o6(t):
    return completed(t).exceptAll(rv.chunk_inventory(t.files).where("has_system").select("session_id", "idx"))


define("r_orphans", ("r_inventory", "r_completed"), """
SELECT session_id, idx, created FROM r_inventory WHERE has_system AND (session_id, idx) NOT IN (SELECT (session_id, idx) FROM r_completed)""")


def orphaned(t):
    return rv.orphans(rv.chunk_inventory(t.files).where("has_system"), completed(t))


@query("j16_orphan_chunks", "SELECT session_id, idx FROM r_orphans", ("r_orphans",))
def j16(t):
    return orphaned(t).select("session_id", "idx")


@query("j17_recoverable_sessions", """
SELECT 'm' || c_custkey AS session_id FROM customer WHERE 'm' || c_custkey IN (SELECT session_id FROM r_completed UNION SELECT session_id FROM r_orphans)""",
       ("r_orphans", "r_completed"))
def j17(t):
    return rv.recoverable(sessions(t).select("session_id"), completed(t), orphaned(t))


@query("j18_mic_pairs", """
SELECT session_id, idx, CASE WHEN has_mic THEN session_id || '-' || idx || '_mic.wav' END AS mic_file, has_mic AS is_dual_stream FROM r_inventory WHERE has_system""", ("r_inventory",))
def j18(t):
    return rv.paired(t.files)


@query("p27_nonempty_audio", """
SELECT f.file_ord FROM r_files f LEFT JOIN r_inventory i ON i.session_id = f.session_id AND i.idx = f.idx AND i.has_mic
WHERE NOT f.is_mic AND (f.length > 44 OR i.idx IS NOT NULL)""", ("r_files", "r_inventory"))
def p27(t):
    files = rv.chunk_files(t.files).where("NOT is_mic")
    mics = rv.chunk_inventory(t.files).where("has_mic").select("session_id", "idx", F.lit("mic").alias("mic_file"))
    return rv.with_audio(files.join(mics, ["session_id", "idx"], "left")).select("file_ord")


@query("a10_next_index", """
SELECT s.session_id, CAST(coalesce(u.top + 1, 0) AS INT) AS next_free, CAST(greatest(coalesce(u.top + 1, 0), s.sentinel_index + 1) AS INT) AS safe_restart
FROM (SELECT 'm' || c_custkey AS session_id, c_nationkey % 9 AS sentinel_index FROM customer) s
LEFT JOIN (SELECT session_id, max(idx) AS top FROM (SELECT session_id, idx FROM r_completed UNION ALL SELECT session_id, idx FROM r_inventory WHERE has_system) GROUP BY session_id) u USING (session_id)""",
       ("r_inventory", "r_completed"))
def a10(t):
    return rv.next_free_index(sessions(t), completed(t), rv.chunk_inventory(t.files).where("has_system"))


@query("a11_meeting_start", """
SELECT s.session_id, epoch_us(coalesce(s.meeting_start, o.c, TIMESTAMP '2024-06-01 00:00:00')) AS start_us
FROM (SELECT 'm' || c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS meeting_start FROM customer) s
LEFT JOIN (SELECT session_id, min(created) AS c FROM r_orphans GROUP BY session_id) o USING (session_id)""", ("r_orphans",))
def a11(t):
    known = F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    s = t.raw("customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("session_id"), known.alias("meeting_start"))
    out = rv.meeting_starts(s, orphaned(t), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("session_id", F.unix_micros("meeting_start").alias("start_us"))


@query("w20_recovery_names", """
SELECT session_id, idx AS orphan_index, idx + 1 AS recovery_index, session_id || '-' || idx AS orphan_name, session_id || '-' || (idx + 1) AS recovery_name FROM r_orphans""", ("r_orphans",))
def w20(t):
    return orphaned(t).select("session_id", rv.recovery_names(F.col("session_id"), F.col("idx")).alias("p")).select("session_id", "p.*")


@query("a17_usage", "SELECT session_id, CAST(sum(length) AS BIGINT) AS bytes FROM r_files GROUP BY session_id", ("r_files",))
def a17(t):
    return rv.usage_bytes(rv.chunk_files(t.files), ["session_id"])


@query("a24_quota", """
SELECT session_id, CAST(sum(length) AS BIGINT) AS bytes, CAST((c * 64 * 1000 // 8) * 3600 AS BIGINT) AS quota, sum(length) > (c * 64 * 1000 // 8) * 3600 AS over_quota
FROM (SELECT *, CAST(regexp_extract(session_id, '(\\d+)$', 1) AS BIGINT) % 3 AS c FROM r_files) GROUP BY session_id, c""", ("r_files",))
def a24(t):
    u = rv.usage_bytes(rv.chunk_files(t.files), ["session_id"])
    hours = F.regexp_extract("session_id", r"(\d+)$", 1).cast("bigint") % 3
    return u.select("session_id", "bytes", rv.quota_bytes(hours, F.lit(64)).alias("quota")).withColumn("over_quota", F.col("bytes") > F.col("quota"))


@query("w11_evictions", """
SELECT file_ord FROM (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY session_id ORDER BY modified, file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r_files WHERE file_ord % 9 <> 0) f
JOIN (SELECT session_id, sum(length) AS total FROM r_files GROUP BY session_id) t USING (session_id) WHERE total - before > 1500000""", ("r_files",))
def w11(t):
    f = rv.chunk_files(t.files).withColumn("protected", F.col("file_ord") % 9 == 0)
    return rv.evictions(f, ["session_id"], F.lit(1500000), ["modified", "file_ord"]).select("file_ord")


define("r_durations", ("v_chunks",), """
SELECT meeting_id, chunk_index, CASE WHEN (meeting_id + chunk_index) % 5 = 3 THEN NULL ELSE CAST(40 AS DOUBLE) END AS probed_s, last_end FROM v_chunks""")


def durations(t):
    probed = F.when((F.col("meeting_id") + F.col("chunk_index")) % 5 != 3, _d(40))
    return t.chunks.select("meeting_id", "chunk_index", probed.alias("probed_s"), "last_end")


@query("w1_start_offsets", """
SELECT meeting_id, chunk_index, coalesce(sum(coalesce(probed_s, last_end, 1800)) OVER (PARTITION BY meeting_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS offset_s
FROM r_durations""", ("r_durations",))
def w1(t):
    d = durations(t).withColumn("duration_s", rv.segment_durations(F.col("probed_s"), F.col("last_end")))
    return rv.start_offsets(d, ["meeting_id"], "chunk_index", "duration_s").select("meeting_id", "chunk_index", "offset_s")


define("r_located", ("v_segments", "r_durations"), """
SELECT s.meeting_id, s.seg_ord, s.source, c.chunk_index, s.a - c.off AS local_start, least(s.b - c.off, c.probed_s, s.a - c.off + 15) AS local_end
FROM (SELECT *, chunk_index * 40 + start_s AS a, chunk_index * 40 + end_s AS b FROM v_segments) s
JOIN (SELECT *, coalesce(sum(coalesce(probed_s, 0)) OVER w, 0) AS off, bool_and(coalesce(probed_s > 0, FALSE)) OVER (PARTITION BY meeting_id ORDER BY chunk_index) AS anchored
      FROM r_durations WINDOW w AS (PARTITION BY meeting_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) c
  ON c.meeting_id = s.meeting_id AND c.anchored AND c.off <= s.a AND s.a < c.off + c.probed_s
WHERE s.b > s.a AND least(s.b - c.off, c.probed_s, s.a - c.off + 15) > s.a - c.off""")


def _starts():
    from .echo import _starts as s
    return s()


def located(t):
    rows = shifted(t.segments, *_starts()).select("meeting_id", "seg_ord", "source", F.col("elapsed").alias("start_s"), F.col("elapsed_end").alias("end_s"))
    chunks = rv.start_offsets(durations(t).withColumnRenamed("probed_s", "duration_s"), ["meeting_id"], "chunk_index", "duration_s")
    return rv.located(rows, chunks, ["seg_ord", "source"])


@query("j14_located", "SELECT meeting_id, seg_ord, chunk_index, local_start, local_end FROM r_located", ("r_located",))
def j14(t):
    return located(t).select("meeting_id", "seg_ord", "chunk_index", "local_start", "local_end")


@query("j15_playable_samples", """
SELECT l.meeting_id, l.seg_ord, 'm' || l.meeting_id || '-' || l.chunk_index || CASE WHEN (l.meeting_id + l.chunk_index) % 2 = 0 THEN '.m4a' ELSE '.wav' END AS path, l.source = 'local' AS is_local
FROM r_located l WHERE (l.meeting_id + l.chunk_index) % 7 <> 0 AND (l.source <> 'local' OR (l.meeting_id + l.chunk_index) % 2 = 0)""", ("r_located",))
def j15(t):
    n = F.col("meeting_id") + F.col("chunk_index")
    files = t.chunks.where((F.col("meeting_id") + F.col("chunk_index")) % 7 != 0).select("meeting_id", "chunk_index", F.concat(
        F.lit("m"), F.col("meeting_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string"), F.when(n % 2 == 0, ".m4a").otherwise(".wav")).alias("path"))
    return rv.playable(located(t), files).select("meeting_id", "seg_ord", "path", (F.col("source") == "local").alias("is_local"))


define("r_flagged", ("r_tagged",), """
SELECT a.*, NOT EXISTS (SELECT 1 FROM r_tagged b WHERE b.meeting_id = a.meeting_id AND b.end_s > b.start_s AND b.speaker <> a.speaker
  AND least(a.chunk_index * 40 + a.end_s, b.chunk_index * 40 + b.end_s) - greatest(a.chunk_index * 40 + a.start_s, b.chunk_index * 40 + b.start_s) > 0.3) AS clean
FROM r_tagged a WHERE a.end_s > a.start_s""")


def timeline(t):
    s = shifted(tagged(t), *_starts())
    return s.select("meeting_id", "seg_ord", "speaker", F.col("elapsed").alias("start_s"), F.col("elapsed_end").alias("end_s"), "text")


@query("j13_clean_samples", "SELECT meeting_id, seg_ord, clean FROM r_flagged", ("r_flagged",))
def j13(t):
    return dc.clean_flags(timeline(t), ["seg_ord"]).select("meeting_id", "seg_ord", "clean")


RANKED = """row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY clean DESC, end_s - start_s DESC, seg_ord)"""


@query("w8_ranked_samples", f"SELECT meeting_id, speaker, seg_ord, CAST({RANKED} AS INT) AS rank FROM r_flagged", ("r_flagged",))
def w8(t):
    return dc.ranked_samples(dc.clean_flags(timeline(t), ["seg_ord"]), ["seg_ord"]).select("meeting_id", "speaker", "seg_ord", "rank")


@query("o3_best_samples", f"SELECT meeting_id, speaker, seg_ord, CAST({RANKED} AS INT) AS rank FROM r_flagged QUALIFY {RANKED} <= 2", ("r_flagged",))
def o3(t):
    return dc.ranked_samples(dc.clean_flags(timeline(t), ["seg_ord"]), ["seg_ord"], k=2).select("meeting_id", "speaker", "seg_ord", "rank")


@query("j27_verified_archives", """
SELECT file_ord, ok AS verified, CASE WHEN ok THEN replace(file_name, '.wav', '.m4a') ELSE file_name END AS path FROM (
  SELECT *, coalesce(file_ord % 6 <> 0 AND length - 44 > 0 AND file_ord % 13 <> 0 AND abs((file_ord % 4) * 0.1) <= 0.25, FALSE) AS ok FROM v_files)""", ("v_files",))
def j27(t):
    f = t.files
    payload = (F.col("length") - 44).cast("bigint")
    seconds = payload / F.lit(32000.0)
    sources = f.select("file_ord", F.col("file_name").alias("source_path"), seconds.alias("source_s"))
    archives = f.where("file_ord % 6 <> 0").select(
        "file_ord", F.replace("file_name", F.lit(".wav"), F.lit(".m4a")).alias("archive_path"), payload.alias("archive_bytes"),
        (F.col("file_ord") % 13 != 0).alias("has_track"), (seconds + (F.col("file_ord") % 4) * 0.1).alias("archive_s"))
    return rv.verified_archives(archives, sources, ["file_ord"])
