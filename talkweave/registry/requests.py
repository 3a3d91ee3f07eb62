"""Summary requests and lookups: P16-P21, U6, S16, S17, J19, J20, J22-J24."""

from pyspark.sql import functions as F

from ..functions import text as tx, usage as us
from ..operators import directory as dr, ratios as ra
from ..session import scratch_dir
from ..sources import reference as rf
from .base import query
from .tables import _d, define


@query("p16_context_fit", """
SELECT call_ord, needed, CASE WHEN loaded >= needed THEN NULL ELSE least(needed, 32768) END AS request FROM (
  SELECT *, e + (e * 10) // 100 + 2048 AS needed FROM (SELECT call_ord, input_tokens AS e, CASE WHEN call_ord % 3 = 0 THEN NULL ELSE call_ord * 7 % 20000 END AS loaded FROM v_usage))""", ("v_usage",))
def p16(t):
    u = t.usage
    needed = us.needed_context(F.col("input_tokens"))
    loaded = F.when(F.col("call_ord") % 3 != 0, F.col("call_ord") * 7 % 20000)
    return u.select("call_ord", needed.alias("needed"), us.requested_context(needed, loaded).alias("request"))


@query("p17_truncated", """
SELECT call_ord, 8192 - input_tokens > 0 AND call_ord % 8200 >= 8192 - input_tokens - 5 AS truncated FROM v_usage""", ("v_usage",))
def p17(t):
    return t.usage.select("call_ord", us.is_truncated(F.lit(8192), F.col("input_tokens"), F.col("call_ord") % 8200).alias("truncated"))


@query("p18_overflow_tokens", """
SELECT call_ord, CASE WHEN call_ord % 2 = 0 THEN input_tokens END AS tokens FROM v_usage""", ("v_usage",))
def p18(t):
    text = F.when(F.col("call_ord") % 2 == 0, F.concat(F.lit("failed: n_keep:  "), F.col("input_tokens").cast("string"), F.lit(" >= n_ctx: 10240"))).otherwise("n_keep: ?")
    return t.usage.select("call_ord", us.overflow_tokens(text).alias("tokens"))


@query("p19_responses", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'model crashed' WHEN 3 THEN 'empty response' END AS error, CASE WHEN doc_id % 4 IN (1, 2) THEN text END AS content,
       CASE WHEN doc_id % 4 = 1 THEN n_chars END AS input_tokens, CASE WHEN doc_id % 4 = 1 THEN 7::BIGINT END AS output_tokens FROM documents""")
def p19(t):
    k = F.col("doc_id") % 4
    out = F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("...").alias("content")), F.struct(F.lit("message").alias("type"), F.col("text").alias("content"))).alias("output"),
                             F.struct(F.col("n_chars").alias("input_tokens"), F.lit(7).alias("total_output_tokens")).alias("stats")))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), F.struct(F.lit(3).alias("input_tokens")).alias("stats")))
    err = F.to_json(F.struct(F.struct(F.lit("model crashed").alias("message")).alias("error"), F.array(F.struct(F.lit("message").alias("type"), F.col("text").alias("content"))).alias("output")))
    body = F.when(k == 0, err).when(k == 1, out).when(k == 2, chat).otherwise('{"output": []}')
    return t.raw("documents").select("doc_id", us.parsed_response(body).alias("r")).select("doc_id", "r.*")


@query("p20_retry_delay", """
SELECT event_id, event_id % 5 IN (0, 1) AS retryable, CASE event_id % 4 WHEN 0 THEN least(event_id % 90, 60)::DOUBLE WHEN 1 THEN least(event_id % 100, 60)::DOUBLE ELSE least(pow(2.0, event_id % 8), 60) END AS delay_s FROM events""")
def p20(t):
    k, ts = F.col("event_id") % 4, F.date_trunc("second", F.col("ts").cast("timestamp"))
    until = F.date_format(F.timestamp_seconds(F.unix_seconds(ts) + F.col("event_id") % 100), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(k == 0, F.concat(F.lit(" "), (F.col("event_id") % 90).cast("string"))).when(k == 1, until).when(k == 2, "soon")
    status = F.element_at(F.array(*map(F.lit, (429, 503, 200, 500, 404))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.raw("events").select("event_id", us.is_retryable(status).alias("retryable"), us.retry_delay(F.col("event_id") % 8, header, ts, 1.0, 60.0).alias("delay_s"))


@query("p21_locale", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE lang WHEN 'en' THEN 'en-US' WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'es' THEN 'es-ES' WHEN 'pt' THEN 'pt-BR' WHEN 'it' THEN 'it-IT' WHEN 'ru' THEN 'ru-RU' WHEN 'zh' THEN 'zh-CN' WHEN 'ja' THEN 'ja-JP' ELSE lang END
  WHEN 1 THEN lower(lang) || '-GB' WHEN 2 THEN lower(lang) || '-Hant-TW' ELSE 'xx' END AS locale FROM documents""")
def p21(t):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.col("lang")).when(k == 1, F.concat(F.upper("lang"), F.lit("_gb"))).when(k == 2, F.concat("lang", F.lit("-hANT-tw"))).otherwise("xx")
    return t.raw("documents").select("doc_id", tx.resolve_locale(raw).alias("locale"))


define("r_calls", ("v_usage",), """
SELECT *, row_number() OVER (PARTITION BY model ORDER BY call_ord) AS k FROM (
  SELECT *, CASE WHEN kind = 'seed' THEN CASE WHEN q BETWEEN 1.5 AND 6 THEN q ELSE 3.0 END ELSE q END AS value FROM (SELECT *, CASE WHEN input_tokens <> 0 THEN input_chars::DOUBLE / input_tokens END AS q FROM v_usage)
  WHERE kind = 'seed' OR (kind = 'real' AND input_chars >= 2000 AND input_tokens > 10 AND q BETWEEN 1.5 AND 6) OR (kind = 'forced' AND input_chars > 0 AND input_tokens > 0 AND q BETWEEN 1.5 AND 6))""")


@query("u6_token_ratios", """
SELECT model, round(ratio, 6) AS ratio, is_seed FROM (
WITH RECURSIVE r AS (
  SELECT model, k, value AS ratio, kind = 'seed' AS is_seed FROM r_calls WHERE k = 1
  UNION ALL
  SELECT c.model, c.k, CASE WHEN c.kind = 'real' AND NOT r.is_seed THEN 0.3::DOUBLE * c.value + 0.7::DOUBLE * r.ratio ELSE c.value END, c.kind = 'seed' FROM r JOIN r_calls c ON c.model = r.model AND c.k = r.k + 1)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY k DESC) = 1)""", ("r_calls",))
def u6(t):
    return ra.final_ratios(t.usage).withColumn("ratio", F.round("ratio", 6))


@query("s16_ratio_table", """
SELECT c_name AS model, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE round(abs(c_acctbal), 2) END AS ratio, c_custkey % 3 = 0 AS is_seed FROM customer WHERE c_custkey % 3 <> 2""")
def s16(t):
    path = scratch_dir(t.spark, "ratios")
    value = F.round(F.abs("c_acctbal"), 2)
    legacy = F.to_json(F.create_map("c_name", value))
    body = F.when(F.col("c_custkey") % 3 == 0, legacy).when(F.col("c_custkey") % 3 == 1, rf.ratio_json(F.col("c_name"), value, F.lit(False))).otherwise("[broken")
    t.raw("customer").select(body.alias("value")).write.text(path)
    return rf.read_ratios(t.spark, path)


@query("s17_manifests", """
SELECT source AS repo, 'd' || doc_id AS relative_path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents""")
def s17(t):
    path = scratch_dir(t.spark, "manifests")
    rf.write_manifests(manifest(t), path)
    return rf.read_manifests(t.spark, path).select("repo", "relative_path", "size", "sha256")


def manifest(t):
    return t.raw("documents").select(F.col("source").alias("repo"), F.lit("c0ffee").alias("commit_sha"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"),
                                     F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))


@query("j22_manifest_check", """
SELECT 'd' || doc_id AS relative_path, CASE doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' WHEN 2 THEN CASE WHEN reverse(text) = text THEN 'ok' ELSE 'corrupt' END ELSE 'ok' END AS state FROM documents""")
def j22(t):
    k = F.col("doc_id") % 10
    content = F.when(k == 1, F.concat("text", F.lit("x"))).when(k == 2, F.reverse("text")).otherwise(F.col("text"))
    inv = t.raw("documents").where("doc_id % 10 <> 0").select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("relative_path"),
                                                             F.octet_length(content).cast("bigint").alias("size"), content.alias("content"))
    return dr.manifest_check(manifest(t), inv, ["repo", "relative_path"]).select("relative_path", "state")


@query("j23_update_status", """
SELECT c_name AS repo, CASE WHEN c_custkey % 5 = 0 THEN 'noBaseline' WHEN c_custkey % 5 = 1 THEN 'checkFailed' WHEN c_custkey % 2 = 0 THEN 'upToDate' ELSE 'updateAvailable' END AS status FROM customer""")
def j23(t):
    k = F.col("c_custkey")
    local = t.raw("customer").select(F.col("c_name").alias("repo"), F.when(k % 5 == 0, "").otherwise(F.sha1("c_name")).alias("commit_sha"))
    heads = t.raw("customer").where("c_custkey % 5 <> 1").select(F.col("c_name").alias("repo"), F.when(k % 2 == 0, F.sha1("c_name")).otherwise("new").alias("head_sha"))
    return dr.update_status(local, heads)


define("r_listed", (), """
SELECT p_partkey AS list_ord, 'model-' || p_partkey % 50 AS id, p_brand AS publisher, p_size % 2 = 0 AS loaded, p_size * 100 AS loaded_context FROM part""")


@query("j24_model_states", """
SELECT q.request, q.model, l.loaded, CAST(CASE WHEN l.loaded THEN l.loaded_context END AS INTEGER) AS loaded_context
FROM (SELECT p_partkey AS request, CASE WHEN p_partkey % 2 = 0 THEN 'model-' || p_partkey % 60 ELSE p_brand || '/model-' || p_partkey % 60 END AS model FROM part) q
LEFT JOIN (SELECT model, arg_min(loaded, list_ord) AS loaded, arg_min(loaded_context, list_ord) AS loaded_context FROM (
  SELECT id AS model, * FROM r_listed UNION ALL SELECT publisher || '/' || id, * FROM r_listed) GROUP BY model) l USING (model)""", ("r_listed",))
def j24(t):
    p = t.raw("part")
    name = lambda n: F.concat(F.lit("model-"), (F.col("p_partkey") % n).cast("string"))
    listed = p.select(F.col("p_partkey").alias("list_ord"), name(50).alias("id"), F.col("p_brand").alias("publisher"), (F.col("p_size") % 2 == 0).alias("loaded"), (F.col("p_size") * 100).alias("loaded_context"))
    asked = p.select(F.col("p_partkey").alias("request"), F.when(F.col("p_partkey") % 2 == 0, name(60)).otherwise(F.concat("p_brand", F.lit("/"), name(60))).alias("model"))
    return dr.model_states(asked, listed)


@query("j19_calendar_pick", """
SELECT m.owner, m.meeting, cal_id, running FROM (SELECT user_id % 15 AS owner, event_id AS meeting, ts + INTERVAL 7 MINUTE AS now FROM events) m
JOIN (SELECT c.*, e.user_id % 15 AS owner, starts_at AS s FROM v_calendar c JOIN events e ON e.event_id = c.cal_id WHERE NOT all_day AND NOT declined) c ON c.owner = m.owner
CROSS JOIN LATERAL (SELECT c.s <= m.now AND c.ends_at > m.now AS running)
WHERE running OR (c.s > m.now AND c.s <= m.now + INTERVAL 10 MINUTE)
QUALIFY row_number() OVER (PARTITION BY m.meeting ORDER BY running DESC, CASE WHEN running THEN epoch_us(c.s) ELSE -epoch_us(c.s) END DESC, cal_id) = 1""", ("v_calendar",))
def j19(t):
    e = t.raw("events")
    owner = (F.col("user_id") % 15).alias("owner")
    meetings = e.select(owner, F.col("event_id").alias("meeting"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 7 MINUTES")).alias("now"))
    cal = t.calendar.join(e.select(owner, F.col("event_id").alias("cal_id")), "cal_id")
    return dr.calendar_pick(meetings, cal, ["owner"], ["meeting"])


@query("j20_crash_class", """
SELECT i.host, i.interruption, CASE WHEN EXISTS (SELECT 1 FROM events r WHERE r.user_id % 15 = i.host AND r.event_type IN ('error', 'click') AND r.ts >= i.now - INTERVAL 120 SECOND AND r.ts <= i.now) THEN 'likelyCrash' ELSE 'transientBlip' END AS verdict
FROM (SELECT user_id % 15 AS host, event_id AS interruption, ts + INTERVAL 30 SECOND AS now FROM events) i""")
def j20(t):
    e = t.raw("events")
    host = (F.col("user_id") % 15).alias("host")
    kind = F.when(F.col("event_type") == "error", "Capture-Helper-").when(F.col("event_type") == "click", "JetsamEvent-").otherwise("Other-")
    reports = e.select(host, F.concat(kind, F.col("event_id").cast("string"), F.lit(".ips")).alias("report_name"), F.col("ts").cast("timestamp").alias("modified"))
    asked = e.select(host, F.col("event_id").alias("interruption"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 30 SECONDS")).alias("now"))
    return dr.crash_class(asked, reports, ["host"], ("capture-helper", "jetsamevent"), 120.0).select("host", "interruption", "verdict")
