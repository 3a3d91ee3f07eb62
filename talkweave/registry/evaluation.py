"""Evaluation: F14, U3, A12-A15, J21, P22, P23, W17, S12-S15, S18, S20."""

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..session import scratch_dir, written
from ..sources import reference as rf
from .base import query
from .scalars import duck_norm
from .tables import define

ENGINES = ["fluid", "other"]


def results(t):
    e = t.eval_pairs
    bad = F.length("reference") % 17 == 0
    return e.select("file_name", "engine", "hypothesis", F.when(bad, "timeout").alias("error"), "wall_s", "audio_s")


def truth(t):
    return t.eval_pairs.select("file_name", "reference").distinct()


@query("p22_file_language", """
SELECT file_name, engine, lang AS language, NOT (engine = 'fluid' AND lang NOT IN ('bg','cs','da','de','el','en','es','et','fi','fr','hr','hu','it','lt','lv','nl','no','pl','pt','ro','sk','sl','sv','uk')) AS supported
FROM (SELECT *, CASE WHEN substr(file_name, 1, 2) IN ('en', 'fr', 'pt', 'es') THEN substr(file_name, 1, 2) ELSE 'en' END AS lang FROM v_eval)""", ("v_eval",))
def p22(t):
    lang = ev.file_language(F.col("file_name"))
    return t.eval_pairs.select("file_name", "engine", lang.alias("language"), ev.supports(F.col("engine"), lang).alias("supported"))


@query("p23_scorable", "SELECT file_name, engine FROM v_eval WHERE length(reference) % 17 <> 0 AND hypothesis <> ''", ("v_eval",))
def p23(t):
    return results(t).where("error IS NULL AND hypothesis <> ''").select("file_name", "engine")


@query("j21_truth_joined", "SELECT file_name, engine, reference FROM v_eval", ("v_eval",))
def j21(t):
    return results(t).join(truth(t), "file_name").select("file_name", "engine", "reference")


# Edit distance by recursion over the table's rows, each row held as a list.
define("r_norm", ("v_eval",), f"""
SELECT file_name, engine, string_split({duck_norm('reference')}, ' ') AS r, string_split({duck_norm('hypothesis')}, ' ') AS h, length(reference) AS chars, audio_s / wall_s AS rtf FROM v_eval""")
define("r_wer", ("r_norm",), """
SELECT file_name, engine, chars, rtf, d / len(r) AS wer FROM (
WITH RECURSIVE dp AS (
  SELECT file_name, engine, chars, rtf, r, h, 0 AS i, list_transform(range(0, len(h) + 1), lambda x: x::BIGINT) AS row FROM r_norm
  UNION ALL
  SELECT file_name, engine, chars, rtf, r, h, i + 1, list_reduce(list_transform(range(1, len(h) + 1), lambda j: [least(row[j + 1] + 1, row[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END)]),
         lambda acc, x: list_append(acc, least(x[1], acc[-1] + 1)), [(row[1] + 1)::BIGINT])
  FROM dp WHERE i < len(r))
SELECT file_name, engine, chars, rtf, r, row[-1] AS d FROM dp WHERE i = len(r))""")


@query("f14_word_error_rate", "SELECT file_name, engine, round(wer, 6) AS wer FROM r_wer", ("r_wer",))
def f14(t):
    return ev.word_error_rates(t.eval_pairs).select("file_name", "engine", F.round("wer", 6).alias("wer"))


@query("u3_long_error_rate")
def u3(t):
    d = t.raw("documents").select("doc_id", F.col("text").alias("reference"), F.replace("text", F.lit(" de "), F.lit(" da ")).alias("hypothesis"))
    return ev.word_error_rates(d).select("doc_id", F.round("wer", 6).alias("wer"))


@query("f14_short_pairs", """
SELECT file_name, engine, round(wer, 6) AS wer FROM r_wer""", ("r_wer",))
def f14_short(t):
    return ev.short_word_error_rates(t.eval_pairs).select("file_name", "engine", F.round("wer", 6).alias("wer"))


define("r_scored", ("r_wer",), """
SELECT file_name, engine, rtf, substr(file_name, 1, 2) AS language, CASE WHEN chars % 17 = 0 THEN NULL ELSE wer END AS wer FROM r_wer""")


def scored(t):
    return ev.scored(results(t), truth(t))


@query("a12_wer_by_language", """
SELECT language, round(avg(wer) FILTER (WHERE engine = 'fluid'), 6) AS fluid, round(avg(wer) FILTER (WHERE engine = 'other'), 6) AS other FROM r_scored GROUP BY language""", ("r_scored",))
def a12(t):
    return ev.by_language(scored(t), ENGINES).select("language", *[F.round(e, 6).alias(e) for e in ENGINES])


@query("a13_file_matrix", """
SELECT file_name, language, round(max(wer) FILTER (WHERE engine = 'fluid'), 6) AS fluid_wer, round(max(rtf) FILTER (WHERE engine = 'fluid'), 6) AS fluid_rtf,
       round(max(wer) FILTER (WHERE engine = 'other'), 6) AS other_wer, round(max(rtf) FILTER (WHERE engine = 'other'), 6) AS other_rtf FROM r_scored GROUP BY ALL""", ("r_scored",))
def a13(t):
    m = ev.by_file(scored(t), ENGINES)
    return m.select("file_name", "language", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


TENTHS = "printf('%.1f', round_even({0} * 10, 0) / 10)"
RATE, SPEED, MEAN = TENTHS.format("(wer * 100)"), TENTHS.format("rtf"), TENTHS.format("(avg(wer) FILTER (WHERE engine = '{0}') * 100)")


@query("s18_matrix_sink", f"""
SELECT unnest(['# ASR Engine Benchmark Matrix', '', 'Date: 2024-01-01', '', '| File | Lang | fluid WER | fluid RTF | other WER | other RTF |', '|------|------|---:|---:|---:|---:|',
  '', '## Average by Language', '', '| Language | fluid WER | other WER |', '|----------|---:|---:|']) AS value
UNION ALL SELECT '| ' || file_name || ' | ' || language || ' | ' || coalesce(max(cell) FILTER (WHERE engine = 'fluid'), '- | -') || ' | ' || coalesce(max(cell) FILTER (WHERE engine = 'other'), '- | -') || ' |'
FROM (SELECT file_name, engine, substr(file_name, 1, 2) AS language, CASE WHEN chars % 17 = 0 THEN 'ERR | -' ELSE coalesce({RATE} || '%', '-') || ' | ' || {SPEED} || 'x' END AS cell FROM r_wer)
GROUP BY file_name, language
UNION ALL SELECT '| ' || language || ' | ' || coalesce({MEAN.format('fluid')} || '%', '-') || ' | ' || coalesce({MEAN.format('other')} || '%', '-') || ' |' FROM r_scored GROUP BY language""", ("r_scored", "r_wer"))
def s18(t):
    path = scratch_dir(t.spark, "matrix")
    ev.matrix_report(written(scored(t), "scored"), ENGINES, "2024-01-01").orderBy("section", "name").select("value").write.text(path)
    return t.spark.read.text(path)


@query("a14_sweep", """
SELECT CAST(seg_ord % 4 AS INTEGER) AS config, count(DISTINCT speaker) AS speakers, count(*) AS segments FROM r_tagged GROUP BY ALL""", ("r_tagged",))
def a14(t):
    from .echo import tagged
    return ev.sweep(tagged(t).withColumn("config", F.col("seg_ord") % 4), ["config"])


@query("a15_telemetry_summary", """
SELECT event_type, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type""")
def a15(t):
    from ..operators.aggregates import telemetry_summary
    s = telemetry_summary(t.raw("events"), "value", ["event_type"])
    return s.withColumn("avg", F.round("avg", 4))


@query("w17_sample_rows", """
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5""")
def w17(t):
    from pyspark.sql import Window
    w = Window.partitionBy("event_type").orderBy("event_id")
    return t.raw("events").select("event_type", "event_id", F.row_number().over(w).alias("k")).where("k <= 5").drop("k")


@query("s12_telemetry_scan", """
SELECT CAST(event_id AS DOUBLE) AS elapsed_s, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS cpu_power_mw, CAST(user_id AS DOUBLE) AS gpu_power_mw FROM events""")
def s12(t):
    path = scratch_dir(t.spark, "telemetry")
    cell = F.when(F.col("event_id") % 20 == 0, "n/a").otherwise(F.col("value").cast("string"))
    t.raw("events").select(F.col("event_id").alias("elapsed_s"), cell.alias("cpu_power_mw"), F.col("user_id").alias("gpu_power_mw"), F.lit("0").alias("ane_power_mw")).write.option("header", True).csv(path)
    return rf.read_telemetry(t.spark, path, "system").drop("ane_power_mw")


@query("s13_ground_truth", """
SELECT DISTINCT substr(file_name, 1, 2) AS language, file_name, reference FROM v_eval""", ("v_eval",))
def s13(t):
    path = scratch_dir(t.spark, "truth")
    entry = F.to_json(F.array(F.struct(F.col("file_name").alias("file"), F.col("reference").alias("text"))))
    body = F.concat(F.lit('{"note": "spoken", "'), F.substring("file_name", 1, 2), F.lit('": '), entry, F.lit("}"))
    truth(t).select(body.alias("value")).write.text(path)
    return rf.ground_truth(t.spark.read.text(path))


@query("s14_diarizer_scan", """
SELECT round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, speaker FROM v_turns""", ("v_turns",))
def s14(t):
    path = scratch_dir(t.spark, "diarizer")
    turn = F.struct(F.col("t_start").alias("start"), F.col("t_end").alias("end"), "speaker")
    docs = t.turns.groupBy("meeting_id", "chunk_index", "source").agg(F.collect_list(turn).alias("segments"))
    docs.select(F.to_json(F.struct("segments")).alias("value")).write.text(path)
    return rf.read_diarizer(t.spark, path, multi_line=False).select(F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "speaker")


@query("s15_pruned_sample", "SELECT count(*) AS n, bool_and(lang IS NOT NULL) AS complete FROM (SELECT doc_id, lang FROM documents LIMIT 50)")
def s15(t):
    s = rf.sample_table(t.spark, f"{t.root}/documents.parquet", ["doc_id", "lang"], 50)
    return s.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lang").isNotNull()).alias("complete"))


@query("s20_result_ingest", """
SELECT engine, count(*) AS runs, count(*) FILTER (WHERE length(reference) % 17 = 0) AS failed FROM v_eval GROUP BY engine""", ("v_eval",))
def s20(t):
    path = scratch_dir(t.spark, "results")
    results(t).write.parquet(path)
    return rf.read_results(t.spark, path).groupBy("engine").agg(F.count(F.lit(1)).alias("runs"), F.count("error").alias("failed"))
