"""Scalar functions and evaluation."""

import random

from pyspark.sql import functions as F

from talkweave.functions import text as tx, timing as tm, usage as us
from talkweave.operators import evaluation as ev


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_word_error_rates_match_the_table(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
    pairs = [(i, say(rng.randrange(0, 60)), say(rng.randrange(0, 60))) for i in range(60)]
    base = say(3000)
    pairs += [(90, base, base.replace("a b", "b a")), (91, base, "x " + base[400:]), (92, "", ""), (93, "", "a"), (94, "a b", "!"), (95, "你好世界", "你好，世 世")]
    df = spark.createDataFrame(pairs, "i int, reference string, hypothesis string").withColumn("hypothesis", F.when(F.col("hypothesis") == "", " ").otherwise(F.col("hypothesis")))
    got = {r.i: r.wer for r in ev.word_error_rates(df).collect()}
    for i, ref, hyp in pairs[:-4]:
        a, b = ref.split(), hyp.split()
        want = (0.0 if not b else 1.0) if not a else (1.0 if not b else distance(a, b) / len(a))
        assert abs(got[i] - want) < 1e-12, i
    assert (got[92], got[93], got[94]) == (0.0, 1.0, 1.0) and abs(got[95] - 1 / 4) < 1e-12
    short = {r.i: r.wer for r in ev.short_word_error_rates(df).collect()}
    assert set(short) == set(got) and all(abs(short[i] - got[i]) < 1e-12 for i in short)


def test_errors_and_blank_results_are_not_scored(spark):
    df = spark.createDataFrame([("a", "x y", "x y", None), ("b", "x y", "", None), ("c", "x y", "x", "timeout")], "n string, reference string, hypothesis string, error string")
    assert {r.n: r.wer for r in ev.word_error_rates(df).collect()} == {"a": 0.0, "b": None, "c": None}


def test_normalization_and_cjk(spark):
    assert one(spark, tx.normalize_for_wer(F.lit("Don't -- STOP,\tnow!"))) == "don't stop now"
    assert one(spark, tx.is_cjk(F.lit("日本 text"))) is False and one(spark, tx.is_cjk(F.lit("日本語です a"))) is True


def test_clocks(spark):
    assert one(spark, tm.srt_clock(F.lit(3661.9996))) == "01:01:01,999"
    assert one(spark, tm.clock(F.lit(3599.9))) == "00:59:59"
    assert [one(spark, tm.short_duration(F.lit(x))) for x in (59.0, 7500.0)] == ["0m", "2h 5m"]
    assert [one(spark, tm.timer(F.lit(x))) for x in (-4.0, 65.0, 3605.0)] == ["00:00", "01:05", "1:00:05"]


def test_labels_and_locales(spark):
    tag = lambda a, b: one(spark, tx.with_source_prefix(F.lit(a), F.lit(b)))
    assert [tag("Speaker 1", "local"), tag("Unknown", "remote"), tag("", "local"), tag("Remote Speaker 2", "remote"), tag("Speaker 1", "")] == [
        "Local Speaker 1", "Remote Unknown", "Local Unknown", "Remote Speaker 2", "Speaker 1"]
    assert [one(spark, tx.resolve_locale(F.lit(x))) for x in ("pt", "pt_pt", "ZH-hant-tw", " xx ", "EN")] == ["pt-BR", "pt-PT", "zh-Hant-TW", "xx", "en-US"]
    assert [one(spark, tx.trailing_index(F.lit(x))) for x in ("Speaker 12", "spk_3", "none")] == [12, 3, None]
    assert one(spark, tx.is_punctuation_only(F.lit(" ?! "))) and not one(spark, tx.is_punctuation_only(F.lit("👍"))) and not one(spark, tx.is_punctuation_only(F.lit(" ")))


def test_endpoints(spark):
    got = {e: tuple(one(spark, us.disclosure(F.lit(e)))) for e in ("http://localhost:1234/v1", "http://127.1.2.3", "http://127.0.0.256/", "https://api.example.org:443/x", "http://[::1]/", "nonsense", "http://127.0.0.1.evil.org")}
    assert got == {"http://localhost:1234/v1": ("local (localhost:1234)", False), "http://127.1.2.3": ("local (127.1.2.3)", False), "http://127.0.0.256/": ("remote (127.0.0.256)", True),
                   "https://api.example.org:443/x": ("remote (api.example.org)", True), "http://[::1]/": ("local (::1)", False), "nonsense": ("remote (unknown)", True),
                   "http://127.0.0.1.evil.org": ("remote (127.0.0.1.evil.org)", True)}


def test_budgets_and_retries(spark):
    assert one(spark, us.needed_context(F.lit(1005).cast("bigint"))) == 1005 + 100 + 2048
    assert one(spark, us.requested_context(F.lit(40000), F.lit(None).cast("bigint"))) == 32768
    assert one(spark, us.requested_context(F.lit(400), F.lit(400))) is None
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    delay = lambda n, h: one(spark, us.retry_delay(F.lit(n), F.lit(h).cast("string"), now, 1.0, 60.0))
    assert [delay(3, None), delay(9, None), delay(0, "5"), delay(0, "-1"), delay(0, "Wed, 21 Oct 2015 07:28:30 GMT"), delay(2, "later"), delay(0, "Wed, 21 Oct 2015 07:00:00 GMT")] == [8.0, 60.0, 5.0, 1.0, 30.0, 4.0, 0.0]
    assert [one(spark, us.is_truncated(F.lit(100), F.lit(50), F.lit(n))) for n in (44, 45)] == [False, True]


def test_many_replaced_words_of_long_texts_are_counted_fast():
    import time

    import pandas as pd
    from talkweave.operators import evaluation as ev
    a = [f"w{k * 7919 % 5003}" for k in range(20000)]
    b = ["da" if k % 5 == 0 else w for k, w in enumerate(a)]
    begun = time.perf_counter()
    assert ev._distances(pd.Series([a] * 6), pd.Series([b] * 6)).tolist() == [4000] * 6 and time.perf_counter() - begun < 5
