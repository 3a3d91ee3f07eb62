"""Word error rates, speed matrices and telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from ..functions import text as tx
from ..functions.timing import real_time_factor


def with_tokens(pairs: DataFrame) -> DataFrame:
    """Adds ref and hyp token arrays: words, or characters where the reference is CJK."""
    norm = pairs.withColumn("__r", tx.normalize_for_wer(F.col("reference"))).withColumn("__h", tx.normalize_for_wer(F.col("hypothesis")))
    cjk = tx.is_cjk(F.col("__r"))
    return (norm.withColumn("ref", tx.wer_tokens(F.col("__r"), cjk)).withColumn("hyp", tx.wer_tokens(F.col("__h"), cjk))
            .drop("__r", "__h"))


def rate(distance: Column) -> Column:
    n, m = F.size("ref"), F.size("hyp")
    return (F.when((n == 0) & (m == 0), 0.0).when((n == 0) | (m == 0), 1.0)
            .otherwise(F.try_divide(distance.cast("double"), n.cast("double"))))


def _distances(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    import numpy as np

    def banded(x, y, band: int) -> int:
        """The distance if it is at most ``band``, else something larger: cells off the diagonal by more are left out."""
        far = len(x) + len(y) + 1
        steps = np.arange(2 * band + 1)
        other = np.concatenate([np.full(band, -1), y, np.full(band + 1 + max(0, len(x) - len(y)), -1)])
        row = np.where(steps >= band, steps - band, far)
        row[steps - band > len(y)] = far
        for i, token in enumerate(x, 1):
            column = i - band + steps
            # Best of substitution and deletion; insertions are a running minimum along the row.
            best = np.minimum(np.append(row[1:], far) + 1, row + (other[i - 1:i + 2 * band] != token))
            best[column == 0] = i
            best[(column < 0) | (column > len(y))] = far
            row = np.minimum.accumulate(best - steps) + steps
            row[column < 0] = far
        return int(row[len(y) - len(x) + band])

    def one(a, b) -> int:
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(t, len(ids)) for t in a], dtype=np.int64)
        y = np.array([ids.setdefault(t, len(ids)) for t in b], dtype=np.int64)
        n = min(len(x), len(y))
        head = int(np.argmin(np.append(x[:n] == y[:n], False)))
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        tail = int(np.argmin(np.append(x[::-1][:n] == y[::-1][:n], False)))
        x, y = x[:len(x) - tail], y[:len(y) - tail]
        if not len(x) or not len(y):
            return len(x) + len(y)
        # No fewer edits than tokens that one side has beyond the other; no more than places that differ.
        count = [np.bincount(side, minlength=len(ids)) for side in (x, y)]
        least = max(len(x), len(y)) - int(np.minimum(*count).sum())
        if len(x) == len(y) and int((x != y).sum()) == least:
            return least
        band = max(8, abs(len(x) - len(y)), least)
        while True:
            band = min(band, max(len(x), len(y)))
            found = banded(x, y, band)
            if found <= band or band == max(len(x), len(y)):
                return found
            band *= 2

    return pd.Series([one(a, b) if a is not None and b is not None else 0 for a, b in zip(ref, hyp)], dtype="int64")


def long_distance() -> Column:
    """Edit distance of two token arrays, a batch of pairs at a time; exact, in a band that doubles until the distance fits."""
    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, hyp in parts:
            yield _distances(ref, hyp)

    return F.pandas_udf(batches, "bigint")(F.col("ref"), F.col("hyp"))


def word_error_rates(pairs: DataFrame) -> DataFrame:
    """Adds wer. Rows with an error or without text are not scored and get null."""
    scorable = F.col("error").isNull() & (F.col("hypothesis") != "") if "error" in pairs.columns else F.col("hypothesis") != ""
    # A Python function runs for every row, whatever stands around it: rows that are not scored bring it no tokens.
    tokens = with_tokens(pairs).withColumns({c: F.when(scorable, F.col(c)) for c in ("ref", "hyp")})
    done = tokens.withColumn("wer", F.when(scorable, rate(long_distance())))
    return done.drop("ref", "hyp")


def short_word_error_rates(pairs: DataFrame) -> DataFrame:
    """The same without leaving the JVM, over the full table: for pairs of sentences."""
    tokens = with_tokens(pairs)
    return tokens.withColumn("wer", rate(tx.edit_distance(F.col("ref"), F.col("hyp")))).drop("ref", "hyp")


def file_language(file_name: Column) -> Column:
    code = F.lower(F.substring(file_name, 1, 2))
    return F.when(code.isin(*params.FILE_LANGUAGES), code).otherwise("en")


def supports(engine: Column, language: Column) -> Column:
    ok = F.lit(True)
    for name, languages in params.ENGINE_LANGUAGES.items():
        ok = ok & ((engine != name) | language.isin(*languages))
    return ok


def scored(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results joined to their reference text by file name, with wer, rtf and language."""
    joined = results.join(truth, "file_name")
    out = word_error_rates(joined)
    return out.withColumn("rtf", real_time_factor(F.col("audio_s"), F.col("wall_s"))).withColumn(
        "language", file_language(F.col("file_name")))


def by_language(scored_rows: DataFrame, engines: list[str]) -> DataFrame:
    return scored_rows.groupBy("language").pivot("engine", engines).agg(F.avg("wer"))


def by_file(scored_rows: DataFrame, engines: list[str]) -> DataFrame:
    return scored_rows.groupBy("file_name", "language").pivot("engine", engines).agg(
        F.first("wer").alias("wer"), F.first("rtf").alias("rtf"))


def _tenths(value: Column, unit: str) -> Column:
    """One decimal, a tie to the even digit; a dash for nothing."""
    return F.when(value.isNotNull(), F.format_string(f"%.1f{unit}", F.rint(value * 10) / 10)).otherwise("-")


def matrix_report(scored_rows: DataFrame, engines: list[str], date: str) -> DataFrame:
    """The benchmark report in Markdown: section, name and value; by (section, name) its lines are in order.

    A row per file with error rate and speed of each engine: ``ERR`` where its run failed, dashes where it has none;
    then the mean error rate of each language over the runs that have one.
    """
    spark = scored_rows.sparkSession
    cell = F.when(F.col("error").isNotNull(), "ERR | -").otherwise(
        F.concat(_tenths(F.col("wer") * 100, "%%"), F.lit(" | "), _tenths(F.col("rtf"), "x")))
    table_row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")
    files = scored_rows.withColumn("cell", cell).groupBy("file_name", "language").pivot("engine", engines).agg(F.min("cell"))
    body = files.select(F.lit(1).alias("section"), F.col("file_name").alias("name"),
                        table_row("file_name", "language", *[F.coalesce(F.col(f"`{e}`"), F.lit("- | -")) for e in engines]))
    means = by_language(scored_rows, engines).select(
        F.lit(3).alias("section"), F.col("language").alias("name"), table_row("language", *[_tenths(F.col(f"`{e}`") * 100, "%%") for e in engines]))
    top = ["# ASR Engine Benchmark Matrix", "", f"Date: {date}", "", "| File | Lang |" + "".join(f" {e} WER | {e} RTF |" for e in engines),
           "|------|------|" + "---:|---:|" * len(engines)]
    between = ["", "## Average by Language", "", "| Language |" + "".join(f" {e} WER |" for e in engines), "|----------|" + "---:|" * len(engines)]
    frame = spark.createDataFrame([(section, f"{k:02d}", line) for section, lines in ((0, top), (2, between)) for k, line in enumerate(lines)],
                                  "section int, name string, value string")
    return frame.unionByName(body).unionByName(means)


def sweep(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Speakers and segments per configuration. Distinct speakers are counted from the per-speaker rows."""
    per_speaker = segments.groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"))
    return per_speaker.groupBy(*keys).agg(F.count(F.lit(1)).alias("speakers"), F.sum("n").alias("segments"))
