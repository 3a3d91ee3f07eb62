"""Side inputs: telemetry, ground truth, external diarizers, token ratios, manifests, samples, result matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ratios import stored_ratios
from ..schemas import DIARIZER, MANIFEST, TELEMETRY


def read_telemetry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Samples as numbers; a cell that is no number is null, so it is skipped in that column only."""
    columns = TELEMETRY[kind]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast("double").alias(c) for c in columns])


TRUTH_ENTRY = "array<struct<file: string, text: string>>"


def ground_truth(body: DataFrame, column: str = "value") -> DataFrame:
    """``{language: [{file, text}]}`` documents as rows; bare strings are informational and skipped."""
    groups = body.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("language", "list"))
    rows = groups.where(F.col("list").startswith("[")).select("language", F.explode(F.from_json("list", TRUTH_ENTRY)).alias("e"))
    return rows.select("language", F.col("e.file").alias("file_name"), F.col("e.text").alias("reference")).where(
        "file_name IS NOT NULL AND reference IS NOT NULL")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(spark.read.option("wholetext", True).text(path))


def read_diarizer(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    raw = spark.read.schema(DIARIZER).option("multiLine", multi_line).json(path).select(F.col("_metadata.file_path").alias("file"), "segments")
    return raw.select("file", F.posexplode("segments").alias("turn_ord", "s")).select(
        "file", "turn_ord", F.col("s.start").alias("t_start"), F.col("s.end").alias("t_end"), "s.speaker")


def ratio_rows(body: DataFrame, column: str = "value") -> DataFrame:
    """model, ratio, is_seed of stored ratio tables, old or new."""
    entries = body.select(F.explode(stored_ratios(F.col(column))).alias("model", "e"))
    return entries.select("model", F.col("e.ratio").alias("ratio"), F.col("e.isSeed").alias("is_seed"))


def ratio_json(model: Column, ratio: Column, is_seed: Column) -> Column:
    return F.to_json(F.create_map(model, F.struct(ratio.alias("ratio"), is_seed.alias("isSeed"))))


def write_ratios(ratios: DataFrame, path: str) -> None:
    ratios.select(ratio_json(F.col("model"), F.col("ratio"), F.col("is_seed")).alias("value")).write.mode("overwrite").text(path)


def read_ratios(spark: SparkSession, path: str) -> DataFrame:
    return ratio_rows(spark.read.text(path))


def write_manifests(files: DataFrame, path: str) -> None:
    """``files(repo, commit_sha, relative_path, size, sha256)``: one line per file, readable as one-file manifests."""
    entry = F.struct(F.col("relative_path").alias("relativePath"), "size", "sha256")
    files.select(F.to_json(F.struct("repo", "commit_sha", F.array(entry).alias("files"))).alias("value")).write.mode("overwrite").text(path)


def read_manifests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    raw = spark.read.schema(MANIFEST).option("multiLine", multi_line).json(path)
    return raw.select("repo", "commit_sha", F.explode("files").alias("f")).select(
        "repo", "commit_sha", F.col("f.relativePath").alias("relative_path"), "f.size", "f.sha256")


def sample_table(spark: SparkSession, path: str, columns: list[str], rows: int) -> DataFrame:
    """The first ``rows`` rows of a Parquet file, reading only ``columns``."""
    return spark.read.parquet(path).select(*columns).limit(rows)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluation runs; failed runs stay as rows with their error."""
    return spark.read.schema("file_name string, engine string, hypothesis string, error string, wall_s double, audio_s double").parquet(path)
