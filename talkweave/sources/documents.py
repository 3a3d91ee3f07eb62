"""Transcript documents and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import trim_blank
from ..schemas import DOC_SEGMENT, DOCUMENT

PACK = 65536       # places of a meeting that stay together in a packed export


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per document: file, metadata, segments. Unreadable ones are left out."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), "metadata", "segments", "_corrupt_record").where(
        "_corrupt_record IS NULL AND segments IS NOT NULL").drop("_corrupt_record")


def sample_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows fit for speaker samples: complete, with text; a missing source counts as remote."""
    s = docs.select(*keys, F.posexplode("segments").alias("ord", "s")).select(
        *keys, "ord", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.speaker", trim_blank(F.col("s.text")).alias("text"),
        F.coalesce("s.source", F.lit("remote")).alias("source"))
    return s.where("speaker IS NOT NULL AND text IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND text <> ''")


def summary_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for a summary: everything, with empty defaults."""
    return filled(docs.select(*keys, F.posexplode("segments").alias("ord", "s")), [*keys, "ord"])


def filled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The fields of segments ``s``, with empty defaults."""
    zero, none = F.lit(0.0), F.lit("")
    return rows.select(
        *keys, F.coalesce("s.start", zero).alias("start"), F.coalesce("s.end", zero).alias("end"), F.coalesce("s.speaker", none).alias("speaker"),
        F.coalesce("s.text", none).alias("text"), F.coalesce("s.source", none).alias("source"))


def document_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as lines (meeting_id, place, value) -> a row per segment: meeting_id, metadata, s; and the damaged lines.

    No document is ever held whole. A damaged segment is missing from the rows; a damaged head leaves its meeting's rows
    with null metadata. Both are among the damaged lines.
    """
    opens, body = F.col("value").startswith('{"metadata":'), F.ltrim("value", F.lit(","))
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    one = StructType([*DOC_SEGMENT.fields, StructField("_corrupt_record", StringType())])
    kind = F.when(F.col("value") == "]}", "end").when(opens | (F.col("place") == 0), "head").otherwise("segment")
    parsed = lines.where("value <> ']}'").select(
        "meeting_id", "place", "value", kind.alias("kind"),
        F.when(kind == "head", F.from_json(F.concat("value", F.lit("]}")), DOCUMENT, strict)).alias("d"),
        F.when(kind == "segment", F.from_json(body, one, strict)).alias("s"))
    bad = F.col("d._corrupt_record").isNotNull() | F.col("s._corrupt_record").isNotNull() | (F.col("d").isNull() & F.col("s").isNull())
    head = parsed.where(~bad & (F.col("kind") == "head")).select("meeting_id", "d.metadata")
    rows = parsed.where(~bad & (F.col("kind") == "segment")).select("meeting_id", F.col("s").dropFields("_corrupt_record").alias("s"))
    return rows.join(head, "meeting_id", "left").select("meeting_id", "metadata", "s"), parsed.where(bad).select("meeting_id", "place", "value")


def read_document_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of documents that were written as a folder each."""
    lines = read_lines(spark, path).withColumn("place", F.when(F.col("value").startswith('{"metadata":'), 0).otherwise(1))
    return document_rows(lines)[0]


def write_lines(lines: DataFrame, path: str, key: str = "meeting_id") -> None:
    """Ordered text export for the few meetings that are handed out: a folder per meeting whose part files, in name order,
    are the file's content. Many meetings belong into :func:`write_packed`.

    Range partitioning by (meeting, place) keeps a long meeting spread over several sorted parts.
    """
    ranged = lines.repartitionByRange(key, "place").sortWithinPartitions(key, "place")
    ranged.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def read_lines(spark: SparkSession, path: str, key: str = "meeting_id") -> DataFrame:
    return spark.read.schema(f"value string, {key} bigint").text(path)


def write_packed(lines: DataFrame, path: str, key: str = "meeting_id") -> None:
    """All meetings' lines in as many files as there are tasks, however many meetings there are.

    A part holds many meetings, and a long one is spread by PACK places. Within a part lines lie in order, so that the
    files' own statistics are the index: a reader of one meeting skips all row groups but its own.
    """
    place = F.col("place").cast("bigint")
    dealt = lines.select(key, place.alias("place"), "value").repartition(key, F.floor(place / PACK))
    dealt.sortWithinPartitions(key, "place").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, key: str = "meeting_id") -> DataFrame:
    """Entries by meeting and place; an entry may span several lines of text."""
    return spark.read.schema(f"{key} bigint, place bigint, value string").parquet(path)


def text_of(packed: DataFrame) -> DataFrame:
    """The lines of packed entries as a text file has them: an entry is followed by one line break."""
    return packed.select(*[c for c in packed.columns if c != "value"], F.explode(F.split("value", "\n", -1)).alias("value"))


def hand_out(packed: DataFrame, ids: list[int], path: str, key: str = "meeting_id") -> None:
    """The files of the named meetings, from packed lines."""
    write_lines(packed.where(F.col(key).isin(ids)), path, key)
