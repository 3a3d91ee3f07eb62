"""Capture diagnostics (JSON lines), audio files and their headers."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .. import params
from ..operators.monitors import event_json
from ..operators.recovery import wav_audit
from ..schemas import EVENT

READERS = 16       # headers that a task asks for at once: their cost is the waiting


def write_events(events: DataFrame, path: str, detail: str | None = None) -> None:
    events.select(event_json(F.col(detail) if detail else None).alias("value")).write.mode("overwrite").text(path)


def _decoded(raw: DataFrame) -> DataFrame:
    """Undecodable lines give nothing."""
    good = raw.where("_corrupt_record IS NULL AND timestamp IS NOT NULL AND kind IS NOT NULL")
    return good.select(F.col("timestamp").alias("ts"), "origin", "kind", "severity", "detail")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark.read.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark.readStream.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def audio_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Inventory without reading any content: the scan is pruned to the file attributes. It passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"))


def _first_bytes(paths: list[str], size: int) -> Iterator[bytes | None]:
    """The first ``size`` bytes of each file, and no more of it; nothing for a file that is gone by now."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    stores: dict[str, FileSystem] = {}

    def opened(path: str):
        scheme, _, rest = path.partition(":")
        if not rest or scheme == "file":
            return stores.setdefault("file", LocalFileSystem()), "/" + (rest or path).lstrip("/")
        host, _, name = rest.removeprefix("//").partition("/")
        root = f"{scheme}://{host}"
        if root not in stores:
            stores[root] = FileSystem.from_uri(root + "/")[0]
        return stores[root], f"{host}/{name}" if scheme.startswith(("s3", "gs")) else f"/{name}"

    def read(place) -> bytes | None:
        store, name = place
        try:
            with store.open_input_file(name) as file:
                return file.read_at(size, 0)
        except FileNotFoundError:
            return None

    with ThreadPoolExecutor(READERS) as pool:
        yield from pool.map(read, [opened(p) for p in paths])


def with_headers(files: DataFrame, size: int = params.WAV_HEADER_BYTES) -> DataFrame:
    """Adds ``content``: the first ``size`` bytes of the file at ``path``, read by range in the tasks that hold the inventory."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = list(_first_bytes(batch.column("path").to_pylist(), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def audited_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """The audit of every file below ``path``; of a long recording only the header is read."""
    return wav_audit(with_headers(audio_files(spark, path, pattern).select("path", "length")))
