"""Recording file names: ``<session>-<index>.wav`` and ``<session>-<index>_mic.wav``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import sanitize_filename

CHUNK_FILE = r"^(.*)-(\d+)(_mic)?\.wav$"


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(_mic)?\.wav$", "")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"-\d+$", "")


def segment_name(name: Column, index: Column) -> Column:
    return F.concat(base_name(name), F.lit("-"), index.cast("string"))


def session_base(started: Column, session_name: Column) -> Column:
    clean = sanitize_filename(session_name)
    return F.concat(F.date_format(started, "HHmmss"), F.when(clean == "", "").otherwise(F.concat(F.lit("-"), clean)))


def session_file(started: Column, session_name: Column) -> Column:
    return F.concat(session_base(started, session_name), F.lit("-0"))


def session_of(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, CHUNK_FILE, 1), F.lit(""))


def index_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, CHUNK_FILE, 2).try_cast("int")


def is_mic(file_name: Column) -> Column:
    return file_name.endswith("_mic.wav")
