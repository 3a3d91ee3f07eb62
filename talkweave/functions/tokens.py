"""Word arrays of recognised segments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_blank


def trusted_words(runs: Column, trimmed_text: Column) -> Column:
    """The runs as words if all are timed and rebuild the text exactly, else null."""
    timed = F.forall(runs, lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    rebuilt = trim_blank(F.array_join(F.transform(runs, lambda r: r["text"]), ""))
    return F.when((F.size(runs) > 0) & timed & (rebuilt == trimmed_text), runs)
