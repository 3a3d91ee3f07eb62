"""Removal of local segments that only repeat what a remote speaker said.

Gates run cheapest first: voice (a few rows per chunk), then time, then words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import params
from ..functions import text as tx, vectors as vc
from ..functions.timing import overlap_seconds
from .intervals import overlap_pairs


@dataclass(frozen=True)
class Thresholds:
    temporal: float = params.ECHO_TEMPORAL
    text: float = params.ECHO_TEXT
    embedding: float = params.ECHO_EMBEDDING


def base_dimension(voices: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest common divisor of the embedding lengths per key. Only distinct lengths are gathered."""
    sizes = voices.where(F.size("embedding") > 0).groupBy(*keys).agg(F.collect_set(F.size("embedding")).alias("sizes"))
    return sizes.select(*keys, vc.common_divisor(F.col("sizes")).alias("dim"))


def stacked(voices: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A voice's vectors of all chunks laid end to end, as a recovered recording stores them."""
    laid = F.array_sort(F.collect_list(F.struct(order, "embedding")))
    return voices.groupBy(*keys).agg(F.flatten(F.transform(laid, lambda v: v["embedding"])).alias("embedding"))


def centroids(voices: DataFrame, keys: list[str], order: str, dims: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each voice's vectors over all its chunks, by position: sums and counts are combined before they move, and no voice
    is laid end to end. ``dims`` has the width per ``by``; a voice whose length does not divide by it stays as it is."""
    along = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    size = F.size("embedding")
    placed = (voices.where(size > 0).join(dims.select(*by, F.col("dim").alias("__dim")), by, "left")
              .select(*keys, "embedding", "__dim", (F.sum(size).over(along) - size).alias("__from"), F.sum(size).over(whole).alias("__all")))
    divides = (F.col("__dim") > 0) & (F.col("__all") % F.nullif("__dim", F.lit(0)) == 0)
    width = F.when(F.coalesce(divides, F.lit(False)), F.col("__dim")).otherwise(F.col("__all"))
    cells = placed.select(*keys, width.alias("__width"), "__from", F.posexplode("embedding").alias("__at", "__x"))
    means = cells.groupBy(*keys, ((F.col("__from") + F.col("__at")) % F.col("__width")).alias("__at")).agg(F.avg(F.col("__x").cast("double")).cast("float").alias("__x"))
    rows = F.array_sort(F.collect_list(F.struct("__at", "__x")))
    return means.groupBy(*keys).agg(F.transform(rows, lambda c: c["__x"]).alias("embedding"))


def pooled(voices: DataFrame, keys: list[str], dim: int | None = None) -> DataFrame:
    """Each speaker's stacked vectors averaged into one."""
    if dim is not None:
        return voices.withColumn("embedding", vc.centroid(F.col("embedding"), F.lit(dim)))
    with_dim = voices.join(base_dimension(voices, keys), keys, "left")
    return with_dim.withColumn("embedding", vc.centroid(F.col("embedding"), F.col("dim"))).drop("dim")


def best_remote(voices: DataFrame, keys: list[str], minimum: float = params.ECHO_EMBEDDING) -> DataFrame:
    """Per local speaker the most similar remote speaker above ``minimum``: keys, local, remote, similarity.

    ``voices`` holds one row per speaker of a chunk; ties go to the smaller label.
    """
    v = voices.select(*keys, "source", "speaker", F.col("embedding").alias("e"), vc.norm(F.col("embedding")).alias("n"))
    local = v.where("source = 'local'").select(*keys, F.col("speaker").alias("local"), F.col("e").alias("le"), F.col("n").alias("ln"))
    remote = v.where("source = 'remote'").select(*keys, F.col("speaker").alias("remote"), F.col("e").alias("re"), F.col("n").alias("rn"))
    similarity = F.when((F.size("le") == F.size("re")) & (F.size("le") > 0), vc.cosine_from(
        vc.dot(F.col("le"), F.col("re")), F.col("ln"), F.col("rn"))).otherwise(F.lit(0.0))
    scored = local.join(remote, keys).select(*keys, "local", "remote", similarity.alias("similarity"))
    name, number = F.regexp_replace("remote", r"\d+$", ""), F.coalesce(tx.trailing_index(F.col("remote")), F.lit(-1))
    natural = F.struct((-F.col("similarity")).alias("far"), name.alias("name"), number.alias("number"), F.col("remote").alias("label"))
    best = scored.where(F.col("similarity") > minimum).groupBy(*keys, "local").agg(
        F.min_by(F.struct("remote", "similarity"), natural).alias("b"))
    return best.select(*keys, "local", "b.remote", "b.similarity")


def candidate_pairs(labeled: DataFrame, matches: DataFrame, keys: list[str], ident: list[str],
                    temporal: float = params.ECHO_TEMPORAL) -> DataFrame:
    """Local rows with the rows of their matching remote speaker that overlap enough.

    ident, r_<ident>, l_words, r_words, overlap seconds over the shorter row > ``temporal``.
    """
    cols = [F.col(c).alias(f"l_{c}") for c in ident]
    local = (labeled.where("source = 'local'")
             .withColumn("local", F.regexp_replace("speaker", "^Local ", ""))
             .join(matches.select(*keys, "local", F.concat(F.lit("Remote "), "remote").alias("who")), [*keys, "local"])
             .select(*keys, "who", *cols, F.col("start_s").alias("l0"), F.col("end_s").alias("l1"),
                     tx.word_set(F.col("text")).alias("l_words")))
    remote = (labeled.where("source = 'remote'")
              .select(*keys, F.col("speaker").alias("who"), *[F.col(c).alias(f"r_{c}") for c in ident],
                      F.col("start_s").alias("r0"), F.col("end_s").alias("r1"),
                      tx.word_set(F.col("text")).alias("r_words")))
    pairs = overlap_pairs(local, remote, [*keys, "who"], "l0", "l1", "r0", "r1")
    shorter = F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0"))
    overlap = overlap_seconds(*map(F.col, ("l0", "l1", "r0", "r1")))
    # Word sets are made once per row before the join: made after it, a pushed-down text filter would repeat them.
    # Compared as products, so a zero-length row never divides; capping the ratio at 1 cannot matter below 1.
    return pairs.where((shorter > 0) & (overlap > temporal * shorter)).drop("l0", "l1", "r0", "r1")


def pair_hit(limit: float) -> Column:
    jac, cont = tx.jaccard(F.col("l_words"), F.col("r_words")), tx.containment(F.col("l_words"), F.col("r_words"))
    return (jac > limit) | (cont > limit)


def judged(pairs: DataFrame, keys: list[str], ident: list[str], limit: float) -> DataFrame:
    """Per local row: ``alone`` if it matches one remote row, ``together`` if all its remote rows taken as one text.

    The words of that joined text are the union of the rows' words, so nothing is concatenated: words are counted
    per local row after a partial distinct, however many remote rows it spans. Pairs that already match bring no words.
    """
    key = [*keys, *[f"l_{c}" for c in ident]]
    partner = F.struct(*[f"r_{c}" for c in ident])
    flagged = pairs.select(*key, "l_words", "r_words", partner.alias("r"), F.size("l_words").alias("l_size"), pair_hit(limit).alias("hit"))
    spoken = flagged.select(*key, "l_words", "r", "l_size", "hit", F.explode_outer(F.when(~F.col("hit"), F.col("r_words"))).alias("word"))
    per_word = spoken.groupBy(*key, "word").agg(
        F.bool_or("hit").alias("hit"), F.any_value("l_size").alias("l_size"), F.min("r").alias("r0"), F.max("r").alias("r1"),
        F.bool_or(F.array_contains("l_words", F.col("word"))).alias("shared"))
    rows = per_word.groupBy(*key).agg(
        F.bool_or("hit").alias("alone"), (F.min("r0") != F.max("r1")).alias("several"), F.any_value("l_size").alias("l_size"),
        F.count_if("shared").alias("inter"), F.count("word").alias("other"))
    union = F.col("l_size") + F.col("other") - F.col("inter")
    together = ~F.col("alone") & F.col("several") & (F.col("inter") > limit * union)
    return rows.select(*key, "alone", together.alias("together"))


def echoes(labeled: DataFrame, voices: DataFrame, keys: list[str], ident: list[str],
           limits: Thresholds = Thresholds(), dim: int | None = None) -> DataFrame:
    """Identities of the local rows to drop."""
    matches = best_remote(pooled(voices, keys, dim), keys, limits.embedding)
    pairs = candidate_pairs(labeled, matches, keys, ident, limits.temporal)
    found = judged(pairs, keys, ident, limits.text).where("alone OR together")
    return found.select(*keys, *[F.col(f"l_{c}").alias(c) for c in ident])


def remove_echo(labeled: DataFrame, voices: DataFrame, keys: list[str], ident: list[str],
                limits: Thresholds = Thresholds(), dim: int | None = None) -> DataFrame:
    return labeled.join(echoes(labeled, voices, keys, ident, limits, dim), [*keys, *ident], "left_anti")


def removed_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("removed"))
