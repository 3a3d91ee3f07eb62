"""Mixing of sources to target weights by temperature, realised as budgeted block permutations. DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised. ``alpha`` is found by bisection on the aggregated
source table. A source's stream is epoch after epoch of its documents: the documents fall into blocks, each epoch orders
the blocks anew, and the last epoch stops where the source's token budget is used up. Which documents that leaves follows
from two hash limits per source, so texts are never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

WAYS = 16                   # parts an interval of exponents is cut into by one pass: four halvings
ROUNDS = 10
BROADCAST_SOURCES = 100_000
SEED = 20

_PLAN = ("source", "weight", "epochs", "whole", "part", "blocks", "stop_order", "stop_block", "stop_row")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), blocks)


def _block_order(block: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 1), block, epoch)


def _row_order(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 2), "doc_id", epoch)


def _sums(sources: DataFrame, alphas: list[float]) -> list[tuple[float, float, float]]:
    """(entropy of the weights, largest and smallest weight per token) for each exponent, in one pass."""
    p = F.col("share")
    row = sources.filter("share > 0").agg(*[c for a in alphas for c in (
        F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)), F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1))))]).first()
    out = []
    for k, a in enumerate(alphas):
        z, zl, most, least = row[4 * k:4 * k + 4]
        out.append((math.log(z) - a * zl / z, most / z, least / z))
    return out


def bisect_exponent(sources: DataFrame, target_entropy: float | None, repetition_limit: float | None) -> tuple[float, float]:
    """(alpha, budget): budget in units of all tokens, the least at which every document appears once.

    Entropy falls and the spread of repetitions narrows as alpha goes to 1, so the smallest alpha in [0, 1] (0: equal
    weights) that meets the wanted limit is bracketed and narrowed ``4 * ROUNDS`` halvings deep.
    """
    def met(entropy: float, most: float, least: float) -> bool:
        return ((target_entropy is None or entropy <= target_entropy + 1e-12)
                and (repetition_limit is None or most / least <= repetition_limit * (1 + 1e-12)))

    if sources.filter("share > 0").isEmpty():
        return 1.0, 0.0
    low, high = 0.0, 1.0
    if met(*_sums(sources, [0.0])[0]):
        high = 0.0
    else:
        for _ in range(ROUNDS):
            steps = [low + (high - low) * k / WAYS for k in range(1, WAYS)]
            good = [met(*s) for s in _sums(sources, steps)]
            k = good.index(True) if True in good else WAYS - 1
            low, high = (steps[k - 1] if k else low), (steps[k] if k < WAYS - 1 else high)
    return high, 1 / _sums(sources, [high])[0][2]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def plan_mixture(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """A row per source: its weight, its epochs (repetitions, a fraction), whole epochs, and the limits of the part epoch."""
    keys = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "mixing-keys")
    total = keys.agg(F.sum("tokens")).first()[0] or 0
    sources = written(keys.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
                      .withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), "mixing-sources")
    alpha, least = bisect_exponent(sources, target_entropy, repetition_limit)
    norm = sources.filter("share > 0").agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0] or 1.0
    spend = float(budget) if budget is not None else least * total
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(norm)).otherwise(F.lit(0.0))
    epochs = F.when(F.col("share") > 0, F.col("weight") * F.lit(spend) / F.col("tokens")).otherwise(F.lit(1.0))
    parts = written(
        sources.withColumn("weight", weight).withColumn("epochs", epochs)
        .withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int"))
        .withColumn("part", F.greatest(F.lit(0.0), (F.col("epochs") - F.col("whole")) * F.col("tokens")))
        .withColumn("blocks", F.ceil(F.sqrt("rows")).cast("long")), "mixing-weights")

    few = F.broadcast(parts) if parts.count() <= BROADCAST_SOURCES else parts
    rows = (keys.alias("k").join(few.alias("p"), _same(F.col("k.source"), F.col("p.source")))
            .select("doc_id", "k.source", "k.tokens", "whole", "part", "blocks").withColumn("block", _block(F.col("blocks"))))
    before = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy("source", "block", "whole", "part").agg(F.sum("tokens").alias("tokens"))
              .withColumn("order", _block_order(F.col("block"), F.col("whole")))
              .withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
    stop = written(blocks.filter("start <= part and part < start + tokens").select("source", "block", "order", (F.col("part") - F.col("start")).alias("left")), "mixing-stops")
    run = Window.partitionBy("source").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    few = F.broadcast(stop) if stop.count() <= BROADCAST_SOURCES else stop
    limit = (rows.alias("r").join(few.alias("s"), _same(F.col("r.source"), F.col("s.source")) & (F.col("r.block") == F.col("s.block")))
             .withColumn("at", _row_order(F.col("whole"))).select("r.source", "tokens", "left", "at")
             .withColumn("used", F.sum("tokens").over(run)).filter("used <= left").groupBy("source").agg(F.max("at").alias("stop_row")))
    return written(
        parts.alias("p").join(stop.select("source", F.col("order").alias("stop_order"), F.col("block").alias("stop_block")).alias("s"),
                              _same(F.col("p.source"), F.col("s.source")), "left")
        .join(limit.alias("l"), _same(F.col("p.source"), F.col("l.source")), "left")
        .select("p.source", "weight", "epochs", "whole", "part", "blocks", "stop_order", "stop_block", "stop_row"), "mixing-plan")


def _repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, block, epoch, weight, repetitions): ``row`` holds the columns of ``docs``, once for each epoch it is in."""
    few = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["source"])
    joined = (packed.alias("d").join(few.alias("p"), _same(F.col("d.source"), F.col("p.source")))
              .select("row", "doc_id", "weight", "epochs", "whole", "blocks", "stop_order", "stop_block", "stop_row"))
    rows = joined.withColumn("block", _block(F.col("blocks"))).withColumn("order", _block_order(F.col("block"), F.col("whole")))
    early = F.struct("order", "block") < F.struct(F.col("stop_order").alias("order"), F.col("stop_block").alias("block"))
    last = (F.col("block") == F.col("stop_block")) & (_row_order(F.col("whole")) <= F.col("stop_row"))
    copies = F.col("whole") + F.coalesce((F.col("stop_order").isNotNull() & (early | F.coalesce(last, F.lit(False)))).cast("int"), F.lit(0))
    return (rows.withColumn("copies", copies).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            .select("row", "doc_id", "block", "epoch", "weight", F.col("epochs").alias("repetitions")))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """The mixture as rows (doc_id, source, weight, repetitions, epoch, block, block_order, row_order): a document once
    for each epoch it is in; ascending (epoch, block_order, row_order) is the order of its source's stream.

    Weights: shares to the smallest power in [0, 1] with an entropy of at most ``target_entropy`` (nats) and no source
    repeated more than ``repetition_limit`` times as often as another. ``budget``: tokens of the mixture; without one,
    the least at which no document is left out, so that no source then passes the limit. Tokens are words.
    Null sources are one source. Sources without any token have weight 0 and appear once. Repeated rows share their
    epochs; rows with a null doc_id share a block. An empty table gives an empty result.
    """
    out = _repeated(docs, plan_mixture(docs, target_entropy, repetition_limit, budget))
    return out.select("doc_id", F.col("row.source").alias("source"), "weight", "repetitions", F.col("epoch").cast("int").alias("epoch"),
                      "block", _block_order(F.col("block"), F.col("epoch")).alias("block_order"), _row_order(F.col("epoch")).alias("row_order"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """``docs``, all columns, each row once for each epoch of the mixture it is in."""
    out = _repeated(docs, plan_mixture(docs, target_entropy, repetition_limit, budget))
    return out.select("row.*")
