"""Characters per token, learned from use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import params
from .ordered import Scan, block_scan, blocks_of


def accepted(calls: DataFrame) -> DataFrame:
    """Calls that move the ratio, with the value they bring.

    Real ones must be large enough and in range; forced ones in range; a seed out of range becomes the default.
    """
    measured = F.try_divide(F.col("input_chars").cast("double"), F.col("input_tokens").cast("double"))
    in_range = measured.between(*params.TOKEN_RATIO_RANGE)
    real = (F.col("kind") == "real") & (F.col("input_chars") >= params.TOKEN_MIN_CHARS) & (F.col("input_tokens") > params.TOKEN_MIN_TOKENS) & in_range
    forced = (F.col("kind") == "forced") & (F.col("input_chars") > 0) & (F.col("input_tokens") > 0) & in_range
    value = F.when(F.col("kind") == "seed", F.when(in_range, measured).otherwise(F.lit(params.TOKEN_RATIO_DEFAULT))).otherwise(measured)
    return calls.where((F.col("kind") == "seed") | real | forced).withColumn("value", value)


def final_ratios(calls: DataFrame, order: str = "call_ord", width: float = 1 << 20) -> DataFrame:
    """Ratio per model after all calls: model, ratio, is_seed.

    A blend is a weighted sum: after the last reset the k-th newest of n real calls weighs 0.3 * 0.7^k and the reset
    itself 0.7^n. A forced call resets; so does a seed, and then the first real call after it replaces the seed.
    """
    ok = accepted(calls)
    hard = F.col("kind") != "real"
    last = ok.groupBy("model").agg(F.max_by(F.struct(order, "kind", "value"), F.when(hard, F.col(order))).alias("reset"))
    after = ok.join(last, "model").where((F.col("kind") == "real") & (F.col("reset").isNull() | (F.col(order) > F.col(f"reset.{order}"))))
    newest_first = block_scan(after, ["model"], [order], [Scan("k", "sum", F.lit(1).cast("bigint"), reverse=True)], blocks_of(F.col(order), width))
    keep, new = 1 - params.TOKEN_BLEND_NEW, params.TOKEN_BLEND_NEW
    tail = newest_first.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", order).alias("oldest"),
        F.sum(F.lit(new) * F.pow(F.lit(keep), F.col("k") - 1) * F.col("value")).alias("blend"))
    both = last.join(tail, "model", "left")
    forced = F.col("reset.kind") == "forced"
    weight = F.pow(F.lit(keep), F.col("n"))
    # Without a forced start the oldest real call stands in for the reset, so it counts with 0.7^(n-1).
    replaced = F.col("blend") - F.lit(new) * F.pow(F.lit(keep), F.col("n") - 1) * F.col("oldest") + F.pow(F.lit(keep), F.col("n") - 1) * F.col("oldest")
    ratio = (F.when(F.col("n").isNull(), F.col("reset.value")).when(forced, F.col("blend") + weight * F.col("reset.value")).otherwise(replaced))
    return both.select("model", ratio.alias("ratio"), (F.col("n").isNull() & (F.col("reset.kind") == "seed")).alias("is_seed"))


ENTRY = "MAP<STRING, STRUCT<ratio: DOUBLE, isSeed: BOOLEAN>>"


def stored_ratios(body: Column) -> Column:
    """The saved table, or an older one of plain numbers read as seeds; unreadable text gives null."""
    current = F.from_json(body, ENTRY)
    legacy = F.from_json(body, "MAP<STRING, DOUBLE>")
    whole = F.forall(F.map_values(current), lambda e: e.isNotNull() & e["ratio"].isNotNull())
    as_seeds = F.transform_values(legacy, lambda k, v: F.struct(v.alias("ratio"), F.lit(True).alias("isSeed")))
    return F.when(F.coalesce(whole, F.lit(False)), current).otherwise(as_seeds)
