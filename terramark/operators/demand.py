"""Markov demand: exact integer apportionment of transition flows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounded_flows(probabilities: DataFrame, base_counts: DataFrame, ties_high: bool = False) -> DataFrame:
    """(from_code, to_code, flow): each row's cells by largest remainders; ties to the lowest class.

    base_counts: class_code and n. With ties_high, equal remainders go to the highest class.
    """
    exact = probabilities.select("from_code", "to_code", "p").join(F.broadcast(base_counts.select(F.col("class_code").alias("from_code"), F.col("n").alias("n_base"))), "from_code")
    exact = exact.withColumn("x", F.col("p") * F.col("n_base")).withColumn("low", F.floor("x"))
    row = Window.partitionBy("from_code")
    rank = F.row_number().over(row.orderBy(F.desc(F.round(F.col("x") - F.col("low"), 9)), F.desc("to_code") if ties_high else F.asc("to_code")))
    left = F.col("n_base") - F.sum("low").over(row)
    return exact.withColumn("left", left).withColumn("rank", rank).select("from_code", "to_code", (F.col("low") + (F.col("rank") <= F.col("left")).cast("long")).alias("flow"))


def markov_demand(flows: DataFrame) -> DataFrame:
    """(class_code, demand): what flows into each class."""
    return flows.groupBy(F.col("to_code").alias("class_code")).agg(F.sum("flow").alias("demand"))


def apportion(total: int, weights: dict[int, float], caps: dict[int, int]) -> dict[int, int]:
    """Whole shares of `total` by weight, none above its cap.

    Rounds hand out floors of the remaining shares; when all floors are 0, single units go by
    descending weight, then by key. Without any weight the caps serve as weights.
    """
    open_keys = sorted(k for k, c in caps.items() if c > 0)
    given = dict.fromkeys(caps, 0)
    left = min(total, sum(caps[k] for k in open_keys))
    weight = {k: max(0.0, weights.get(k, 0.0)) for k in open_keys}
    while left > 0:
        free = [k for k in open_keys if given[k] < caps[k]]
        scale = {k: weight[k] for k in free}
        if not sum(scale.values()):
            scale = {k: float(caps[k] - given[k]) for k in free}
        whole = sum(scale.values())
        floors = {k: min(caps[k] - given[k], math.floor(left * scale[k] / whole)) for k in free}
        if not any(floors.values()):
            floors = dict.fromkeys(sorted(free, key=lambda k: (-scale[k], k))[:left], 1)
        for k, n in floors.items():
            given[k] += n
            left -= n
    return given


def source_weights(surplus: dict[int, int], transition: dict[tuple[int, int], float], target: int) -> dict[int, float]:
    """Surplus times transition probability into the target; all zero: the surplus alone."""
    weights = {k: n * transition.get((k, target), 0.0) for k, n in surplus.items()}
    return weights if any(weights.values()) else {k: float(n) for k, n in surplus.items()}
