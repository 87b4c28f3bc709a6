"""Exact order statistics and quantiles without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.operators.groupstat import match_keys
from ionloom.operators.ordered import running_total
from ionloom.session import checkpoint_dir

SEGMENTS = 256
ACCURACY = 10_000  # approximate ranks are off by at most n / ACCURACY, far less than a segment
FEW_GROUPS = 10_000  # groups up to which their brackets (some ten numbers each) are broadcast


def order_statistics(df: DataFrame, keys: list[str], value: str, **positions: Column) -> DataFrame:
    """The values at 1-based ``positions`` (expressions over ``n``, the group size).

    A first pass cuts each group into segments at approximate quantiles. Each position then has a bracket, the cuts
    around it, that is sure to hold its value. A second pass counts the values in brackets one by one and all values
    between two brackets as one with the end of the bracket below, which leaves every rank inside brackets as it
    is. A running total over these few values, segment by segment, locates the positions.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    shares = [k / SEGMENTS for k in range(1, SEGMENTS)]
    cuts = F.percentile_approx(value, shares, ACCURACY).alias("_cuts")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cuts).checkpoint()

    ends = []
    for k, at in enumerate(positions.values()):
        place = at / F.col("n") * SEGMENTS
        # the k-th cut has index k - 1; outside the array there is no bound
        ends.append(F.get("_cuts", (F.floor(place) - 2).cast("int")).alias(f"_low{k}"))
        ends.append(F.get("_cuts", F.ceil(place).cast("int")).alias(f"_high{k}"))
    brackets = groups.select(*keys, *ends)
    if groups.count() <= FEW_GROUPS:
        brackets = F.broadcast(brackets)
    x, inside, below = F.col(value), F.lit(False), [F.lit(None), F.lit(None)]
    for k in range(len(positions)):
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        inside = inside | ((low.isNull() | (x >= low)) & (high.isNull() | (x <= high)))
        below.append(F.when(x > high, high))
    coarse = match_keys(rows, brackets, keys).select(*keys, F.when(inside, x).otherwise(F.greatest(*below)).alias(value))

    counts = coarse.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_copies"))
    segment = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col(value))), F.lit(0))
    placed = running_total(match_keys(counts, groups, keys), keys, [value], "_copies", segment, "_upto")
    return placed.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.min(F.when(F.col("_upto") >= at, F.col(value))).alias(name) for name, at in positions.items()],
    )


def quantiles(df: DataFrame, keys: list[str], value: str, **probabilities: float) -> DataFrame:
    """Quantiles with linear interpolation between order statistics."""
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in probabilities.items()}
    wanted = {}
    for name, h in at.items():
        wanted[f"_lo_{name}"] = F.floor(h) + 1
        wanted[f"_hi_{name}"] = F.ceil(h) + 1
    found = order_statistics(df, keys, value, **wanted)
    mixed = [
        (F.col(f"_lo_{name}") + (h - F.floor(h)) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
        for name, h in at.items()
    ]
    return found.select(*keys, "n", *mixed)
