"""Group statistics without windows.

A window over a group sends the whole group to one task. These helpers
aggregate first (map-side combine keeps one row per group and task) and join
the small result back; adaptive execution broadcasts it when its measured
size allows and otherwise splits a hot key of the big side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import written


def match_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, as it does in a window; ``df`` keeps its key columns."""
    renamed = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    joined = df.join(renamed, same, how)
    return joined if how == "left_semi" else joined.drop(*(f"_key_{k}" for k in keys))


def attach(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Add one column per aggregate in ``stats``, computed over ``keys``; null keys form a group."""
    summary = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return match_keys(df, summary, keys)


def attach_few(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """``attach`` for rows that are cheap to read again.

    The summary is written first: the planner then knows its size, and the rows are not exchanged to meet a few groups.
    """
    return match_keys(df, written(df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])), keys)


def on_distinct(df: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Derive columns once per distinct ``keys`` instead of once per row."""
    return match_keys(df, derive(df.select(*keys).distinct()), keys)


def min_max_scale(
    df: DataFrame, keys: list[str], value: str, out: str, constant: float | None = 1.0, ranged: Callable[..., DataFrame] = attach
) -> DataFrame:
    """Scale ``value`` to [0, 1] within ``keys``; constant groups get ``constant``."""
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(low == high, F.lit(constant).cast("double")).otherwise(
        F.try_divide(F.col(value) - low, high - low)
    )
    with_range = ranged(df, keys, _low=F.min(value), _high=F.max(value))
    return with_range.withColumn(out, scaled).drop("_low", "_high")


def top_ties(df: DataFrame, keys: list[str], score: Column, k: int = 1) -> DataFrame:
    """Rows among the ``k`` best of their group, all ties kept.

    The rank filter is planned with a per-task group limit before the
    shuffle, so a hot group moves only its best rows.
    """
    order = Window.partitionBy(*keys).orderBy(score.desc())
    return df.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def keep_min(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that hold the smallest ``value`` of their group, ties kept."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc())
    return df.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= 1).drop("_rank")


def first_by(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Give all rows of a group the ``value`` of its first row by ``order``."""
    return attach(df, keys, **{out: F.min_by(value, order)})


def groups_with_at_least(df: DataFrame, keys: list[str], distinct: list[str], n: int) -> DataFrame:
    """Keep rows of groups holding at least ``n`` distinct ``distinct`` tuples."""
    tuples = df.select(*keys, *distinct).distinct()
    big = tuples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return match_keys(df, big.select(*keys), keys, "left_semi")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
