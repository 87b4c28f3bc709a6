"""Order-dependent operators split into segments.

``lag`` and running sums over a whole group would sort the group in one task.
Here each group is cut into segments along the order column; every segment
is a window partition of its own, and only one summary row per segment is
chained across the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.groupstat import match_keys
from ionloom.session import checkpoint_dir


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, segment: Column, out: str
) -> DataFrame:
    """``lag(value)`` within ``keys``; ``segment`` must grow with ``order``."""
    cut = df.withColumn("_segment", segment)
    local = Window.partitionBy(*keys, "_segment").orderBy(*order)
    chain = Window.partitionBy(*keys).orderBy("_segment")
    ends = cut.groupBy(*keys, "_segment").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_segment", F.lag("_end").over(chain).alias("_carried"))
    placed = cut.withColumn("_lag", F.lag(value).over(local)).withColumn("_place", F.row_number().over(local))
    return (
        match_keys(placed, carried, [*keys, "_segment"])
        .withColumn(out, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_segment", "_lag", "_place", "_carried")
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: str, segment: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` within ``keys`` in the given order."""
    cut = df.withColumn("_segment", segment)
    local = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chain = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_segment").agg(F.sum(value).alias("_sum"))
    carried = sums.select(*keys, "_segment", F.coalesce(F.sum("_sum").over(chain), F.lit(0)).alias("_carried"))
    return (
        match_keys(cut.withColumn("_local", F.sum(value).over(local)), carried, [*keys, "_segment"])
        .withColumn(out, F.col("_local") + F.col("_carried"))
        .drop("_segment", "_local", "_carried")
    )


def change_runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    changed: Callable[[Column, Column], Column],
    segment: Column,
    out: str,
) -> DataFrame:
    """Number the runs of each group 1, 2, ... in the given order.

    A row opens a new run when ``changed(previous value, value)`` holds.
    Runs are counted inside each segment; whether a segment's first row goes
    on with the run before it is settled on the per-segment summary.
    """
    local = Window.partitionBy(*keys, "_segment").orderBy(*order)
    counted = (
        df.withColumn("_segment", segment)
        .withColumn("_before", F.lag(value).over(local))
        .withColumn("_place", F.row_number().over(local))
        .withColumn("_step", F.when(F.col("_place") == 1, 0).when(changed(F.col("_before"), F.col(value)), 1).otherwise(0))
        .withColumn("_runs", F.sum("_step").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    )
    place = F.struct(*order)
    summary = counted.groupBy(*keys, "_segment").agg(
        F.min_by(value, place).alias("_head"), F.max_by(value, place).alias("_tail"), F.sum("_step").alias("_steps")
    )
    chain = Window.partitionBy(*keys).orderBy("_segment")
    linked = summary.withColumn("_link", F.lag("_tail").over(chain)).withColumn("_nth", F.row_number().over(chain))
    opens = F.when(F.col("_nth") == 1, 1).when(changed(F.col("_link"), F.col("_head")), 1).otherwise(0)
    before = F.sum("_steps").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    offsets = linked.withColumn("_opens", opens).select(
        *keys,
        "_segment",
        (
            F.sum("_opens").over(chain.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(before, F.lit(0))
        ).alias("_offset"),
    )
    return (
        match_keys(counted.drop("_before", "_place", "_step"), offsets, [*keys, "_segment"])
        .withColumn(out, F.col("_runs") + F.col("_offset"))
        .drop("_segment", "_runs", "_offset")
    )


def global_ordinal(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 1..n in a total order without a single-task window.

    A range-partitioned sort is checkpointed, so that the row positions it
    fixes survive the loss of an executor; one row per partition then gives
    the offsets.
    """
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_inside", inside).drop("_at")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part", "inner")
        .withColumn(out, F.col("_offset") + F.col("_inside") + 1)
        .drop("_part", "_inside", "_offset")
    )


def is_monotone(df: DataFrame, keys: list[str], order: list[str], y: str, segment: Column, out: str) -> DataFrame:
    """1 per group when ``y`` never falls along ``order``, else 0."""
    stepped = previous_value(df, keys, order, y, segment, "_before")
    falls = F.coalesce((F.col(y) < F.col("_before")).cast("int"), F.lit(0))
    return stepped.groupBy(*keys).agg((F.lit(1) - F.max(falls)).alias(out))
