"""Average-linkage clustering on a distributed distance table.

Average linkage never moves a merged cluster closer to a third one than the
nearer of its parts was, so all pairs of mutually nearest clusters can merge in
the same round and still give the tree of one-by-one merging. Leaf distance
sums add up under merging, which makes a round one join and one aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators.clusters import follow_pointers
from ionloom.session import checkpoint_dir

# with at most this many clusters left the distance table is small enough for one task
FINISH_CLUSTERS = 512
MERGE_SCHEMA = "a long, b long, height double, size long"


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """One-by-one merging of the last clusters, on a dense matrix of bounded size."""
    ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
    size = np.zeros(ids.size)
    total = np.full((ids.size, ids.size), np.inf)
    a, b = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    total[a, b] = total[b, a] = pdf["s"]
    size[a], size[b] = pdf["na"], pdf["nb"]
    merges = []
    for _ in range(ids.size - 1):
        mean = np.triu(total / np.outer(size, size), 1)
        mean[np.tril_indices(ids.size)] = np.inf
        at, gone = np.unravel_index(np.argmin(mean), mean.shape)
        merges.append((ids[at], ids[gone], mean[at, gone], int(size[at] + size[gone])))
        total[at] += total[gone]
        total[:, at] = total[at]
        total[at, at] = np.inf
        total[gone], total[:, gone] = np.inf, np.inf
        size[at] += size[gone]
    return pd.DataFrame(merges, columns=["a", "b", "height", "size"])


def average_linkage(items: DataFrame, distances: DataFrame, finish: int = FINISH_CLUSTERS) -> DataFrame:
    """Merges of the tree: ``a, b, height, size`` with ``a < b``.

    ``items``: item; ``distances``: i < j, d for every pair. A cluster goes by
    its smallest item, so ``b`` disappears into ``a``. Rounds run on the
    distributed table while more than ``finish`` clusters are left.
    """
    checkpoint_dir(items.sparkSession)
    one = F.lit(1).cast("bigint")
    sums = distances.select(
        F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").cast("double").alias("s"),
        one.alias("na"), one.alias("nb"),
    ).checkpoint()
    left = items.count()
    pairs = sums.count()
    if pairs != left * (left - 1) // 2:
        raise ValueError(f"{left} items need {left * (left - 1) // 2} distances, not {pairs}")
    merges = []
    while left > max(finish, 1):
        gap = F.col("s") / (F.col("na") * F.col("nb"))
        sized = sums.withColumns({"d": gap, "size": F.col("na") + F.col("nb")})
        ends = sized.select(F.explode(F.array("a", "b")).alias("c"), F.struct("d", "a", "b", "size").alias("edge"))
        nearest = ends.groupBy("c").agg(F.min("edge").alias("edge"))
        # an edge that is the nearest of both its ends appears twice
        mutual = nearest.groupBy("edge").agg(F.count(one).alias("_n")).filter("_n = 2")
        merged = mutual.select("edge.a", "edge.b", F.col("edge.d").alias("height"), "edge.size").checkpoint()
        merges.append(merged)
        done = merged.count()
        if not done:
            raise ValueError("no two clusters are nearest to each other; distances must be numbers")
        left -= done
        moved = merged.select(F.explode(F.array("a", "b")).alias("_old"), F.col("a").alias("_new"), "size")
        renamed = sums
        for end, n in (("a", "na"), ("b", "nb")):
            renamed = (
                renamed.join(moved, F.col(end) == F.col("_old"), "left")
                .withColumns({end: F.coalesce("_new", end), n: F.coalesce("size", n)})
                .drop("_old", "_new", "size")
            )
        swap = F.col("a") > F.col("b")
        sums = (
            renamed.filter("a <> b")
            .select(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s",
                F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
                F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
            )
            .groupBy("a", "b", "na", "nb")
            .agg(F.sum("s").alias("s"))
            .checkpoint()
        )
    rest = sums.groupBy(F.lit(0).alias("_all")).applyInPandas(
        lambda pdf: _finish(pdf.drop(columns="_all", errors="ignore")), MERGE_SCHEMA
    )
    for merged in merges:
        rest = rest.unionByName(merged)
    return rest


def cut_tree(items: DataFrame, merges: DataFrame, height: float) -> DataFrame:
    """Cluster of each item when merges up to ``height`` are carried out."""
    down = merges.filter(F.col("height") <= F.lit(float(height))).select(F.col("b").alias("_id"), F.col("a").alias("_up"))
    pointers = items.select(F.col("item").alias("_id")).join(down, "_id", "left").select(
        "_id", F.coalesce("_up", "_id").alias("_to")
    )
    return follow_pointers(pointers, []).select(F.col("_id").alias("item"), F.col("_to").alias("cluster"))
