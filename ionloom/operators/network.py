"""Pairwise feature statistics and the co-expression network.

All-pairs sums (products or absolute differences) run over blocks: features
are split into blocks, the cells of a sample in a block are packed into one row that goes to the
block pairs it belongs to, and a task keeps one block-by-block array it adds every sample to. Tasks emit
that array once, so what is shuffled depends on the features, not on the samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.special import two_sided_p
from ionloom.operators.ordered import global_ordinal

BLOCK = 256
# rows of one dense slice inside a task
SLICE = 512


def _flush(pair: tuple[int, int], total: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(np.ones_like(total))
    left, right = pair[0] * BLOCK + i, pair[1] * BLOCK + j
    # a pair of features that share no sample has sum 0 and is a pair nonetheless
    keep = left <= right
    return pd.DataFrame({"i": left[keep], "j": right[keep], "s": total.ravel()[keep]})


def _pair_sums(kernel: str):
    def slice_sum(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if kernel == "product":
            return left.T @ right
        return np.stack([np.abs(left[:, [a]] - right).sum(axis=0) for a in range(left.shape[1])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by block pair; a row holds a sample's cells of both blocks
        pair, total = None, None
        for batch in batches:
            for here, part in batch.groupby(["bi", "bj"], sort=True):
                if here != pair:
                    if pair is not None:
                        yield _flush(pair, total)
                    pair, total = here, np.zeros((BLOCK, BLOCK))
                for start in range(0, len(part), SLICE):
                    rows = part.iloc[start : start + SLICE]
                    left = _dense(rows["left_at"], rows["left_values"])
                    right = left if here[0] == here[1] else _dense(rows["right_at"], rows["right_values"])
                    total += slice_sum(left, right)
        if pair is not None:
            yield _flush(pair, total)

    return run


def _dense(places: pd.Series, values: pd.Series) -> np.ndarray:
    """One line per sample of a block; a sample without cells there (null) is a line of zeros. Repeated cells add up."""
    out = np.zeros((len(places), BLOCK))
    for line, (at, cells) in enumerate(zip(places, values)):
        if at is not None:
            out[line] = np.bincount(at, cells, BLOCK)
    return out


def number_features(long: DataFrame, feature: str = "feature") -> DataFrame:
    """Distinct features with their 0-based position."""
    return global_ordinal(long.select(feature).distinct(), [feature], "_n").select(
        feature, (F.col("_n") - 1).alias("feature_no")
    )


def pair_sums(long: DataFrame, numbers: DataFrame, kernel: str, row: str = "sample", feature: str = "feature") -> DataFrame:
    """Sum over ``row`` of x*y (``product``) or abs(x-y) (``difference``) per feature pair.

    Missing cells and null values count as 0, the cells of a feature that a sample has more than once add up, rows
    without a sample are one sample; every pair of the features is listed. Returns positions ``i <= j`` and the sum ``s``.
    """
    n_features = int(numbers.count())
    blocks = max(n_features - 1, 0) // BLOCK + 1
    cells = long.select(F.col(row).alias("row"), feature, F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")).join(numbers, feature)
    cell = F.struct((F.col("feature_no") % BLOCK).cast("int").alias("at"), "value")
    # at most BLOCK cells a row, whatever the table; they travel as one row from here on
    packed = cells.groupBy("row", F.floor(F.col("feature_no") / BLOCK).cast("int").alias("block")).agg(F.collect_list(cell).alias("cells"))
    own, other = F.col("block"), F.col("_other")
    # a block pair meets a sample in at most two rows, one per side
    sides = packed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least(own, other).alias("bi"), F.greatest(own, other).alias("bj"), "row",
        F.when(own <= other, F.col("cells")).alias("_left"), F.when(own >= other, F.col("cells")).alias("_right"),
    )
    if blocks > 1:
        first = [F.first(side, ignorenulls=True).alias(side) for side in ("_left", "_right")]
        sides = sides.groupBy("bi", "bj", "row").agg(*first)
    placed = sides.select(
        "bi", "bj", *[F.col(f"_{side}.{part}").alias(f"{side}_{name}") for side in ("left", "right") for part, name in (("at", "at"), ("value", "values"))]
    ).sortWithinPartitions("bi", "bj")
    partial = placed.mapInPandas(_pair_sums(kernel), "i long, j long, s double")
    # blocks are padded with empty features beyond the last one
    return partial.filter(F.col("j") < n_features).groupBy("i", "j").agg(F.sum("s").alias("s"))


def correlations(long: DataFrame, numbers: DataFrame, n_samples: int) -> DataFrame:
    """Pearson correlation of every feature pair ``i < j``; missing cells count as 0.

    It is null where a feature never varies.
    """
    n = F.lit(float(n_samples))
    centred = long.groupBy("feature").agg(F.sum("value").alias("_sum")).join(numbers, "feature")
    products = pair_sums(long, numbers, "product")
    own = products.filter("i = j").select(F.col("i").alias("feature_no"), F.col("s").alias("_square"))
    stats = centred.join(own, "feature_no", "left").select(
        "feature_no", F.col("_sum").alias("t"), (F.coalesce("_square", F.lit(0.0)) - F.col("_sum") * F.col("_sum") / n).alias("v")
    )
    left = stats.select(F.col("feature_no").alias("i"), F.col("t").alias("ti"), F.col("v").alias("vi"))
    right = stats.select(F.col("feature_no").alias("j"), F.col("t").alias("tj"), F.col("v").alias("vj"))
    r = F.try_divide(F.col("s") - F.col("ti") * F.col("tj") / n, F.sqrt(F.col("vi") * F.col("vj")))
    # least and greatest pass over nulls
    clipped = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return products.filter("i < j").join(left, "i").join(right, "j").select("i", "j", clipped.alias("r"))


def with_p_value(pairs: DataFrame, n_samples: int) -> DataFrame:
    """Add the Student p-value of each correlation."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series) -> pd.Series:
        r = r.to_numpy(dtype=float)
        with np.errstate(divide="ignore"):
            t2 = (n_samples - 2) * r**2 / (1 - r**2)
        return pd.Series(two_sided_p(t2, n_samples - 2))

    return pairs.withColumn("p", p_value("r"))


def adjacency(pairs: DataFrame, power: float, signed: bool = True) -> DataFrame:
    """Soft-thresholded network: ``((1+r)/2)^power``, or ``|r|^power`` unsigned.

    ``sign`` keeps the sign of r for the unsigned overlap. A null correlation is no link (0).
    """
    base = (F.lit(1.0) + F.col("r")) / 2 if signed else F.abs("r")
    sign = F.lit(1.0) if signed else F.coalesce(F.signum("r"), F.lit(1.0))
    link = F.coalesce(F.pow(base, F.lit(float(power))), F.lit(0.0))
    return pairs.select("i", "j", link.alias("a"), sign.alias("sign"))


def both_directions(pairs: DataFrame, *values: str) -> DataFrame:
    return pairs.select("i", "j", *values).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def topological_overlap(net: DataFrame) -> DataFrame:
    """Overlap ``|sum_u a_iu a_uj + a_ij| / (min(k_i, k_j) + 1 - a_ij)`` per pair ``i < j``.

    The shared-neighbour sum is the pair sum of the network's own rows.
    """
    signed = net.withColumn("value", F.col("a") * F.col("sign"))
    full = both_directions(signed, "a", "value")
    degree = full.groupBy("i").agg(F.sum("a").alias("k"))
    numbers = degree.select(F.col("i").alias("feature"), F.col("i").alias("feature_no"))
    rows = full.select(F.col("j").alias("sample"), F.col("i").alias("feature"), "value")
    shared = pair_sums(rows, _dense_numbers(numbers), "product").filter("i < j").withColumnRenamed("s", "l")
    left = degree.withColumnRenamed("k", "ki")
    right = degree.select(F.col("i").alias("j"), F.col("k").alias("kj"))
    joined = signed.join(shared, ["i", "j"], "left").join(left, "i").join(right, "j")
    top = F.abs(F.coalesce("l", F.lit(0.0)) + F.col("value"))
    return joined.select("i", "j", (top / (F.least("ki", "kj") + 1 - F.col("a"))).alias("tom"))


def _dense_numbers(numbers: DataFrame) -> DataFrame:
    """Positions must run up to the largest one, so that the block count covers it."""
    top = numbers.agg(F.max("feature_no").alias("_top")).collect()[0]["_top"] or 0
    every = numbers.sparkSession.range(int(top) + 1).select(F.col("id").alias("feature"), F.col("id").alias("feature_no"))
    return every


def edges(pairs: DataFrame, weight: str, threshold: float = 0.2) -> DataFrame:
    """Network edges above a weight."""
    return pairs.filter(F.col(weight) > F.lit(float(threshold)))


def connectivity(net: DataFrame, modules: DataFrame) -> DataFrame:
    """Total, within-module, outside degree and their difference per feature.

    ``modules``: feature_no, module.
    """
    full = both_directions(net, "a")
    here = modules.select(F.col("feature_no").alias("i"), F.col("module").alias("mi"))
    there = modules.select(F.col("feature_no").alias("j"), F.col("module").alias("mj"))
    joined = full.join(here, "i").join(there, "j")
    within = F.when(F.col("mi") == F.col("mj"), F.col("a")).otherwise(F.lit(0.0))
    sums = joined.groupBy(F.col("i").alias("feature_no")).agg(
        F.sum("a").alias("k_total"), F.sum(within).alias("k_within")
    )
    return sums.withColumn("k_out", F.col("k_total") - F.col("k_within")).withColumn(
        "k_diff", F.col("k_within") - F.col("k_out")
    )
