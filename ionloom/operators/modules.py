"""Co-expression modules: detection, eigengenes and merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators.groupstat import attach
from ionloom.operators.linkage import average_linkage, cut_tree
from ionloom.operators.network import both_directions, correlations, number_features
from ionloom.session import written

# fixed values of the network script; features outside all modules get NO_MODULE
MIN_MODULE_SIZE = 20
MERGE_HEIGHT = 0.15
NO_MODULE = -1
SUBSET_SIZE = 400
# length of a residual, relative to the eigenvalue, at which a leading vector is taken as found
RESIDUAL = 1e-12
ROUNDS = 500


def detect_modules(
    numbers: DataFrame, overlap: DataFrame, cut_height: float, min_size: int = MIN_MODULE_SIZE
) -> DataFrame:
    """Modules from average linkage on ``1 - overlap``, cut at one fixed height."""
    items = numbers.select(F.col("feature_no").alias("item"))
    merges = average_linkage(items, overlap.select("i", "j", (F.lit(1.0) - F.col("tom")).alias("d")))
    parts = cut_tree(items, merges, cut_height)
    sizes = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    module = F.when(F.col("_n") >= min_size, F.col("cluster")).otherwise(F.lit(NO_MODULE))
    return parts.join(sizes, "cluster").select(F.col("item").alias("feature_no"), module.alias("module"))


def _ritz(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best combination of vector, residual and last step, from the inner products of a module."""
    for batch in batches:
        found = []
        for row in batch.to_dict("records"):
            gram = np.array([[row[f"g{a}{b}"] for b in "vwp"] for a in "vwp"])
            image = np.array([[row[f"a{a}{b}"] for b in "vwp"] for a in "vwp"])
            value = image[0, 0] / gram[0, 0]
            if gram[1, 1] <= (RESIDUAL * max(abs(value), 1.0)) ** 2 * gram[0, 0]:
                found.append((row["module"], 1.0, 0.0, 0.0, value, True))
                continue
            length = np.sqrt(np.diag(gram))
            scale = np.divide(1.0, length, out=np.zeros(3), where=length > 0)
            spread, axes = np.linalg.eigh(gram * np.outer(scale, scale))
            kept = spread > 1e-8
            basis = scale[:, None] * axes[:, kept] / np.sqrt(spread[kept])
            values, turns = np.linalg.eigh(basis.T @ image @ basis)
            mix = basis @ turns[:, -1]
            mix = mix if mix[0] >= 0 else -mix
            found.append((row["module"], *mix, values[-1], False))
        yield pd.DataFrame(found, columns=["module", "cv", "cw", "cp", "lam", "settled"])


def _image(state: DataFrame, inside: DataFrame, vector: str) -> DataFrame:
    """Correlation matrix times ``vector``, module by module: a join of the pairs and a sum; settled modules are left out."""
    there = state.filter("not settled").select(F.col("feature_no").alias("j"), F.col(vector).alias("_x"))
    sums = inside.join(there, "j").groupBy("i").agg(F.sum(F.col("r") * F.col("_x")).alias("_sum"))
    rest = F.coalesce("_sum", F.lit(0.0))
    return state.join(sums, F.col("feature_no") == F.col("i"), "left").withColumn(f"a{vector}", F.col(vector) + rest).drop("i", "_sum")


def leading_vectors(modules: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Unit-length leading eigenvector of each module's correlation matrix: feature_no, module, loading.

    Power iteration over the pair table, sped up by the last step: a round multiplies the
    residual by the matrix (one join and one sum over the pairs) and takes the best mix of vector, residual and
    last step, which needs twelve sums per module. No task holds a module. Rounds end
    when all residuals are below ``RESIDUAL``; modules that are there already are left alone.
    The sum of the loadings is positive; where it is zero, the loading of the first feature. A null
    correlation (constant feature) counts as 0; a module of one feature has loading 1; no modules give no rows.
    """
    kept = modules.filter(F.col("module") != NO_MODULE).select("feature_no", "module")
    left = kept.select(F.col("feature_no").alias("i"), "module")
    right = kept.select(F.col("feature_no").alias("j"), F.col("module").alias("_m"))
    within = pairs.join(left, "i").join(right, "j").filter("module = _m").select("i", "j", F.coalesce("r", F.lit(0.0)).alias("r"))
    inside = written(both_directions(within, "r"))
    # no simple start: the vector of ones is often an eigenvector itself
    start = F.lit(0.5) + F.pmod(F.xxhash64("feature_no"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    state = kept.select("feature_no", "module", start.alias("v"), F.lit(0.0).alias("p"), F.lit(0.0).alias("ap"), F.lit(False).alias("settled"))
    state = attach(_image(state, inside, "v"), ["module"], _vv=F.sum(F.col("v") * F.col("v")), _va=F.sum(F.col("v") * F.col("av")))
    unit = F.sqrt("_vv")
    state = written(
        state.select(
            "feature_no", "module", (F.col("v") / unit).alias("v"), (F.col("av") / unit).alias("av"), "p", "ap",
            (F.col("_va") / F.col("_vv")).alias("lam"), "settled",
        )
    )
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{a}{b}") for a in "vwp" for b in "vwp"]
    sums += [F.sum(F.col(a) * F.col(f"a{b}")).alias(f"a{a}{b}") for a in "vwp" for b in "vwp"]
    for _ in range(rounds):
        # a row of a settled module takes part in nothing more
        state = state.withColumn("w", F.when(F.col("settled"), F.lit(0.0)).otherwise(F.col("av") - F.col("lam") * F.col("v")))
        state = _image(state, inside, "w")
        mixes = state.groupBy("module").agg(*sums).mapInPandas(_ritz, "module long, cv double, cw double, cp double, lam double, settled boolean")
        step = state.drop("lam", "settled").join(mixes, "module")
        move, image = F.col("cw") * F.col("w") + F.col("cp") * F.col("p"), F.col("cw") * F.col("aw") + F.col("cp") * F.col("ap")
        state = written(
            step.select(
                "feature_no", "module", (F.col("cv") * F.col("v") + move).alias("v"), (F.col("cv") * F.col("av") + image).alias("av"),
                move.alias("p"), image.alias("ap"), "lam", "settled",
            )
        )
        if state.filter("not settled").isEmpty():
            break
    else:
        raise ValueError(f"leading vectors are not found in {rounds} rounds")
    signed = attach(state, ["module"], _sum=F.round(F.sum("v"), 9), _first=F.min_by("v", "feature_no"))
    turned = (F.col("_sum") < 0) | ((F.col("_sum") == 0) & (F.col("_first") < 0))
    return signed.select("feature_no", "module", F.when(turned, -F.col("v")).otherwise(F.col("v")).alias("loading"))


def eigengenes(long: DataFrame, numbers: DataFrame, modules: DataFrame, pairs: DataFrame, n_samples: int) -> DataFrame:
    """First principal component score of each module and sample.

    Loadings come from ``leading_vectors``; the samples are scored by a join and a sum.
    Missing cells count as 0; features that never vary add nothing.
    """
    loadings = leading_vectors(modules, pairs)
    n = F.lit(float(n_samples))
    stats = long.groupBy("feature").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    scale = F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0)) / F.lit(float(max(n_samples - 1, 1))))
    weights = (
        stats.join(numbers, "feature").join(loadings, "feature_no")
        .select("feature", "module", F.coalesce(F.try_divide(F.col("loading"), scale), F.lit(0.0)).alias("_w"), (F.col("_s") / n).alias("_mean"))
    )
    # sum of w * (value - mean): the mean part is the same for every sample
    offset = weights.groupBy("module").agg(F.sum(F.col("_w") * F.col("_mean")).alias("_offset"))
    scores = long.join(weights, "feature").groupBy("module", "sample").agg(F.sum(F.col("_w") * F.col("value")).alias("_raw"))
    # a sample without a cell of a module still has a score there; modules are few
    every = long.select("sample").distinct().crossJoin(offset)
    raw = F.coalesce("_raw", F.lit(0.0))
    return every.join(scores, ["module", "sample"], "left").select("module", "sample", (raw - F.col("_offset")).alias("score"))


def merge_modules(modules: DataFrame, scores: DataFrame, n_samples: int, height: float = MERGE_HEIGHT) -> DataFrame:
    """Join modules whose eigengenes correlate above ``1 - height``."""
    long = scores.select("sample", F.col("module").alias("feature"), F.col("score").alias("value"))
    numbers = number_features(long)
    distances = correlations(long, numbers, n_samples).select("i", "j", (F.lit(1.0) - F.coalesce("r", F.lit(0.0))).alias("d"))
    items = numbers.select(F.col("feature_no").alias("item"))
    parts = cut_tree(items, average_linkage(items, distances), height)
    named = parts.join(numbers.withColumnRenamed("feature", "module"), F.col("item") == F.col("feature_no"))
    merged = attach(named.select("cluster", "module"), ["cluster"], _merged=F.min("module")).select("module", "_merged")
    return modules.join(merged, "module", "left").select(
        "feature_no", F.coalesce("_merged", "module").alias("module")
    )


def trait_correlations(scores: DataFrame, traits: DataFrame) -> DataFrame:
    """Pearson correlation of each module score with each trait.

    ``traits``: sample, trait, value. The traits are clinical columns, so a
    sample meets each of its modules once per trait.
    """
    joined = scores.join(traits, "sample")
    return joined.groupBy("module", "trait").agg(
        F.corr("score", "value").alias("r"), F.count(F.lit(1)).alias("n")
    )


def random_features(numbers: DataFrame, size: int = SUBSET_SIZE, seed: int = 1) -> DataFrame:
    """Reproducible random subset of the features for the overview plot data."""
    return numbers.orderBy(F.xxhash64(F.lit(seed), "feature"), "feature").limit(size)


def subset_pairs(pairs: DataFrame, subset: DataFrame) -> DataFrame:
    """Pair rows with both ends in the subset."""
    ids = subset.select("feature_no")
    return pairs.join(ids, pairs["i"] == ids["feature_no"], "left_semi").join(
        ids, pairs["j"] == ids["feature_no"], "left_semi"
    )
