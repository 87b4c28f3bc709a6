"""Cohort tables in long form: one row per (sample, class, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.operators.quantiles import order_statistics, quantiles

# fixed values of the cohort scripts
QC_CLASS = "QC"
LABEL_STANDARD = "FFA"
CONTROL_CLASS = "HD"
VALIDATION_MARK = "TEST"
VALIDATION_COHORT, DISCOVERY_COHORT = "333 cohort", "1393 cohort"


def to_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Unpivot a wide cohort table (one column per feature)."""
    features = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, features, "feature", "value")


def feature_names(long: DataFrame) -> list[str]:
    """The table's features in order; they become columns, so there are as many as a schema can hold."""
    return [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]


def to_wide(long: DataFrame, ids: list[str], features: list[str] | None = None) -> DataFrame:
    """Pivot back to one column per feature, by default for all features of the table.

    A given list fixes the schema; a feature outside it raises. Of several values of a cell the largest counts.
    """
    if features is None:
        features = feature_names(long)
    else:
        known = F.coalesce(F.col("feature").isin(*features), F.lit(False))
        stray = F.raise_error(F.concat(F.lit("unknown feature: "), F.coalesce("feature", F.lit("null"))))
        long = long.withColumn("feature", F.when(known, F.col("feature")).otherwise(stray))
    return long.groupBy(*ids).pivot("feature", features).agg(F.max("value"))


def drop_features(long: DataFrame, pattern: str = LABEL_STANDARD) -> DataFrame:
    """Drop features whose name matches ``pattern`` (internal standards)."""
    return long.filter(~F.col("feature").rlike(pattern))


def merge_modes(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Join both ion modes: samples present in both, features of the negative
    mode plus those only the positive mode has; quality controls leave."""
    neg = negative.filter(F.col("class") != QC_CLASS)
    pos = positive.filter(F.col("class") != QC_CLASS)
    extra = pos.join(negative.select("feature").distinct(), "feature", "left_anti")
    both = neg.select("sample").distinct().join(pos.select("sample").distinct(), "sample", "left_semi")
    classes = neg.select("sample", "class").distinct()
    kept = neg.join(both, "sample", "left_semi").select("sample", "class", "feature", "value")
    added = extra.drop("class").join(classes, "sample").select("sample", "class", "feature", "value")
    return kept.unionByName(added)


def clean_sample(name: Column) -> Column:
    """Sample name without the centre suffix, dots as dashes."""
    return F.regexp_replace(F.regexp_replace(name, "_Center.*", ""), r"\.", "-")


def clean_qc_sample(name: Column) -> Column:
    """Sample label of the network script: after ``_QC``, before ``_``, dots as dashes."""
    text = F.regexp_replace(F.regexp_replace(name, ".*_QC", ""), "_.*", "")
    return F.regexp_replace(text, r"\.", "-")


def prepare_classes(long: DataFrame) -> DataFrame:
    """Log values, 0/1 class, clean names and the cohort each sample belongs to."""
    name = clean_sample(F.col("sample"))
    cohort = F.when(name.rlike(VALIDATION_MARK), VALIDATION_COHORT).otherwise(DISCOVERY_COHORT)
    return long.select(
        F.regexp_replace(name, f"\t{VALIDATION_MARK}-", "").alias("sample"),
        F.when(F.col("class") == CONTROL_CLASS, 0).otherwise(1).alias("label"),
        cohort.alias("cohort"),
        "feature",
        F.when(F.col("value") > 0, F.log("value")).alias("value"),
    )


def iqr_samples(long: DataFrame, fraction: float = 0.8, of_samples: bool = True) -> DataFrame:
    """Samples whose values lie between the quartiles for enough features.

    ``of_samples`` measures "enough" against the number of samples, as the
    cohort script does; otherwise it is a share of the features.
    """
    bounds = quantiles(long, ["feature"], "value", _q1=0.25, _q3=0.75).drop("n")
    inside = long.join(bounds, "feature").filter(F.col("value").between(F.col("_q1"), F.col("_q3")))
    unit = "sample" if of_samples else "feature"
    total = long.select(unit).distinct().agg((F.count(F.lit(1)) * F.lit(fraction)).alias("_needed"))
    hits = inside.groupBy("sample").agg(F.count(F.lit(1)).alias("n_inside"))
    # one-row side: the threshold
    return hits.join(F.broadcast(total), F.col("n_inside") > F.col("_needed"), "inner").drop("_needed")


def feature_spread(long: DataFrame) -> DataFrame:
    """Interquartile range per feature from the order statistics next to the quartiles."""
    stats = order_statistics(
        long, ["feature"], "value",
        _low=F.greatest(F.floor(F.col("n") * 0.25), F.lit(1)), _high=F.ceil(F.col("n") * 0.75),
    )
    return stats.select("feature", (F.col("_high") - F.col("_low")).alias("iqr"))


def spread_filter(long: DataFrame, cutoff: float = 0.001) -> DataFrame:
    """Drop the features whose spread is at or below the ``cutoff`` quantile of all spreads."""
    spreads = feature_spread(long)
    limit = quantiles(spreads.withColumn("_all", F.lit(0)), ["_all"], "iqr", _limit=cutoff).select("_limit")
    wide = spreads.join(F.broadcast(limit), F.col("iqr") > F.col("_limit"), "inner").select("feature")
    return long.join(wide, "feature", "left_semi")


def good_features_and_samples(
    long: DataFrame, min_fraction: float = 0.5, min_count: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Features and samples with enough values; features must also vary.

    Both checks repeat until nothing more is dropped.
    """
    present = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    features, samples = present.select("feature").distinct(), present.select("sample").distinct()
    n_features, n_samples = features.count(), samples.count()
    while True:
        seen = (n_features, n_samples)
        rows = present.join(features, "feature", "left_semi").join(samples, "sample", "left_semi")
        features = (
            rows.groupBy("feature")
            .agg(F.count(F.lit(1)).alias("_n"), F.var_samp("value").alias("_var"))
            .filter((F.col("_n") >= max(min_count, min_fraction * n_samples)) & (F.col("_var") > 0))
            .select("feature")
        )
        n_features = features.count()
        samples = (
            rows.join(features, "feature", "left_semi")
            .groupBy("sample")
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= max(min(min_count, n_features), min_fraction * n_features))
            .select("sample")
        )
        n_samples = samples.count()
        if seen == (n_features, n_samples):
            break
    return features, samples


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def frequent(df: DataFrame, key: str, more_than: float) -> DataFrame:
    """Keys that occur more than ``more_than`` times."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
