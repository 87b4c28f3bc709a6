import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.operators import clusters, groupstat, ordered
from ionloom.operators.quantiles import order_statistics, quantiles


def brute_clusters(values, tolerance, relative):
    """Row-order clustering straight from its definition."""
    labels, count = [0] * len(values), 0
    for i, v in enumerate(values):
        if not labels[i]:
            count += 1
            labels[i] = count
        for j in range(i + 1, len(values)):
            gap = abs(v - values[j]) / (v if relative else 1)
            if not labels[j] and gap <= tolerance:
                labels[j] = labels[i]
    return labels


def points(spark, groups=3, n=120, seed=0, low=1.0, high=40.0):
    rng = np.random.default_rng(seed)
    rows = [(f"g{g}", i, float(np.round(v, 2))) for g in range(groups) for i, v in enumerate(rng.uniform(low, high, n))]
    return rows, spark.createDataFrame(rows, "g string, idx long, x double")


@pytest.mark.parametrize("tolerance, relative", [(0.133, False), (0.0077, True), (1.5017, False)])
def test_row_order_clusters(spark, tolerance, relative):
    rows, df = points(spark)
    found = {(r.g, r.idx): r.c for r in clusters.order_clusters(df, ["g"], "idx", "x", tolerance, relative, "c").collect()}
    for g in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == g]
        assert [found[g, i] for i in range(len(values))] == brute_clusters(values, tolerance, relative)


@pytest.mark.parametrize("values, labels", [([1, 3, 2], [1, 2, 1]), ([1, 2, 3, 5], [1, 1, 1, 2])])
def test_small_orders(spark, values, labels):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "g string, idx long, x double")
    found = clusters.order_clusters(df, ["g"], "idx", "x", 1.0, False, "c").orderBy("idx").collect()
    assert [r.c for r in found] == labels


def test_gap_clusters_equal_row_order_on_sorted_rows(spark):
    rows, _ = points(spark)
    for g in {r[0] for r in rows}:
        values = sorted(r[2] for r in rows if r[0] == g)
        df = spark.createDataFrame([(g, i, v) for i, v in enumerate(values)], "g string, idx long, x double")
        found = clusters.gap_clusters(df, ["g"], "x", 0.133, False, "c").orderBy("idx").collect()
        assert [r.c for r in found] == brute_clusters(values, 0.133, False)


def test_segmented_windows(spark):
    rows, df = points(spark)
    segment = F.floor(F.col("idx") / 7)
    lagged = {(r.g, r.idx): r.p for r in ordered.previous_value(df, ["g"], ["idx"], "x", segment, "p").collect()}
    total = {(r.g, r.idx): r.t for r in ordered.running_total(df, ["g"], ["idx"], "x", segment, "t").collect()}
    for g in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == g]
        sums = np.cumsum(values)
        for i, v in enumerate(values):
            assert lagged[g, i] == (values[i - 1] if i else None)
            assert total[g, i] == pytest.approx(sums[i])


def test_global_ordinal(spark):
    _, df = points(spark)
    numbered = ordered.global_ordinal(df.repartition(5), ["g", "x", "idx"], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, len(numbered) + 1))
    assert [(r.g, r.x, r.idx) for r in numbered] == sorted((r.g, r.x, r.idx) for r in numbered)


def test_top_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 3)], "k string, s int")
    assert groupstat.top_ties(df, ["k"], F.col("s")).count() == 2


def test_min_max_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    for constant, expected in ((1.0, [0.0, 1.0, 1.0, 1.0]), (None, [0.0, 1.0, None, None])):
        scaled = groupstat.min_max_scale(df, ["k"], "v", "s", constant).orderBy("k", "v").collect()
        assert [r.s for r in scaled] == expected


def test_quantiles(spark):
    rows, df = points(spark)
    found = {r.g: r for r in quantiles(df, ["g"], "x", a=0.25, b=0.75, c=0.5).collect()}
    ranks = {r.g: r for r in order_statistics(df, ["g"], "x", third=F.lit(3)).collect()}
    for g in found:
        values = [r[2] for r in rows if r[0] == g]
        assert [found[g].a, found[g].b, found[g].c] == pytest.approx(list(np.quantile(values, [0.25, 0.75, 0.5])))
        assert ranks[g].third == sorted(values)[2]


@pytest.mark.parametrize("few", [0, 10_000])
def test_quantiles_of_crowded_heavy_and_tied_groups(spark, monkeypatch, few):
    monkeypatch.setattr("ionloom.operators.quantiles.FEW_GROUPS", few)
    rng = np.random.default_rng(8)
    groups = {
        "heavy": np.exp(rng.normal(0, 8, 30_000)),
        "tied": np.repeat([1.0, 2.0, 3.0], [20_000, 5, 9_995]),
        "mixed": np.concatenate([np.full(15_000, 7.0), rng.normal(7, 1e-9, 15_000), [np.inf, -np.inf, 1e300]]),
        "pair": np.array([-1.0, 4.0]),
        None: np.array([5.0]),
        "long": np.arange(25_001.0)[::-1],
    }
    frame = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in groups.items()]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(list(frame.itertuples(index=False, name=None)) + [("pair", None)], "g string, x double")
    spots = (0.0, 0.0001, 0.25, 0.5, 0.75, 0.9999, 1.0)
    found = {r.g: r for r in order_statistics(df, ["g"], "x", **{f"p{k}": F.floor((F.col("n") - 1) * p) + 1 for k, p in enumerate(spots)}).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        ordered = np.sort(values)
        assert found[g].n == len(values)
        assert [found[g][f"p{k}"] for k in range(len(spots))] == [ordered[int(np.floor((len(values) - 1) * p))] for p in spots]


def test_quantiles_cut_once_over_many_partitions(spark):
    df = spark.range(0, 300_000, 1, 8).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    ordered = np.sort([r.x for r in df.collect()])
    found = order_statistics(df, ["g"], "x", least=F.lit(1), low=F.lit(75_000), mid=F.lit(150_001), last=F.col("n")).first()
    assert [found.least, found.low, found.mid, found.last] == [ordered[0], ordered[74_999], ordered[150_000], ordered[-1]]
