"""Rows, pairs and digits that must not get lost on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import masses, titles
from ionloom.operators import clusters, cohort, fusion, groupstat, linkage, modules, network, ordered, quantiles


def test_rows_with_a_null_key_stay(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 3, 5.0), (None, 4, 7.0)], "g string, o int, v double")
    scaled = {r["o"]: r["s"] for r in groupstat.min_max_scale(rows, ["g"], "v", "s").collect()}
    assert scaled == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}
    assert groupstat.groups_with_at_least(rows, ["g"], ["o"], 2).count() == 4
    segment = F.lit(0)
    lagged = {r["o"]: r["b"] for r in ordered.previous_value(rows, ["g"], ["o"], "v", segment, "b").collect()}
    assert lagged == {1: None, 2: 1.0, 3: None, 4: 5.0}
    assert {r["o"]: r["t"] for r in ordered.running_total(rows, ["g"], ["o"], "v", segment, "t").collect()} == {1: 1.0, 2: 4.0, 3: 5.0, 4: 12.0}
    assert {r["o"]: r["c"] for r in clusters.gap_clusters(rows, ["g"], "v", 2.0, False, "c").collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert clusters.order_clusters(rows, ["g"], "o", "v", 2.0, False, "c").count() == 4


def test_null_titles_have_their_tier(spark):
    rows = spark.createDataFrame([("f", 1, None, 9.0), ("f", 1, "t", 8.0)], "file string, peak int, title string, score double")
    found = {r["title"]: r["top_n"] for r in fusion.tier_labels(rows, ["file"], "peak", "title", "score").collect()}
    assert found[None] == fusion.TIER_NAMES[1]


def test_every_feature_pair_is_listed(spark):
    cells = [("s1", "a", 1.0), ("s2", "b", 2.0), ("s1", "c", 1.0), ("s3", "d", 4.0)]
    long = spark.createDataFrame(cells, "sample string, feature string, value double")
    numbers = network.number_features(long)
    sums = {(r["i"], r["j"]): r["s"] for r in network.pair_sums(long, numbers, "difference").collect()}
    assert len(sums) == 10 and sums[0, 2] == 0.0 and sums[0, 1] == 3.0
    found = {(r["i"], r["j"]): r["r"] for r in network.correlations(long, numbers, 3).collect()}
    assert len(found) == 6
    assert found[0, 1] == pytest.approx(-0.5) and found[0, 2] == pytest.approx(1.0)


def test_all_chains_enter_the_key(spark):
    names = [("16:0_18:1_18:2_20:4_22:6",), ("16:0_18:1_18:2_20:4_22:5",), ("16:0",)]
    found = spark.createDataFrame(names, "c string").select(titles.chain_unsaturations(F.col("c")).alias("u")).collect()
    assert [r["u"] for r in found] == [list("01246"), list("01245"), ["0", "ZZZ", "ZZZ", "ZZZ"]]


def test_counts_of_any_length(spark):
    digits = "0" * 25 + "12"
    found = spark.range(1).select(masses.formula_mass(F.lit(f"C{digits}H")).alias("m")).first()["m"]
    assert found == pytest.approx(12 * 12 + 1.007825032)


def test_good_features_go_on_to_the_fixed_point(spark):
    # each round takes one more feature and one more sample off the end of a staircase
    cells = [(f"s{i:02d}", f"f{j:02d}", float(i * j % 7)) for i in range(40) for j in range(40) if abs(i - j) <= 1 or i + j < 12]
    features, samples = cohort.good_features_and_samples(spark.createDataFrame(cells, "sample string, feature string, value double"), 0.5, 4)
    kept = {r[0] for r in features.collect()}, {r[0] for r in samples.collect()}
    left = [c for c in cells if c[1] in kept[0] and c[0] in kept[1]]
    for feature in kept[0]:
        assert sum(c[1] == feature for c in left) >= max(4, 0.5 * len(kept[1]))


def test_linkage_needs_all_distances(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "item long")
    pairs = [(i, j, float(i + j)) for i in range(4) for j in range(i + 1, 4)]
    with pytest.raises(ValueError, match="distances"):
        linkage.average_linkage(items, spark.createDataFrame(pairs[1:], "i long, j long, d double"))
    apart = [linkage.average_linkage(items, spark.createDataFrame(pairs, "i long, j long, d double"), finish) for finish in (1, 512)]
    assert sorted(apart[0].collect()) == sorted(apart[1].collect())


def test_samples_without_a_cell_of_a_module_have_a_score(spark):
    cells = [(f"s{i}", f"f{j}", float((i * (j + 1)) % 5 + 1)) for i in range(6) for j in range(3)] + [("late", "f9", 1.0), ("s0", "f9", 2.0)]
    long = spark.createDataFrame(cells, "sample string, feature string, value double")
    numbers = network.number_features(long)
    module = numbers.select("feature_no", F.when(F.col("feature") == "f9", modules.NO_MODULE).otherwise(0).alias("module"))
    pairs = network.correlations(long, numbers, 7)
    scores = modules.eigengenes(long, numbers, module, pairs, 7).collect()
    assert {r["sample"] for r in scores} == {f"s{i}" for i in range(6)} | {"late"}
    assert sum(r["score"] for r in scores) == pytest.approx(0.0, abs=1e-9)


def test_quartiles_of_a_heavy_tail(spark):
    values = [(float(i % 5000) / 5000,) for i in range(20_000)] + [(10.0**k,) for k in range(12)]
    frame = spark.createDataFrame(values, "v double").withColumn("g", F.lit(None).cast("string"))
    found = quantiles.quantiles(frame, ["g"], "v", q=0.5, top=0.9999).first()
    want = np.quantile([v for v, in values], [0.5, 0.9999])
    assert [found["q"], found["top"]] == pytest.approx(list(want))


def test_unknown_features_are_not_dropped_in_silence(spark):
    long = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0)], "sample string, feature string, value double")
    assert cohort.to_wide(long, ["sample"]).collect() == [("s", 1.0, 2.0)]
    with pytest.raises(Exception, match="unknown feature: b"):
        cohort.to_wide(long, ["sample"], ["a"]).collect()
