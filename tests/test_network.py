import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.operators import cohort, linkage, modules, network


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(2)
    shared = rng.normal(0, 1, (40, 2))
    data = 10 + np.column_stack([shared[:, i % 2] * 2 + rng.normal(0, 0.3, 40) for i in range(8)])
    rows = [(f"s{i}", f"f{j}", float(data[i, j])) for i in range(40) for j in range(8)]
    long = spark.createDataFrame(rows, "sample string, feature string, value double")
    return data, long, network.number_features(long)


def dense(pairs, value, n=8):
    out = np.zeros((n, n))
    for r in pairs.collect():
        out[r.i, r.j] = out[r.j, r.i] = r[value]
    return out


def off_diagonal(m):
    return m[~np.eye(len(m), dtype=bool)]


def test_correlation_and_overlap(spark, matrix):
    data, long, numbers = matrix
    pairs = network.correlations(long, numbers, 40)
    r = np.corrcoef(data.T)
    assert off_diagonal(dense(pairs, "r")) == pytest.approx(off_diagonal(r))
    for signed in (True, False):
        a = ((1 + r) / 2) ** 3 if signed else np.abs(r) ** 3
        np.fill_diagonal(a, 0)
        s = a if signed else a * np.sign(r)
        k = a.sum(0)
        expected = np.abs(s @ s + s) / (np.minimum.outer(k, k) + 1 - a)
        found = dense(network.topological_overlap(network.adjacency(pairs, 3, signed)), "tom")
        assert off_diagonal(found) == pytest.approx(off_diagonal(expected))


def test_pair_sums(spark, matrix):
    data, long, numbers = matrix
    whole = dense(network.pair_sums(long, numbers, "product"), "s")
    gaps = dense(network.pair_sums(long, numbers, "difference"), "s")
    assert whole == pytest.approx(data.T @ data)
    # samples that are cut by the end of an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert dense(network.pair_sums(long, numbers, "product"), "s") == pytest.approx(data.T @ data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert gaps == pytest.approx(np.abs(data[:, :, None] - data[:, None, :]).sum(0))


def test_many_blocks(spark):
    data = np.random.default_rng(6).integers(0, 5, (30, 600)).astype(float)
    rows = [(i, f"f{j:03d}", float(data[i, j])) for i in range(30) for j in range(600)]
    long = spark.createDataFrame(rows, "sample long, feature string, value double")
    pairs = network.pair_sums(long, network.number_features(long), "product")
    assert dense(pairs, "s", 600) == pytest.approx(data.T @ data)


def brute_linkage(d):
    groups, heights = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        best = min(
            ((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        )
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


def test_average_linkage(spark):
    x = np.random.default_rng(4).uniform(0, 1, (9, 3))
    d = np.abs(x[:, None] - x[None]).sum(-1)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(9) for j in range(i + 1, 9)], "i long, j long, d double")
    items = spark.range(9).withColumnRenamed("id", "item")
    for finish in (512, 4):
        merges = linkage.average_linkage(items, pairs, finish=finish)
        assert sorted(r.height for r in merges.collect()) == pytest.approx(sorted(brute_linkage(d)))
    cut = sorted(brute_linkage(d))[4] + 1e-9
    assert linkage.cut_tree(items, merges, cut).select("cluster").distinct().count() == 9 - 5


def test_modules(spark, matrix):
    data, long, numbers = matrix
    pairs = network.correlations(long, numbers, 40)
    overlap = network.topological_overlap(network.adjacency(pairs, 6))
    found = modules.detect_modules(numbers, overlap, 0.9, min_size=3)
    groups = {}
    for r in found.join(numbers, "feature_no").collect():
        groups.setdefault(r.module, set()).add(r.feature)
    assert sorted(map(sorted, groups.values())) == [["f0", "f2", "f4", "f6"], ["f1", "f3", "f5", "f7"]]
    scores = modules.eigengenes(long, numbers, found, pairs, 40)
    module = next(m for m, names in groups.items() if "f0" in names)
    got = {r["sample"]: r.score for r in scores.collect() if r.module == module}
    z = data[:, ::2]
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    expected = z @ np.linalg.svd(z, full_matrices=False)[2][0]
    assert abs(np.corrcoef(expected, [got[f"s{i}"] for i in range(40)])[0, 1]) == pytest.approx(1.0)
    merged = modules.merge_modules(found, scores, 40)
    assert merged.select("module").distinct().count() == 2


def test_cohort(spark):
    neg = spark.createDataFrame([("s1", "HD", "a", 1.0), ("s2", "BC", "a", 2.0), ("q", "QC", "a", 1.0)], "sample string, class string, feature string, value double")
    pos = spark.createDataFrame([("s1", "HD", "a", 9.0), ("s1", "HD", "b", 3.0), ("q", "QC", "b", 1.0)], "sample string, class string, feature string, value double")
    merged = cohort.merge_modes(neg, pos)
    assert {(r["sample"], r.feature, r.value) for r in merged.collect()} == {("s1", "a", 1.0), ("s1", "b", 3.0)}
    rows = spark.createDataFrame([("x.1_Center2", "HD", "a", 1.0), ("\tTEST-7", "BC", "a", 1.0)], "sample string, class string, feature string, value double")
    ready = {r["sample"]: (r.label, r.cohort, r.value) for r in cohort.prepare_classes(rows).collect()}
    assert ready == {"x-1": (0, "1393 cohort", 0.0), "7": (1, "333 cohort", 0.0)}
    assert cohort.drop_features(rows.withColumn("feature", F.lit("FFA-d3 18:0"))).count() == 0
    wide = cohort.to_wide(merged, ["sample"], ["a", "b"])
    assert cohort.to_long(wide, ["sample"]).count() == 2


def test_good_features(spark):
    rows = [(f"s{i}", f, float(i) if f != "flat" else 1.0) for i in range(6) for f in ("x", "y", "flat")]
    rows += [("s0", "rare", 1.0)]
    features, samples = cohort.good_features_and_samples(spark.createDataFrame(rows, "sample string, feature string, value double"))
    assert {r.feature for r in features.collect()} == {"x", "y"} and samples.count() == 6


def leading(spark, matrix, groups):
    n = len(matrix)
    pairs = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, r double")
    module = spark.createDataFrame(list(enumerate(groups)), "feature_no long, module long")
    return {r.feature_no: r.loading for r in modules.leading_vectors(module, pairs).collect()}


def largest(matrix):
    vector = np.linalg.eigh(matrix)[1][:, -1]
    side = round(vector.sum(), 9) or vector[0]
    return vector if side >= 0 else -vector


def test_leading_vectors(spark):
    rng = np.random.default_rng(8)
    r = np.corrcoef(rng.normal(0, 1, (60, 12)) + rng.normal(0, 0.7, (60, 1)), rowvar=False)
    groups = [0] * 7 + [1] * 3 + [modules.NO_MODULE, 5]
    got = leading(spark, r, groups)
    assert [got[i] for i in range(7)] == pytest.approx(list(largest(r[:7, :7])), abs=1e-9)
    assert [got[i] for i in range(7, 10)] == pytest.approx(list(largest(r[7:10, 7:10])), abs=1e-9)
    assert 10 not in got and got[11] == pytest.approx(1.0)


def test_leading_vector_that_a_vector_of_ones_never_meets(spark):
    got = leading(spark, np.array([[1, -0.5], [-0.5, 1]]), [3, 3])
    assert [got[0], got[1]] == pytest.approx([0.5**0.5, -(0.5**0.5)], abs=1e-9)


def test_leading_vector_of_a_large_module(spark):
    rng = np.random.default_rng(9)
    n = 2000
    data = rng.normal(0, 1, (50, n)) + 0.8 * rng.normal(0, 1, (50, 1)) + 0.6 * rng.normal(0, 1, (50, 1)) * rng.choice([-1, 1], n)
    r = np.corrcoef(data, rowvar=False)
    i, j = np.triu_indices(n, 1)
    pairs = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "r": r[i, j]}))
    module = spark.range(n).select(F.col("id").alias("feature_no"), F.lit(0).cast("long").alias("module"))
    got = modules.leading_vectors(module, pairs).toPandas().sort_values("feature_no")
    assert got["loading"].to_numpy() == pytest.approx(largest(r), abs=1e-8)


def test_constant_features_and_no_modules(spark):
    cells = [(i, f, v) for i in range(5) for f, v in (("a", float(i)), ("b", float(i * i)), ("flat", 2.0))]
    long = spark.createDataFrame(cells, "sample long, feature string, value double")
    numbers = network.number_features(long)
    pairs = network.correlations(long, numbers, 5)
    assert sorted(r.r is None for r in pairs.collect()) == [False, True, True]
    overlap = network.topological_overlap(network.adjacency(pairs, 2)).collect()
    assert sorted(r.tom > 0 for r in overlap) == [False, False, True]
    one = numbers.select("feature_no", F.lit(0).cast("long").alias("module"))
    scores = modules.eigengenes(long, numbers, one, pairs, 5).collect()
    z = np.array([[i, i * i] for i in range(5)], dtype=float)
    z = ((z - z.mean(0)) / z.std(0, ddof=1)).sum(1) / 2**0.5
    assert [r.score for r in sorted(scores, key=lambda r: r["sample"])] == pytest.approx(list(z))
    none = one.withColumn("module", F.lit(modules.NO_MODULE).cast("long"))
    assert modules.eigengenes(long, numbers, none, pairs, 5).count() == 0


def test_pair_sums_of_odd_cells(spark):
    cells = [(1, "a", 2.0), (1, "a", 1.0), (1, "b", 4.0), (2, "b", None), (2, "a", 5.0), (None, "a", 1.0), (None, "b", 6.0)]
    long = spark.createDataFrame(cells, "sample long, feature string, value double")
    numbers = network.number_features(long)
    assert dense(network.pair_sums(long, numbers, "product"), "s", 2).tolist() == [[35.0, 18.0], [18.0, 52.0]]
    assert dense(network.pair_sums(long, numbers, "difference"), "s", 2)[0, 1] == 1.0 + 5.0 + 5.0
    assert network.pair_sums(long.limit(0), numbers, "product").count() == 0
