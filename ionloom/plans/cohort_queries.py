"""Queries over cohort tables: modes, filters, networks and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import classify, cohort, linkage, modules, network
from ionloom.operators.quantiles import quantiles
from ionloom.plans.registry import query
from ionloom.session import checkpoint_dir
from ionloom.sources import derived as d


_MODES = """
    WITH joined AS (
      SELECT o_custkey, c_mktsegment, l_linestatus, l_returnflag, p_type, p_brand, l_quantity
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey),
    classed AS (
      SELECT *, 'S.' || o_custkey || '_Center' || (o_custkey % 4) AS sample,
             CASE c_mktsegment WHEN 'MACHINERY' THEN 'QC' WHEN 'BUILDING' THEN 'HD' ELSE 'BC' END AS class FROM joined),
    neg AS (SELECT sample, class, p_type AS feature, sum(l_quantity) AS value FROM classed WHERE l_linestatus = 'F' GROUP BY ALL),
    pos AS (
      SELECT sample, class, CASE WHEN l_returnflag = 'N' THEN p_type ELSE p_brand END AS feature, sum(l_quantity) AS value
      FROM classed WHERE l_linestatus = 'O' GROUP BY ALL),
    n1 AS (SELECT * FROM neg WHERE class <> 'QC'), p1 AS (SELECT * FROM pos WHERE class <> 'QC'),
    merged AS (
      SELECT * FROM n1 WHERE sample IN (SELECT sample FROM p1)
      UNION ALL
      SELECT p1.sample, c.class, p1.feature, p1.value FROM p1 JOIN (SELECT DISTINCT sample, class FROM n1) c USING (sample)
      WHERE p1.feature NOT IN (SELECT feature FROM neg))"""


def _modes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", "l_quantity")
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = d.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    parts = d.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    joined = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    segment = F.col("c_mktsegment")
    rows = joined.select(
        F.concat(F.lit("S."), F.col("o_custkey").cast("string"), F.lit("_Center"), (F.col("o_custkey") % 4).cast("string")).alias("sample"),
        F.when(segment == "MACHINERY", "QC").when(segment == "BUILDING", "HD").otherwise("BC").alias("class"),
        "l_linestatus", "l_returnflag", "p_type", "p_brand", "l_quantity",
    )
    total = F.sum("l_quantity").alias("value")
    negative = rows.filter("l_linestatus = 'F'").groupBy("sample", "class", F.col("p_type").alias("feature")).agg(total)
    name = F.when(F.col("l_returnflag") == "N", F.col("p_type")).otherwise(F.col("p_brand"))
    positive = rows.filter("l_linestatus = 'O'").groupBy("sample", "class", name.alias("feature")).agg(total)
    return negative, positive


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.merge_modes(*_modes(spark, sf_dir))


@query("modes_merge", _MODES + " SELECT sample, class, feature, value FROM merged")
def modes_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(
    "log_transform",
    _MODES + """
    SELECT replace(regexp_replace(sample, '_Center.*', ''), '.', '-') AS sample, CAST(CASE WHEN class = 'HD' THEN 0 ELSE 1 END AS INTEGER) AS label,
           CASE WHEN sample LIKE '%TEST%' THEN '333 cohort' ELSE '1393 cohort' END AS cohort, feature, round(ln(value), 6) AS value
    FROM merged
    """,
)
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.prepare_classes(_merged(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "feature_name_filter",
    _MODES + " SELECT sample, class, feature, value FROM neg WHERE NOT regexp_matches(feature, 'ECON')",
)
def feature_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.drop_features(_modes(spark, sf_dir)[0], "ECON")


@query(
    "exact_quartiles",
    """
    SELECT l_returnflag AS grp, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
    FROM lineitem GROUP BY l_returnflag
    """,
)
def exact_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp")
    found = quantiles(rows, ["grp"], "l_extendedprice", q1=0.25, q2=0.5, q3=0.75)
    return found.select("grp", "n", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")])


@query(
    "iqr_mask_samples",
    _MODES + """,
    bounds AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM neg GROUP BY feature)
    SELECT sample, count(*) AS n_inside FROM neg JOIN bounds USING (feature) WHERE value BETWEEN q1 AND q3
    GROUP BY sample HAVING count(*) > 0.5 * (SELECT count(DISTINCT feature) FROM neg)
    """,
)
def iqr_mask_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.iqr_samples(_modes(spark, sf_dir)[0], fraction=0.5, of_samples=False)


@query(
    "spread_filter",
    _MODES + """,
    ordered AS (
      SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS k, count(*) OVER (PARTITION BY feature) AS n FROM pos),
    spreads AS (
      SELECT feature, max(value) FILTER (k = ceil(n * 0.75)) - max(value) FILTER (k = greatest(floor(n * 0.25), 1)) AS iqr
      FROM ordered GROUP BY feature)
    SELECT sample, class, feature, value FROM pos
    WHERE feature IN (SELECT feature FROM spreads WHERE iqr > (SELECT quantile_cont(iqr, 0.25) FROM spreads))
    """,
)
def spread_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.spread_filter(_modes(spark, sf_dir)[1], 0.25).select("sample", "class", "feature", "value")


@query(
    "confusion_matrix",
    "SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))
    return cohort.confusion(rows, "actual", "predicted")


@query(
    "frequent_keys",
    "SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600",
)
def frequent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"))
    return cohort.frequent(rows, "key", 600)


def _brand_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per customer and brand."""
    items = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = d.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    sales = joined.groupBy(F.col("o_custkey").alias("sample"), F.col("p_brand").alias("feature")).agg(
        F.sum("l_quantity").alias("value")
    )
    # the cohort matrix is read by every step, so it is written out once
    checkpoint_dir(spark)
    return sales.checkpoint()


_BRANDS_SQL = """
    WITH sales AS (
      SELECT o_custkey AS sample, p_brand AS feature, sum(l_quantity) AS value
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    samples AS (SELECT DISTINCT sample FROM sales), features AS (SELECT DISTINCT feature FROM sales),
    filled AS (
      SELECT s.sample, f.feature, coalesce(value, 0.0::DOUBLE) AS value FROM samples s CROSS JOIN features f
      LEFT JOIN sales USING (sample, feature)),
    pairs AS (
      SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS r
      FROM filled a JOIN filled b USING (sample) GROUP BY 1, 2)"""


def _brand_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    sales = _brand_sales(spark, sf_dir)
    numbers = network.number_features(sales)
    n_samples = sales.select("sample").distinct().count()
    # features by features, read by every later step
    pairs = network.correlations(sales, numbers, n_samples).checkpoint()
    return sales, numbers, pairs, n_samples


def _named(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    left = numbers.select(F.col("feature").alias("f1"), F.col("feature_no").alias("i"))
    right = numbers.select(F.col("feature").alias("f2"), F.col("feature_no").alias("j"))
    return pairs.join(left, "i").join(right, "j").drop("i", "j")


@query("corr_pairs", _BRANDS_SQL + " SELECT f1, f2, round(r, 6) AS r FROM pairs WHERE f1 < f2")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, _ = _brand_pairs(spark, sf_dir)
    return _named(pairs, numbers).select("f1", "f2", F.round("r", 6).alias("r"))


@query("corr_p_values")
def corr_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, n = _brand_pairs(spark, sf_dir)
    return _named(network.with_p_value(pairs, n), numbers).select("f1", "f2", F.round("p", 6).alias("p"))


@query(
    "connectivity",
    _BRANDS_SQL + """,
    net AS (SELECT f1, f2, pow(abs(r), 2) AS a, len(f1) = len(f2) AS same FROM pairs WHERE f1 <> f2)
    SELECT f1 AS feature, round(sum(a), 6) AS k_total, round(coalesce(sum(a) FILTER (same), 0), 6) AS k_within,
           round(sum(a) - coalesce(sum(a) FILTER (same), 0), 6) AS k_out, round(2 * coalesce(sum(a) FILTER (same), 0) - sum(a), 6) AS k_diff
    FROM net GROUP BY f1
    """,
)
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, _ = _brand_pairs(spark, sf_dir)
    groups = numbers.select("feature_no", F.length("feature").cast("bigint").alias("module"))
    degrees = network.connectivity(network.adjacency(pairs, 2, signed=False), groups).join(numbers, "feature_no")
    return degrees.select("feature", *[F.round(k, 6).alias(k) for k in ("k_total", "k_within", "k_out", "k_diff")])


_TOM_SQL = _BRANDS_SQL + """,
    net AS (SELECT f1, f2, pow((1 + r) / 2, 4) AS a FROM pairs WHERE f1 <> f2),
    degree AS (SELECT f1 AS f, sum(a) AS k FROM net GROUP BY f1),
    shared AS (SELECT x.f1, y.f2, sum(x.a * y.a) AS l FROM net x JOIN net y ON x.f2 = y.f1 WHERE x.f1 <> y.f2 GROUP BY 1, 2),
    tom AS (
      SELECT f1, f2, (l + a) / (least(p.k, q.k) + 1 - a) AS tom FROM net JOIN shared USING (f1, f2)
      JOIN degree p ON p.f = f1 JOIN degree q ON q.f = f2 WHERE f1 < f2)"""


@query("topological_overlap", _TOM_SQL + " SELECT f1, f2, round(tom, 6) AS tom FROM tom")
def topological_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, _ = _brand_pairs(spark, sf_dir)
    overlap = network.topological_overlap(network.adjacency(pairs, 4))
    return _named(overlap, numbers).select("f1", "f2", F.round("tom", 6).alias("tom"))


@query(
    "edge_threshold",
    _TOM_SQL.replace("(1 + r) / 2, 4", "(1 + r) / 2, 2") + " SELECT f1, f2, round(tom, 6) AS tom FROM tom WHERE tom > 0.2",
)
def edge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, _ = _brand_pairs(spark, sf_dir)
    overlap = network.edges(network.topological_overlap(network.adjacency(pairs, 2)), "tom")
    return _named(overlap, numbers).select("f1", "f2", F.round("tom", 6).alias("tom"))


@query(
    "manhattan_distances",
    _BRANDS_SQL + """
    SELECT a.feature AS f1, b.feature AS f2, round(sum(abs(a.value - b.value)), 4) AS distance
    FROM filled a JOIN filled b USING (sample) WHERE a.feature < b.feature GROUP BY 1, 2
    """,
)
def manhattan_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _brand_sales(spark, sf_dir)
    numbers = network.number_features(sales)
    sums = network.pair_sums(sales, numbers, "difference").filter("i < j")
    return _named(sums, numbers).select("f1", "f2", F.round("s", 4).alias("distance"))


def _merges_sql(name: str, distances: str) -> str:
    """Average linkage, one merge a step, of the table ``distances`` (i, j, d)."""
    return f"""
    {name}_steps AS (
      SELECT 0 AS step, i AS a, j AS b, d AS s, 1 AS na, 1 AS nb FROM {distances}
      UNION ALL
      SELECT step + 1, least(a2, b2), greatest(a2, b2), sum(s), if(a2 < b2, na2, nb2), if(a2 < b2, nb2, na2)
      FROM (
        SELECT *, if(a = gone, stay, a) AS a2, if(b = gone, stay, b) AS b2,
               if(a IN (stay, gone), both_n, na) AS na2, if(b IN (stay, gone), both_n, nb) AS nb2
        FROM (
          SELECT *, first_value(a) OVER w AS stay, first_value(b) OVER w AS gone, first_value(na + nb) OVER w AS both_n
          FROM {name}_steps
          WINDOW w AS (ORDER BY s / (na * nb), a, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
      WHERE a2 <> b2 GROUP BY ALL),
    {name} AS (
      SELECT step, a, b, s / (na * nb) AS height, na + nb AS size FROM {name}_steps
      QUALIFY row_number() OVER (PARTITION BY step ORDER BY s / (na * nb), a, b) = 1)"""


def _cut_sql(name: str, items: str, merges: str, height: float) -> str:
    """Cluster of each item: its smallest member, reached through the merges up to ``height``."""
    return f"""
    {name}_up AS (
      SELECT i AS item, i AS cluster FROM {items}
      UNION ALL
      SELECT item, a FROM {name}_up JOIN {merges} ON b = cluster AND height <= {height}),
    {name} AS (SELECT item, min(cluster) AS cluster FROM {name}_up GROUP BY item)"""


def _scores_sql(name: str, modules: str) -> str:
    """Leading vectors of the modules (item, cluster) by squaring their matrices, and the scores of the samples."""
    return f"""
    {name}_powers AS (
      SELECT 0 AS step, x.cluster, x.item AS i, y.item AS j, r AS m
      FROM {modules} x JOIN {modules} y USING (cluster) JOIN numbered_pairs p ON p.i = x.item AND p.j = y.item
      UNION ALL
      SELECT step + 1, cluster, i, j, m / max(abs(m)) OVER (PARTITION BY cluster)
      FROM (
        SELECT x.step, x.cluster, x.i, y.j, sum(x.m * y.m) AS m
        FROM {name}_powers x JOIN {name}_powers y ON x.cluster = y.cluster AND x.j = y.i WHERE x.step < 20 GROUP BY ALL)),
    {name}_columns AS (
      SELECT cluster, i, m, sum(m) OVER c AS side, sqrt(sum(m * m) OVER c) AS len
      FROM {name}_powers JOIN (
        SELECT cluster, arg_max(i, m) AS j FROM {name}_powers WHERE step = 20 AND i = j GROUP BY cluster) USING (cluster, j)
      WHERE step = 20 WINDOW c AS (PARTITION BY cluster)),
    {name} AS (
      SELECT cluster AS module, sample, sum(sign(side) * m / len * z) AS score
      FROM {name}_columns JOIN scaled USING (i) GROUP BY ALL)"""


_NUMBERED_SQL = """,
    items AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM features)"""

_GAPS_SQL = """,
    gaps AS (
      SELECT x.i, y.i AS j, sum(abs(a.value - b.value)) AS d
      FROM filled a JOIN filled b USING (sample) JOIN items x ON x.feature = a.feature JOIN items y ON y.feature = b.feature
      WHERE x.i < y.i GROUP BY ALL)"""


@query(
    "hierarchical_clusters",
    _BRANDS_SQL.replace("WITH", "WITH RECURSIVE", 1) + _NUMBERED_SQL + _GAPS_SQL + "," + _merges_sql("merges", "gaps")
    + " SELECT a, b, round(height, 4) AS height, size FROM merges",
)
def hierarchical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _brand_sales(spark, sf_dir)
    numbers = network.number_features(sales)
    distances = network.pair_sums(sales, numbers, "difference").filter("i < j").withColumnRenamed("s", "d")
    merges = linkage.average_linkage(numbers.select(F.col("feature_no").alias("item")), distances)
    return merges.select("a", "b", F.round("height", 4).alias("height"), "size")


_MODULES_SQL = (
    _TOM_SQL.replace("WITH", "WITH RECURSIVE", 1).replace("(1 + r) / 2, 4", "(1 + r) / 2, 1") + _NUMBERED_SQL + """,
    numbered_pairs AS (
      SELECT x.i, y.i AS j, if(x.i = y.i, 1.0::DOUBLE, r) AS r
      FROM pairs JOIN items x ON x.feature = f1 JOIN items y ON y.feature = f2),
    scaled AS (
      SELECT sample, i, (value - avg(value) OVER f) / stddev_samp(value) OVER f AS z
      FROM filled JOIN items USING (feature) WINDOW f AS (PARTITION BY feature)),
    far AS (SELECT x.i, y.i AS j, 1 - tom AS d FROM tom JOIN items x ON x.feature = f1 JOIN items y ON y.feature = f2),"""
    + _merges_sql("merges", "far") + "," + _cut_sql("cut", "items", "merges", 0.55) + """,
    found AS (SELECT * FROM cut QUALIFY count(*) OVER (PARTITION BY cluster) >= 2),"""
    + _scores_sql("scores", "found") + """,
    named AS (SELECT module, row_number() OVER (ORDER BY module) - 1 AS i FROM (SELECT DISTINCT module FROM scores)),
    apart AS (
      SELECT x.i, y.i AS j, 1 - corr(a.score, b.score) AS d FROM scores a JOIN scores b USING (sample)
      JOIN named x ON x.module = a.module JOIN named y ON y.module = b.module WHERE x.i < y.i GROUP BY ALL),"""
    + _merges_sql("joins", "apart") + "," + _cut_sql("joined", "named", "joins", 0.15) + """,
    merged AS (
      SELECT found.item, min(named.module) OVER (PARTITION BY joined.cluster) AS cluster
      FROM found JOIN named ON named.module = found.cluster JOIN joined ON joined.item = named.i),"""
    + _scores_sql("final", "merged")
)


@query("module_eigengenes", _MODULES_SQL + " SELECT module, sample, round(score, 6) AS score FROM final")
def module_eigengenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, numbers, pairs, n = _brand_pairs(spark, sf_dir)
    overlap = network.topological_overlap(network.adjacency(pairs, 1))
    found = modules.detect_modules(numbers, overlap, cut_height=0.55, min_size=2).checkpoint()
    scores = modules.eigengenes(sales, numbers, found, pairs, n)
    merged = modules.merge_modules(found, scores.checkpoint(), n)
    final = modules.eigengenes(sales, numbers, merged, pairs, n)
    return final.select("module", "sample", F.round("score", 6).alias("score"))


@query(
    "wide_cohort",
    "WITH sales AS (SELECT l_suppkey AS sample, l_returnflag AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
    " SELECT sample, max(value) FILTER (feature = 'A') AS A, max(value) FILTER (feature = 'N') AS N,"
    " max(value) FILTER (feature = 'R') AS R FROM sales GROUP BY sample",
)
def wide_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = d.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("feature")
    ).agg(F.sum("l_quantity").alias("value"))
    return cohort.to_wide(long, ["sample"], ["A", "N", "R"])


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    sales = _brand_sales(spark, sf_dir)
    brands = cohort.feature_names(sales)
    wide = cohort.to_wide(sales, ["sample"], brands).fillna(0.0)
    people = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample"), (F.col("c_acctbal") > 4500).cast("int").alias("label")
    )
    names = [f"lipid_{n}" for n in range(1, len(brands) + 1)]
    return wide.join(people, "sample").toDF("sample", *names, "label"), names


@query("forest_top_features")
def forest_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _labelled(spark, sf_dir)
    model = classify.random_forest(rows, names)
    return classify.top_features(classify.feature_importance(rows, model, names))


@query("boosted_confusion")
def boosted_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _labelled(spark, sf_dir)
    # one cohort trains, the other is told apart
    discovery, validation = rows.where("sample % 2 = 0"), rows.where("sample % 2 = 1")
    model = classify.boosted_trees(discovery, names)
    return cohort.confusion(classify.classify(validation, model, names), "label", "predicted")


@query("forest_confusion")
def forest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _labelled(spark, sf_dir)
    model = classify.random_forest(rows.where("sample % 2 = 0"), names)
    return cohort.confusion(classify.classify(rows.where("sample % 2 = 1"), model, names), "label", "predicted")


@query(
    "trait_correlations",
    """
    WITH sales AS (
      SELECT o_custkey AS sample, p_brand AS module, sum(l_quantity) AS score
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT module, 'balance' AS trait, round(corr(score, c_acctbal), 6) AS r, count(*) AS n
    FROM sales JOIN customer ON c_custkey = sample GROUP BY module
    """,
)
def trait_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _brand_sales(spark, sf_dir).select("sample", F.col("feature").alias("module"), F.col("value").alias("score"))
    traits = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample"), F.lit("balance").alias("trait"), F.col("c_acctbal").alias("value")
    )
    return modules.trait_correlations(scores, traits).withColumn("r", F.round("r", 6))


@query("random_feature_subset")
def random_feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbers, pairs, _ = _brand_pairs(spark, sf_dir)
    subset = modules.random_features(numbers, size=10)
    return modules.subset_pairs(pairs, subset).select("i", "j", F.round("r", 6).alias("r"))


@query(
    "good_samples",
    """
    WITH sales AS (
      SELECT l_suppkey AS sample, l_linenumber::VARCHAR AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
    SELECT DISTINCT sample FROM sales
    """,
)
def good_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    rows = d.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("sample"), F.col("l_linenumber").cast("string").alias("feature")
    ).agg(F.sum("l_quantity").alias("value"))
    return cohort.good_features_and_samples(rows.checkpoint())[1]
