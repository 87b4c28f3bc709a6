"""Queries over match records: evidence, ranking, fusion, clustering and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import clusters, evidence, fusion, groupstat, ordered, polyfit
from ionloom.plans import annotate
from ionloom.plans import sqlviews as v
from ionloom.plans.registry import query
from ionloom.plans.spectral_queries import INTENSITY, MATCH_SQL, PPM1, PPM2
from ionloom.session import written
from ionloom.sources import derived as d

PEAK = ["file", "peak_num", "mz", "rt"]

_LEVELS = f"""
    WITH {v.LIPIDS},
    rows_kept AS (
      SELECT *, substr(title, instr(title, '_DES_') + 5) AS description, (line % 4) % 2 = 0 AS is_odd FROM lipids WHERE score1 >= 0.5)"""
_FAMILY = """
    max(CASE WHEN is_odd THEN score1 END) AS o1, max(CASE WHEN is_odd THEN score2 END) AS o2,
    max(CASE WHEN NOT is_odd THEN score1 END) AS e1, max(CASE WHEN NOT is_odd THEN score2 END) AS e2"""
_MEANS = """round((CASE WHEN o1 = 0.5 THEN 0.45 ELSE o1 END + e1) / 2, 6) AS score1, round((o2 + e2) / 2, 6) AS score2"""


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    for name, n in digits.items():
        df = df.withColumn(name, F.round(name, n))
    return df


@query(
    "evidence_levels",
    f"""{_LEVELS}, grouped AS (SELECT file, peak_num, mz, rt, description, {_FAMILY} FROM rows_kept GROUP BY 1, 2, 3, 4, 5)
    SELECT file, peak_num, mz, rt, description, {_MEANS} FROM grouped WHERE o1 IS NOT NULL AND e1 IS NOT NULL
    """,
)
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evidence.aggregate_levels(d.lipids(spark, sf_dir), PEAK), score1=6, score2=6)


@query(
    "evidence_islands",
    f"""{_LEVELS},
    stepped AS (
      SELECT *, lag(description) OVER w AS before FROM rows_kept WINDOW w AS (PARTITION BY file, peak_num, mz, rt ORDER BY price, line, quantity)),
    runs AS (
      SELECT *, sum(CASE WHEN before = description THEN 0 ELSE 1 END) OVER
        (PARTITION BY file, peak_num, mz, rt ORDER BY price, line, quantity ROWS UNBOUNDED PRECEDING) AS run FROM stepped),
    grouped AS (SELECT file, peak_num, mz, rt, run, description, {_FAMILY} FROM runs GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT file, peak_num, mz, rt, CAST(run AS BIGINT) AS run, description, {_MEANS} FROM grouped WHERE o1 IS NOT NULL AND e1 IS NOT NULL
    """,
)
def evidence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = evidence.aggregate_level_runs(
        d.lipids(spark, sf_dir), PEAK, ["price", "line", "quantity"], F.floor(F.col("price") / 20000)
    )
    return _rounded(runs, score1=6, score2=6)


@query(
    "topn_ties",
    f"""
    WITH {v.LIPIDS}
    SELECT DISTINCT file, peak_num, lipid_name AS name, score1, score2 FROM lipids
    QUALIFY rank() OVER (PARTITION BY file, peak_num, lipid_name ORDER BY round(score1 + score2, 6) DESC) = 1
    """,
)
def topn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.lipids(spark, sf_dir).withColumn("name", F.regexp_extract("title", "_DES_(.*)-Fomula-", 1))
    best = groupstat.top_ties(rows, ["file", "peak_num", "name"], F.round(F.col("score1") + F.col("score2"), 6))
    return best.select("file", "peak_num", "name", "score1", "score2").distinct()


@query(
    "title_best",
    f"""
    WITH {v.ANNOTATIONS}
    SELECT file, title, x, round(score_match + score_ratio, 6) AS score FROM annotations
    QUALIFY rank() OVER (PARTITION BY file, title ORDER BY round(score_match + score_ratio, 6) DESC) = 1
    """,
)
def title_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.annotations(spark, sf_dir).withColumn("score", F.round(F.col("score_match") + F.col("score_ratio"), 6))
    return fusion.best_per_title(rows, ["file", "title"], "score").select("file", "title", "x", "score")


_TIER = """
    best AS (SELECT file, title, min(r) AS k FROM ranked WHERE r <= 3 GROUP BY 1, 2)
    SELECT {columns}, CASE k WHEN 1 THEN 'Top 1' WHEN 2 THEN 'Top 2' WHEN 3 THEN 'Top 3' ELSE 'Top > 3' END AS top_n
    FROM ranked LEFT JOIN best USING (file, title)"""


@query(
    "tier_labels",
    f"""
    WITH {v.ANNOTATIONS},
    ranked AS (
      SELECT *, score_match + score_ratio AS score, rt AS peak,
             rank() OVER (PARTITION BY file, rt ORDER BY round(score_match + score_ratio, 6) DESC) AS r FROM annotations),
    {_TIER.format(columns="x, file, title")}
    """,
)
def tier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.annotations(spark, sf_dir).withColumn("score", F.round(F.col("score_match") + F.col("score_ratio"), 6))
    return fusion.tier_labels(rows, ["file"], "rt", "title", "score").select("x", "file", "title", "top_n")


@query(
    "match_tiers",
    MATCH_SQL + f""",
    named AS (
      SELECT sid, lid, file, name AS title, round(s1 + s2, 6) AS score FROM matched JOIN spectra USING (sid) JOIN library USING (lid)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY file, sid ORDER BY score DESC) AS r FROM named),
    {_TIER.format(columns="sid, lid, file, title, score")}
    """,
)
def match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = d.library(spark, sf_dir).withColumnRenamed("name", "title")
    return annotate.tiered_matches(d.spectra(spark, sf_dir), d.peaks(spark, sf_dir), entries, d.fragments(spark, sf_dir), PPM1, PPM2, INTENSITY)


@query(
    "first_label",
    f"""
    WITH {v.ANNOTATIONS}
    SELECT x, mz, rt, min(x) OVER (PARTITION BY mz, rt) AS label FROM annotations
    """,
)
def first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.annotations(spark, sf_dir).select("x", "mz", "rt")
    return groupstat.first_by(rows, ["mz", "rt"], "x", "x", "label")


@query(
    "row_numbers",
    f"""
    WITH {v.LIPIDS}
    SELECT q, line, price, quantity, row_number() OVER (ORDER BY q, line, price, quantity) AS x FROM lipids
    """,
)
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["q", "line", "price", "quantity"]
    return ordered.global_ordinal(d.lipids(spark, sf_dir).select(*keys), keys, "x")


@query(
    "min_label_filter",
    f"""
    WITH {v.ANNOTATIONS}
    SELECT x, file, title, adduct, rt FROM annotations
    QUALIFY rt = min(rt) OVER (PARTITION BY file, title, adduct)
    """,
)
def min_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = groupstat.keep_min(d.annotations(spark, sf_dir), ["file", "title", "adduct"], "rt")
    return kept.select("x", "file", "title", "adduct", "rt")


_ISLANDS = """
    SELECT {keys}, {x}, CAST(sum(CASE WHEN before IS NULL OR {gap} > {tol} THEN 1 ELSE 0 END)
      OVER (PARTITION BY {part} ORDER BY {x} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (
      SELECT *, lag({x}) OVER (PARTITION BY {part} ORDER BY {x}) AS before FROM {source})"""


@query(
    "sorted_cluster_abs",
    "WITH labelled AS ("
    + _ISLANDS.format(
        keys="l_partkey AS grp", x="l_extendedprice", gap="l_extendedprice - before", tol="250.0", part="l_partkey",
        source="(SELECT DISTINCT l_partkey, l_extendedprice FROM lineitem)",
    )
    + """)
    SELECT l_partkey AS grp, l.l_extendedprice AS value, l_orderkey AS id, cluster FROM lineitem l
    JOIN labelled c ON c.grp = l.l_partkey AND c.l_extendedprice = l.l_extendedprice
    """,
)
def sorted_cluster_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("grp"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("id")
    )
    return clusters.gap_clusters(rows, ["grp"], "value", 250.0, False, "cluster")


@query(
    "sorted_cluster_ppm",
    "WITH labelled AS ("
    + _ISLANDS.format(
        keys="l_returnflag AS grp", x="l_extendedprice", gap="(l_extendedprice - before) / before", tol="0.00002",
        part="l_returnflag", source="(SELECT DISTINCT l_returnflag, l_extendedprice FROM lineitem)",
    )
    + """)
    SELECT l_returnflag AS grp, l.l_extendedprice AS value, l_orderkey AS id, cluster FROM lineitem l
    JOIN labelled c ON c.grp = l.l_returnflag AND c.l_extendedprice = l.l_extendedprice
    """,
)
def sorted_cluster_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("id")
    )
    return clusters.gap_clusters(rows, ["grp"], "value", 2e-5, True, "cluster")


# every row points to the first row (by id) within tolerance; roots are counted in id order
_ORDER_CLUSTERS = """
    WITH RECURSIVE pts AS ({source}),
    pointers AS (
      SELECT p.grp, p.id, p.value, min(e.id) AS parent FROM pts p
      JOIN pts e ON e.grp = p.grp AND e.id <= p.id AND {near} GROUP BY ALL),
    climb AS (
      SELECT grp, id, parent AS node FROM pointers
      UNION ALL
      SELECT c.grp, c.id, p.parent FROM climb c JOIN pointers p ON p.grp = c.grp AND p.id = c.node AND p.parent <> c.node),
    roots AS (SELECT grp, id, min(node) AS root FROM climb GROUP BY ALL)
    SELECT grp, id, value, CAST(dense_rank() OVER (PARTITION BY grp ORDER BY root) AS INTEGER) AS cluster
    FROM roots JOIN pts USING (grp, id)"""


@query(
    "order_cluster_abs",
    _ORDER_CLUSTERS.format(
        source="SELECT user_id AS grp, event_id AS id, value FROM events", near="abs(e.value - p.value) <= 0.755"
    ),
)
def order_cluster_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("id"), "value"
    )
    return clusters.order_clusters(rows, ["grp"], "id", "value", 0.755, False, "cluster")


@query(
    "order_cluster_ppm",
    _ORDER_CLUSTERS.format(
        source="SELECT o_custkey AS grp, o_orderkey AS id, o_totalprice AS value FROM orders",
        near="abs(e.value - p.value) / e.value <= 0.05",
    ),
)
def order_cluster_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")
    )
    return clusters.order_clusters(rows, ["grp"], "id", "value", 0.05, True, "cluster")


@query(
    "minmax_scale",
    """
    SELECT event_id, user_id, CASE WHEN hi = lo THEN 1.0 ELSE round((value - lo) / (hi - lo), 6) END::DOUBLE AS scaled FROM (
      SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id, event_type))
    """,
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = groupstat.min_max_scale(d.table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "scaled")
    return scaled.select("event_id", "user_id", F.round("scaled", 6).alias("scaled"))


@query(
    "monotone_check",
    """
    WITH stepped AS (
      SELECT l_orderkey AS grp, l_extendedprice - lag(l_extendedprice) OVER
        (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_extendedprice) AS step FROM lineitem)
    SELECT grp, CAST(min(CASE WHEN step < 0 THEN 0 ELSE 1 END) AS INTEGER) AS rises FROM stepped GROUP BY grp
    """,
)
def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "grp")
    return ordered.is_monotone(
        rows, ["grp"], ["l_quantity", "l_linenumber", "l_extendedprice"], "l_extendedprice",
        F.floor(F.col("l_quantity") / 8), "rises",
    )


@query(
    "successive_differences",
    """
    SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events
    """,
)
def successive_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "events")
    stepped = ordered.previous_value(
        rows, ["user_id"], ["ts", "event_id"], "value", F.date_trunc("hour", "ts"), "before"
    )
    return stepped.select("event_id", "user_id", F.round(F.col("value") - F.col("before"), 6).alias("step"))


@query(
    "quad_fit_loss",
    """
    WITH pts AS (
      SELECT l_suppkey AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    centre AS (SELECT grp, avg(x) AS cx, avg(y) AS cy, count(*) AS n, count(DISTINCT x) AS nx FROM pts GROUP BY grp),
    z AS (SELECT grp, n, nx, cy, x - cx AS u, y - cy AS v FROM pts JOIN centre USING (grp)),
    m AS (
      SELECT grp, any_value(n)::DOUBLE AS n, any_value(nx) AS nx, any_value(cy) AS cy, sum(u*u) AS s2, sum(u*u*u) AS s3,
             sum(u*u*u*u) AS s4, sum(u*v) AS suv, sum(u*u*v) AS suuv, sum(v*v) AS svv FROM z GROUP BY grp),
    q AS (
      SELECT *, suv / s2 AS b1, (suuv - s3 / s2 * suv) AS top, (s4 - s3 * s3 / s2 - s2 * s2 / n) AS bottom FROM m WHERE nx >= 3)
    SELECT grp, round(1 + sqrt(svv - suv * suv / s2 - top * top / bottom) / (cy * n), 6) AS loss FROM q
    """,
)
def quad_fit_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    fits = polyfit.quadratic_fit(rows, ["grp"], "x", "y")
    return fits.select("grp", F.round("loss", 6).alias("loss"))


@query(
    "adjusted_r2_gate",
    """
    WITH pts AS (SELECT l_suppkey AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    centre AS (SELECT grp, avg(x) AS cx, avg(y) AS cy, count(*) AS n, count(DISTINCT x) AS nx FROM pts GROUP BY grp),
    z AS (SELECT grp, n, nx, x - cx AS u, y - cy AS v FROM pts JOIN centre USING (grp)),
    m AS (
      SELECT grp, any_value(n)::DOUBLE AS n, any_value(nx) AS nx, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4,
             sum(u*v) AS suv, sum(u*u*v) AS suuv, sum(v*v) AS svv FROM z GROUP BY grp),
    q AS (
      SELECT *, (suv * suv / s2 + pow(suuv - s3 / s2 * suv, 2) / (s4 - s3 * s3 / s2 - s2 * s2 / n)) / svv AS r2 FROM m WHERE nx >= 3)
    SELECT grp, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2, 1 - (1 - r2) * (n - 1) / (n - 3) > 0.6 AS usable FROM q
    """,
)
def adjusted_r2_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    fits = polyfit.quadratic_fit(rows, ["grp"], "x", "y")
    gate = F.coalesce(F.col("adjusted_r2"), F.lit(1.0)) > 0.6
    return fits.select("grp", F.round("adjusted_r2", 6).alias("adjusted_r2"), gate.alias("usable"))


_RULES = f"""
    WITH {v.ANNOTATIONS},
    r1 AS (SELECT x, round(abs(rt - 12.0) / 100, 4) AS rule1_score FROM annotations WHERE score_match >= 0.5),
    r2 AS (SELECT x, round(abs(rt - 9.0) / 150, 4) AS rule2_score FROM annotations WHERE score_ratio >= 0.3),
    fused AS (SELECT * FROM annotations LEFT JOIN r1 USING (x) LEFT JOIN r2 USING (x)),
    worst AS (
      SELECT *, max(CASE WHEN rule1_score > 0.05 THEN rule1_score END) OVER (PARTITION BY file) AS w1,
             max(CASE WHEN rule2_score > 0.05 THEN rule2_score END) OVER (PARTITION BY file) AS w2 FROM fused),
    stand AS (
      SELECT *, CASE WHEN rule1_score IS NULL THEN 0.5 WHEN rule1_score <= 0.05 THEN (0.05 - rule1_score) * 2.5 + 0.75
                     ELSE 0.25 - rule1_score / w1 * 0.25 END::DOUBLE AS t1,
             CASE WHEN rule2_score IS NULL THEN 0.5 WHEN rule2_score <= 0.05 THEN (0.05 - rule2_score) * 2.5 + 0.75
                     ELSE 0.25 - rule2_score / w2 * 0.25 END::DOUBLE AS t2 FROM worst)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read for both rules and for the rows
    base = written(d.annotations(spark, sf_dir))
    rule1 = base.filter("score_match >= 0.5").select("x", F.round(F.abs(F.col("rt") - 12.0) / 100, 4).alias("rule1_score"))
    rule2 = base.filter("score_ratio >= 0.3").select("x", F.round(F.abs(F.col("rt") - 9.0) / 150, 4).alias("rule2_score"))
    return fusion.fuse(base, rule1, rule2)


@query(
    "standardise_score",
    _RULES + " SELECT x, rule1_score, rule2_score, round(t1, 6) AS rule1_stand, round(t2, 6) AS rule2_stand FROM stand",
)
def standardise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _fused(spark, sf_dir).select("x", "rule1_score", "rule2_score", "rule1_stand", "rule2_stand")
    return _rounded(fused, rule1_stand=6, rule2_stand=6)


@query(
    "fuse_full_outer",
    _RULES + " SELECT x, file, title, round(score_match + score_ratio + t1 + t2, 6) AS final_score FROM stand",
)
def fuse_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fused(spark, sf_dir).select("x", "file", "title", "final_score"), final_score=6)


@query(
    "final_output",
    _RULES + """,
    scored AS (SELECT *, score_match + score_ratio + t1 + t2 AS f FROM stand),
    best AS (SELECT * FROM scored QUALIFY rank() OVER (PARTITION BY file, title ORDER BY f DESC) = 1),
    ranked AS (SELECT *, rank() OVER (PARTITION BY file, peak_num ORDER BY f DESC) AS r FROM best),
    tiers AS (SELECT file, title, min(r) AS k FROM ranked WHERE r <= 3 GROUP BY 1, 2)
    SELECT file, peak_num, title, adduct, round(f, 6) AS final_score,
           CASE k WHEN 1 THEN 'Top 1' WHEN 2 THEN 'Top 2' WHEN 3 THEN 'Top 3' ELSE 'Top > 3' END AS top_n
    FROM ranked LEFT JOIN tiers USING (file, title)
    """,
)
def final_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.final_output(_fused(spark, sf_dir))
    return _rounded(rows.select("file", "peak_num", "title", "adduct", "final_score", "top_n"), final_score=6)


@query(
    "fuse_without_rules",
    f"WITH {v.ANNOTATIONS} SELECT x, round(score_match + score_ratio + 1.0, 6) AS final_score FROM annotations",
)
def fuse_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = d.annotations(spark, sf_dir)
    none1 = base.filter("false").select("x", F.lit(0.0).alias("rule1_score"))
    none2 = base.filter("false").select("x", F.lit(0.0).alias("rule2_score"))
    return _rounded(fusion.fuse(base, none1, none2).select("x", "final_score"), final_score=6)


@query(
    "group_cardinality",
    f"""
    WITH {v.ANNOTATIONS},
    big AS (SELECT file, subclass, total_uns FROM annotations GROUP BY ALL HAVING count(DISTINCT total_c) >= 3)
    SELECT x FROM annotations JOIN big USING (file, subclass, total_uns)
    """,
)
def group_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["file", "subclass", "total_uns"]
    return groupstat.groups_with_at_least(d.annotations(spark, sf_dir), keys, ["total_c"], 3).select("x")


@query(
    "set_intersect",
    "SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
)
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "lineitem")
    ids = lambda flag: rows.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("id"))
    return ids("A").intersect(ids("R"))


@query(
    "set_diff",
    "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = d.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(urgent)


@query(
    "union_all",
    "SELECT c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT p_partkey, p_retailprice FROM part",
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = lambda name, key, value: d.table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(value).alias("v"))
    return groupstat.union_all(
        [take("customer", "c_custkey", "c_acctbal"), take("supplier", "s_suppkey", "s_acctbal"), take("part", "p_partkey", "p_retailprice")]
    )
