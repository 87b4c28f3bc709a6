"""Queries over titles, names and formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import filters, masses, titles
from ionloom.operators.groupstat import on_distinct
from ionloom.plans import sqlviews as v
from ionloom.plans.registry import query
from ionloom.sources import derived as d

KEY = ["q", "line", "price", "quantity"]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match records with the fields of their titles as columns."""
    rows = d.lipids(spark, sf_dir).withColumn("description", titles.description(F.col("title")))
    return rows.withColumns(titles.split_title(F.col("description")))


@query(
    "title_split",
    f"""
    WITH {v.LIPIDS}
    SELECT q, line, price, quantity, substr(title, instr(title, '_DES_') + 5) AS description, lipid_name AS name,
           lipid_formula AS formula, CAST(q % 9 AS VARCHAR) AS ccs, add_text AS adduct,
           CAST(CASE WHEN line % 4 IN (0, 2) THEN line % 4 + 1 ELSE 0 END AS INTEGER) AS odd_level,
           CAST(CASE WHEN line % 4 IN (1, 3) THEN line % 4 + 1 ELSE 0 END AS INTEGER) AS even_level
    FROM lipids
    """,
)
def title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.lipids(spark, sf_dir).withColumn("description", titles.description(F.col("title")))
    parts = titles.split_title(F.col("description"))
    return rows.select(
        *KEY, "description", *[c.alias(n) for n, c in parts.items()],
        titles.odd_level(F.col("title")).alias("odd_level"), titles.even_level(F.col("title")).alias("even_level"),
    )


@query(
    "title_fields_missing",
    f"""
    WITH {v.LIPIDS},
    cut AS (SELECT q, line, price, quantity, 'DB#: ' || substr(title, 1, len(title) - (q % 40)) AS text FROM lipids),
    one AS (SELECT *, replace(text, 'DB#: ', '') AS t FROM cut),
    two AS (SELECT *, string_split(t, '-Fomula-') AS f FROM one),
    three AS (SELECT *, string_split(f[2], '-CCS-') AS c FROM two),
    four AS (SELECT *, string_split(c[2], '-Add-') AS a FROM three)
    SELECT q, line, price, quantity, f[1] AS name, c[1] AS formula, a[1] AS ccs, a[2] AS adduct FROM four
    """,
)
def title_fields_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.lipids(spark, sf_dir).withColumn(
        "text",
        F.concat(F.lit("DB#: "), F.substring("title", F.lit(1), F.length("title") - (F.col("q") % 40).cast("int"))),
    )
    parts = titles.split_title(F.col("text"), strip_database=True)
    return rows.select(*KEY, *[c.alias(n) for n, c in parts.items()])


@query(
    "subclass_chain",
    f"""
    WITH {v.LIPIDS},
    named AS (SELECT *, lipid_name || CASE WHEN q % 4 = 0 THEN '_CAH_x y' ELSE '' END AS n FROM lipids)
    SELECT q, line, price, quantity, lipid_class AS subclass, substr(lipid_name, len(lipid_class) + 2) AS chain FROM named
    """,
)
def subclass_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("q") % 4 == 0, "_CAH_x y").otherwise("")
    rows = _named(spark, sf_dir).withColumn("name", F.concat("name", suffix))
    return rows.select(
        *KEY, titles.subclass(F.col("name")).alias("subclass"), titles.chain(F.col("name")).alias("chain")
    )


@query(
    "chain_totals",
    f"""
    WITH {v.LIPIDS}
    SELECT q, line, price, quantity, CAST(c1 + c2 AS DOUBLE) AS total_c,
           (u1 + u2) || ';' || CASE WHEN lipid_class = 'Cer' THEN 'O2' ELSE '' END AS total_uns, CAST(2 AS INTEGER) AS n_chains
    FROM lipids
    """,
)
def chain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = on_distinct(_named(spark, sf_dir), ["name"], lambda names: titles.add_name_columns(names, "name"))
    return rows.select(*KEY, "total_c", "total_uns", F.size(F.split("chain", "_")).alias("n_chains"))


@query(
    "chain_key",
    f"""
    WITH {v.LIPIDS},
    parts AS (
      SELECT *, (u1 + u2) || ';' || CASE WHEN lipid_class = 'Cer' THEN 'O2' ELSE '' END AS total_uns,
             list_sort([u1 || CASE WHEN lipid_class = 'Cer' THEN ';O2' ELSE '' END, CAST(u2 AS VARCHAR), 'ZZZ', 'ZZZ']) AS us
      FROM lipids)
    SELECT q, line, price, quantity, lipid_class || '*' || total_uns || '*' || array_to_string(us, '*') AS chain_cluster,
           us[1] AS fa1, us[2] AS fa2, us[3] AS fa3, us[4] AS fa4,
           lipid_class || total_uns || add_text AS cluster
    FROM parts
    """,
)
def chain_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keyed(names: DataFrame) -> DataFrame:
        parsed = titles.add_name_columns(names, "name").withColumn("us", titles.chain_unsaturations(F.col("chain")))
        return parsed.select(
            "name", "subclass", "total_uns",
            titles.chain_cluster(F.col("subclass"), F.col("total_uns"), F.col("chain")).alias("chain_cluster"),
            *[F.get("us", F.lit(i)).alias(f"fa{i + 1}") for i in range(4)],
        )

    rows = on_distinct(_named(spark, sf_dir), ["name"], keyed)
    return rows.select(
        *KEY, "chain_cluster", *[f"fa{i + 1}" for i in range(4)], F.concat("subclass", "total_uns", "adduct").alias("cluster")
    )


@query(
    "name_normalise",
    f"""
    WITH {v.LIPIDS},
    raw AS (
      SELECT q, line, price, quantity,
             lipid_class || CASE WHEN q % 3 = 0 THEN ' O-' WHEN q % 3 = 1 THEN ' P-' ELSE ' ' END || c1 || ':' || u1
             || CASE WHEN q % 5 = 0 THEN '-SN1' WHEN q % 5 = 1 THEN '(methyl)' WHEN q % 5 = 2 THEN '(OH)' ELSE '' END
             || '/N-' || c2 || ':' || u2
             || CASE WHEN q % 7 = 0 THEN '(FA 18:1)' WHEN q % 7 = 1 THEN '|AHexCer (O-18:1)' ELSE '' END AS name
      FROM lipids),
    a AS (
      SELECT *, replace(regexp_replace(replace(replace(replace(name, ' O-', '-O '), ' P-', '-P '), '-SN1', ''),
                        '\\(methyl\\)', '', 'g'), '/N-', '_') AS t FROM raw),
    b AS (SELECT *, split_part(t, '|', 1) AS total, split_part(t, '|', -1) AS last FROM a),
    c AS (
      SELECT *, replace(CASE WHEN contains(last, '(FA') THEN replace(regexp_replace(last, '\\(FA .*\\)', '', 'g'), ' ', '-FA ')
                             ELSE last END, 'AHexCer (O-', 'AHexCer-O ') AS meta_name FROM b)
    SELECT q, line, price, quantity, total, meta_name, split_part(meta_name, ' ', 1) AS subclass,
           replace(replace(replace(replace(split_part(meta_name, ' ', -1), 'OH)', 'OH'), ')', '_'), 'OH', 'OH)'), '/', '_') AS chain
    FROM c
    """,
)
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split(titles.chain(F.col("name")), "_")
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    q = F.col("q")
    name = F.concat(
        titles.subclass(F.col("name")),
        F.when(q % 3 == 0, " O-").when(q % 3 == 1, " P-").otherwise(" "),
        F.regexp_replace(first, ";O2", ""),
        F.when(q % 5 == 0, "-SN1").when(q % 5 == 1, "(methyl)").when(q % 5 == 2, "(OH)").otherwise(""),
        F.lit("/N-"),
        second,
        F.when(q % 7 == 0, "(FA 18:1)").when(q % 7 == 1, "|AHexCer (O-18:1)").otherwise(""),
    )
    rows = _named(spark, sf_dir).withColumn("name", name)
    return rows.select(*KEY, *[c.alias(n) for n, c in titles.normalise_name(F.col("name")).items()])


@query(
    "formula_mass",
    f"""
    WITH {v.LIPIDS}
    SELECT q, line, price, quantity, lipid_formula AS formula,
           round((c1 + c2 + 8) * 12.0::DOUBLE + ((c1 + c2) * 2 - (u1 + u2) * 2 + 16) * 1.007825032::DOUBLE
             + 14.003074004::DOUBLE + (6 + q % 4) * 15.99491462::DOUBLE + 30.973761998::DOUBLE, 6) AS mass
    FROM lipids
    """,
)
def formula_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.round(masses.formula_mass(F.col("formula")), 6).alias("mass")
    rows = on_distinct(_named(spark, sf_dir), ["formula"], lambda formulas: formulas.select("formula", mass))
    return rows.select(*KEY, "formula", "mass")


@query(
    "formula_mass_free_text",
    """
    WITH tokens AS (
      SELECT page_id, unnest(regexp_extract_all(url, '[A-Za-z][0-9]*')) AS t FROM pages),
    weighed AS (
      SELECT page_id, CASE upper(t[1]) WHEN 'H' THEN 1.007825032 WHEN 'C' THEN 12.0 WHEN 'O' THEN 15.99491462
               WHEN 'N' THEN 14.003074004 WHEN 'P' THEN 30.973761998 WHEN 'F' THEN 18.998403163 WHEN 'S' THEN 31.972071174
               ELSE 0.0 END::DOUBLE * coalesce(try_cast(substr(t, 2) AS DOUBLE), 1.0) AS m
      FROM tokens)
    SELECT p.page_id, round(coalesce(sum(m), 0.0::DOUBLE), 4) AS mass FROM pages p LEFT JOIN weighed USING (page_id) GROUP BY p.page_id
    """,
)
def formula_mass_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "pages").select(
        "page_id", F.round(masses.formula_mass(F.col("url")), 4).alias("mass")
    )


@query(
    "adduct_filters",
    f"""
    WITH {v.LIPIDS}
    SELECT q, line, price, quantity, add_text AS adduct,
           regexp_matches(add_text, '\\]\\+') AS keep_p,
           regexp_matches(add_text, '\\]-') AND add_text <> '[M+CH3COO]-' AS keep_n1,
           regexp_matches(add_text, '\\]-') AND add_text <> '[M+HCOO]-' AS keep_n2,
           title NOT LIKE '%CH3COO%' AS title_n1, title NOT LIKE '%HCOO%' AS title_n2
    FROM lipids
    """,
)
def adduct_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    return rows.select(
        *KEY, "adduct",
        *[filters.adduct_allowed(F.col("adduct"), esi).alias(f"keep_{esi}") for esi in ("p", "n1", "n2")],
        *[filters.title_allowed(F.col("title"), esi).alias(f"title_{esi}") for esi in ("n1", "n2")],
    )


@query(
    "score_thresholds",
    f"""
    WITH {v.LIPIDS}
    SELECT file, count(*) AS n_rows, count(*) FILTER (score1 >= 0.5) AS n_half, count(*) FILTER (score1 >= 0) AS n_all,
           count(*) FILTER (score1 <> 0 AND score2 <> 0) AS n_nonzero
    FROM lipids GROUP BY file
    """,
)
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.lipids(spark, sf_dir)
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(filters.at_least(F.col("score1"), 0.5)).alias("n_half"),
        F.count_if(filters.at_least(F.col("score1"), 0.0)).alias("n_all"),
        F.count_if((F.col("score1") != 0) & (F.col("score2") != 0)).alias("n_nonzero"),
    )
