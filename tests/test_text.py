from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ionloom.functions import filters, masses, titles
from ionloom.plans.catalogue import QUERIES
from ionloom.sources import derived

FOLDER = Path("/root/testdata/sf0.001")


def one(spark, build, text):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "formula, mass",
    [("C42H82NO8P", 759.577805586), ("C63H101O6", 953.759815952), ("ch4", 16.031300128), ("Xe3", 0.0), ("", 0.0)],
)
def test_formula_mass(spark, formula, mass):
    assert one(spark, masses.formula_mass, formula) == pytest.approx(mass, abs=1e-9)


@pytest.mark.parametrize(
    "name, subclass, chain, carbons, unsaturation",
    [
        ("PC 16:0_18:1", "PC", "16:0_18:1", 34.0, "1;"),
        ("Cer 18:1;O2_24:0_CAH_x", "Cer", "18:1;O2_24:0", 42.0, "1;O2"),
        ("PE O-16:0_18:1", "PE", "O-16:0_18:1", 18.0, "1;"),
        ("X 18:1_16:0(OH)", "X", "18:1_16:0(OH)", 34.0, "1;(OH)"),
        ("X 18:1;O10", "X", "18:1;O10", 18.0, "1;O1"),
        ("X 1:1_2:1_3:1_4:1_5:1", "X", "1:1_2:1_3:1_4:1_5:1", 15.0, "5;"),
    ],
)
def test_name_columns(spark, name, subclass, chain, carbons, unsaturation):
    row = titles.add_name_columns(spark.createDataFrame([(name,)], "n string"), "n").first()
    assert (row.subclass, row.chain, row.total_c, row.total_uns) == (subclass, chain, carbons, unsaturation)


def test_chain_key(spark):
    assert one(spark, titles.chain_unsaturations, "16:0_18:1") == ["0", "1", "ZZZ", "ZZZ"]
    key = one(spark, lambda t: titles.chain_cluster(F.lit("PC"), F.lit("1;"), t), "18:1_16:0")
    assert key == "PC*1;*0*1*ZZZ*ZZZ"


def test_title_parts(spark):
    parts = titles.split_title(F.col("t"))
    row = spark.createDataFrame([("A-Fomula-C2H6O-CCS-1-Add-[M+H]+",), ("B-Fomula-C2",), ("C",)], "t string").select(
        *[c.alias(n) for n, c in parts.items()]
    ).collect()
    assert tuple(row[0]) == ("A", "C2H6O", "1", "[M+H]+")
    assert tuple(row[1]) == ("B", "C2", None, None)
    assert tuple(row[2]) == ("C", None, None, None)


def test_levels_and_description(spark):
    text = "LEVEL2x LEVEL3 LEVEL1_DES_n_DES_m"
    assert one(spark, titles.odd_level, text) == 3
    assert one(spark, titles.even_level, text) == 2
    assert one(spark, titles.description, text) == "n_DES_m"
    assert one(spark, titles.description, "none") == ""


@pytest.mark.parametrize(
    "name, expected",
    [
        ("PC O-16:0/N-18:1", ("PC-O 16:0_18:1", "PC-O 16:0_18:1", "PC-O", "16:0_18:1")),
        ("A 1:0|B 2:0-SN1", ("A 1:0", "B 2:0", "B", "2:0")),
        ("AC 1:0(FA 2:0)", ("AC 1:0(FA 2:0)", "AC-FA 1:0", "AC-FA", "1:0")),
        ("AHexCer (O-16:0)18:1(OH)", ("AHexCer (O-16:0)18:1(OH)", "AHexCer-O 16:0)18:1(OH)", "AHexCer-O", "16:0_18:1(OH)")),
    ],
)
def test_normalise_name(spark, name, expected):
    parts = titles.normalise_name(F.col("n"))
    row = spark.createDataFrame([(name,)], "n string").select(*[parts[k] for k in ("total", "meta_name", "subclass", "chain")]).first()
    assert tuple(row) == expected


def test_filters(spark):
    rows = spark.createDataFrame([("[M+H]+",), ("[M-H]-",), ("[M+HCOO]-",), ("[M+CH3COO]-",)], "a string")
    kept = lambda esi: {r.a for r in rows.filter(filters.adduct_allowed(F.col("a"), esi)).collect()}
    assert kept("p") == {"[M+H]+"}
    assert kept("n1") == {"[M-H]-", "[M+HCOO]-"}
    assert kept("n2") == {"[M-H]-", "[M+CH3COO]-"}
    with pytest.raises(ValueError):
        filters.adduct_allowed(F.col("a"), "x")
    scores = spark.createDataFrame([(0.5,), (0.4,), (float("nan"),), (None,)], "s double")
    assert scores.filter(filters.at_least(F.col("s"), 0.5)).count() == 1


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_names_are_parsed_once(spark):
    plan = QUERIES["chain_key"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[name" in plan


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_candidates_are_grouped_by_numbers(spark):
    plan = derived.annotations(spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate(keys=[q" in line]
    assert keys and not any("file" in k or "DES" in k for k in keys)


def test_candidates_without_numbers_stay(spark, tmp_path):
    rows = [(1, 2, 1, 0.1, 0.2), (1, 2, 2, 0.05, 0.3), (1, 2, None, 0.0, 0.0), (1, None, 1, 0.1, 0.1), (1, None, None, 0.2, 0.0)]
    kinds = "l_orderkey long, l_partkey long, l_linenumber int, l_discount double, l_tax double"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = derived.annotations(spark, str(tmp_path)).collect()
    assert sorted((str(r.x), r.title, r.score_match, r.score_ratio) for r in found) == [
        ("2", "", 0.4, 0.0), ("2", "TG 16:2_16:0", 1.0, 3.0), ("None", "", 1.6, 1.0),
    ]
