import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ionloom.plans import annotate


@pytest.fixture(scope="module")
def inputs(spark):
    """Two runs against a library of five PC and one PE entries, two levels each."""
    entries, fragments, spectra, peaks = [], [], [], []
    lid = sid = 0
    for k in range(6):
        name, mz = (f"PC {14 + k}:0_16:1", 700.0 + 14 * k) if k < 5 else ("PE 16:0_18:1", 850.0)
        for level in (1, 2):
            lid += 1
            title = f"LEVEL{level}_DES_{name}-Fomula-C{38 + k}H{70 + 2 * k}NO8P-CCS-0-Add-[M+H]+"
            entries.append((lid, mz, title))
            fragments += [(lid, 100.0 + k + 10 * level), (lid, 200.0 + k + 10 * level)]
        for file in ("run_a", "run_b"):
            sid += 1
            spectra.append((sid, file, sid, mz, 2.0 + k))
            peaks += [(sid, n, m + k, x) for n, (m, x) in enumerate([(110.0, 50.0), (210.0, 30.0), (120.0, 20.0), (400.0, 1.0)])]
    return (
        spark.createDataFrame(spectra, "sid long, file string, num long, precursor_mz double, rt double"),
        spark.createDataFrame(peaks, "sid long, scan_no int, mz double, intensity double"),
        spark.createDataFrame(entries, "lid long, lib_mz double, title string"),
        spark.createDataFrame(fragments, "lid long, frag_mz double"),
    )


def test_hierarchical_job(spark, inputs):
    found = annotate.hierarchical_matches(*inputs, esi="p", ppm1=5, ppm2=30, intensity_fraction=0.1)
    rows = found.collect()
    assert len(rows) == 12 and {r.x for r in rows} == set(range(1, 13))
    row = next(r for r in rows if r.title == "PC 14:0_16:1")
    # level 1 matches both fragments; level 2 one of two
    assert row.score_match == pytest.approx((1.0 + 0.5) / 2)
    assert row.score_ratio == pytest.approx((0.8 + 0.2) / 2)
    assert (row.subclass, row.total_c, row.total_uns, row.adduct) == ("PC", 30.0, "1;", "[M+H]+")
    out = annotate.rank_annotations(found).collect()
    assert {r.file for r in out} == {"run_a", "run_b"} and {r.top_n for r in out} == {"Top 1"}
    assert all(r.rule1_stand > 0.5 for r in out if r.subclass == "PC")
    assert all(r.rule1_stand == 0.5 for r in out if r.subclass == "PE")


def test_hierarchical_job_exchanges_few_matches_once(spark, inputs):
    spectra, peaks, library, fragments = inputs
    settings = {"esi": "p", "ppm1": 5, "ppm2": 30, "intensity_fraction": 0.1}
    plain = sorted(map(tuple, annotate.hierarchical_candidates(*inputs, **settings).collect()))
    # every entry fifty times, each fifth copy without its first fragments; levels 1 and 3, 2 and 4 are of one family
    copies = lambda frame: frame.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("lid", F.col("lid") + 1000 * F.col("copy"))
    level = F.when(F.col("copy") % 2 == 1, F.translate("title", "12", "34")).otherwise(F.col("title"))
    many = copies(library).withColumn("title", F.concat(F.substring(level, 1, 6), F.substring("title", 7, 200))).drop("copy")
    parts = copies(fragments).filter("copy % 5 < 4 or frag_mz > 200").drop("copy")
    found = annotate.hierarchical_candidates(spectra, peaks, many, parts, **settings)
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == len(plain) == 12 and {r[:10] for r in rows} == {r[:10] for r in plain}
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")].splitlines()
    sent = [line for line in above if "Exchange hashpartitioning(file" in line]
    # one exchange for the levels and the ranks
    assert len(sent) == 1 and "REPARTITION_BY_COL" in sent[0]
    entries = annotate.describe_library(many, strip_database=False).withColumn("_allowed", F.lit(True))
    few = annotate._matched(spectra, peaks, None, 0.1, entries, parts, 5, 30, 0.5).count()
    assert few <= 12 * 4 and annotate._matched(spectra, peaks, None, 0.1, entries, parts, 5, 30).count() > 10 * few


def test_flat_job(spark, inputs):
    spectra, peaks, library, fragments = inputs
    library = library.withColumn("title", F.concat(F.lit("DB#: "), F.regexp_replace("title", ".*_DES_", "")))
    assert annotate.flat_matches(spectra, peaks, library, fragments, "p", 5, 30).count() == 24
    assert annotate.flat_matches(spectra, peaks, library, fragments, "n1", 5, 30).count() == 0
    negative = library.withColumn("title", F.replace("title", F.lit("[M+H]+"), F.lit("[M+HCOO]-")))
    assert annotate.flat_matches(spectra, peaks, negative, fragments, "n1", 5, 30).count() == 24
    assert annotate.flat_matches(spectra, peaks, negative, fragments, "n2", 5, 30).count() == 0
    assert annotate.flat_matches(spectra, peaks, negative, fragments, "n2", 5, 30, by_title=True).count() == 0
    assert annotate.flat_matches(spectra, peaks, negative, fragments, "p", 5, 30, min_coverage=0.9, by_title=True).count() == 12


def test_library_texts_are_parsed_once(spark, inputs):
    spectra, peaks, library, fragments = inputs
    flat = library.withColumn("title", F.concat(F.lit("DB#: "), F.regexp_replace("title", ".*_DES_", "")))
    for found in (annotate.flat_candidates(spectra, peaks, flat, fragments, "p", 5, 30), annotate.hierarchical_candidates(*inputs, "p", 5, 30, 0.1)):
        plan = found._jdf.queryExecution().executedPlan().toString().lower()
        # the entries come from what was written, not from the titles
        assert "_des_" not in plan and "db#" not in plan and found.count() in (12, 24)


def test_workers_need_no_installed_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from pyspark.sql import SparkSession\n"
        "from ionloom import tune\n"
        "from ionloom.operators import network\n"
        "spark = tune(SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate())\n"
        "long = spark.createDataFrame([(1, 'a', 2.0), (1, 'b', 3.0)], 'sample long, feature string, value double')\n"
        "print(network.pair_sums(long, network.number_features(long), 'product').count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[-1:] == ["3"], done.stderr[-2000:]


def test_boosted_query_trains_all_rounds(spark, monkeypatch):
    from ionloom.operators import classify
    from ionloom.plans.catalogue import QUERIES

    asked, real = [], classify.GBTClassifier
    monkeypatch.setattr(classify, "GBTClassifier", lambda **settings: asked.append(settings) or real(**{**settings, "maxIter": 1}))
    QUERIES["boosted_confusion"](spark, "/root/testdata/sf0.001")
    assert [(s["maxIter"], s["stepSize"], s["maxDepth"]) for s in asked] == [(210, 0.01, 5)]
    assert spark.sparkContext.getCheckpointDir() and asked[0]["checkpointInterval"] > 0
