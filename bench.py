"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ionloom.session import get_session

HEADLINE = [
    "ppm_join",
    "ppm_anti_join",
    "spectrum_match_score",
    "match_tiers",
    "spectrum_assemble",
    "relative_intensity_filter",
    "library_peak_clean",
    "evidence_levels",
    "topn_ties",
    "formula_mass",
    "chain_totals",
    "sorted_cluster_ppm",
    "order_cluster_abs",
    "fuse_full_outer",
    "quad_fit_loss",
    "corr_pairs",
    "exact_quartiles",
    "rule1_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        "ionloom-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    # the catalogue needs a live session only to run, not to import
    from ionloom.plans.catalogue import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
