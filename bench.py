"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs in full into a no-op sink, once to warm up and then ``REPEAT`` times; the least time counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "agg01_status_breakdown", "agg03_dimension_slices", "agg04_any_sample_collapse", "agg06_pass_at_k_tasks", "agg10_transition_matrix", "agg12_leave_one_out", "agg13_numeric_summary", "agg14_token_cost_rollup",
    "joi04_task_expansion", "joi06_direction_paired_cells", "joi08_gap_analysis", "joi11_spec_lookups", "joi12_cross_model_agreement", "joi14_band_match", "set04_bag_difference", "sta01_wilson", "sta04_chi_squared",
    "sta07_mcnemar", "sta08_cochran_armitage", "sta09_spearman", "win01_quartile_tiers", "win04_consecutive_failures", "top01_top_n", "cls01_build_taxonomy", "ver07_schema_audit", "flt06_balanced_subset", "agg17_frequency_distribution",
)
REPEAT = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyforge.plans import catalog

    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + REPEAT):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, total of best times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
