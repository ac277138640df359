"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from taxatrend.checks import all_checks  # noqa: E402
from taxatrend.checks.deliveries import write_pages  # noqa: E402
from taxatrend.checks.registry import corpus  # noqa: E402

#: Written tables, timed as the load; then the insights and a few report, ingest and scoring queries over them.
LOAD = ["taxa", "datasets", "rules", "occurrences", "effort", "tiers", "visits"]
QUERIES = [
    "i1_silent_national", "i1_silent_regional", "i2_range_change_aoo", "i2_range_change_full", "i3_reporting_rate_national", "i3_reporting_rate_regional",
    "i4_co_movement", "i5_notable_records", "j9_nearest_prior", "a8_extent_of_occurrence", "j3_taxon_tiers", "j8_managed_rule_match", "a24_corpus_facts", "a27_monthly_currency",
    "s1_paged_json_scan", "p9_canonical_projection", "a13_field_coverage", "k1_merge_partitions", "a14_free_text_bands", "c2_bulk_adapt", "j24_grounded_numbers", "a33_grounding_rates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_checks().QUERIES, {}
    c = corpus(spark, sf_dir)
    for name in LOAD:
        t = time.perf_counter()
        getattr(c, name)
        times[f"load_{name}"] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    write_pages(c)  # the delivery the ingest queries read
    times["load_delivery"] = round(time.perf_counter() - t, 3)
    for name in QUERIES:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total time of load and headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
