"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (3); its time is the median of a full run into a sink. Then
the five generated scenarios, the whole operation with its rows fetched: with BENCH_SWEEP=1 at all points, 2 runs to
warm up and 10 samples each, else at the largest points, 1 and 3. p50 and p95 stand under "scenarios".
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median, quantiles

from pyspark.sql import SparkSession

from quadlake.plans import scenarios
from quadlake.plans.queries import queries

HEADLINE = (
    "target_scan", "scalar_eq", "scalar_range", "enum_filter", "temporal_filter", "and_or_not", "relationship_filter", "nested_relationship_filter", "or_relationship_promotion", "optional_left", "required_children",
    "nested_struct", "nested_list", "nested_three_levels", "multi_branch", "flat_narrows", "page", "page_does_not_narrow", "path_sequence", "path_plus", "lang_chain", "default_value", "derived_exists", "derived_if_enum", "derived_relationship", "author_select", "author_aggregate",
)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, every = {}, queries()
    for name in HEADLINE:
        times = []
        for k in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - began)
        found[name] = round(median(times), 4)
        print(name, found[name], file=sys.stderr, flush=True)
    points = {}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for name, (_, _, _, _, sweep) in scenarios.SCENARIOS.items():
        for point in sweep if os.environ.get("BENCH_SWEEP") else list(sweep)[-1:]:
            engine, times = scenarios.prepared(spark, name, point), []
            warm, samples = (2, 10) if os.environ.get("BENCH_SWEEP") else (1, 3)
            for _ in range(warm + samples):
                began = time.perf_counter()
                scenarios.ask(engine, name).toArrow()
                times.append(time.perf_counter() - began)
            points[f"{name} {point}"] = {"p50": round(median(times[warm:]), 4), "p95": round(quantiles(times[warm:], n=20, method="inclusive")[-1], 4)}
            print(name, point, points[f"{name} {point}"], file=sys.stderr, flush=True)
            engine.source.quads.unpersist()
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf, "scenarios": points}))


if __name__ == "__main__":
    main()
