"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "describe_numeric",
    "describe_categorical",
    "missing_analysis",
    "duplicate_summary",
    "histogram",
    "correlation_matrix",
    "pair_correlations_wide",
    "ordinal_spearman",
    "value_counts",
    "categorical_summary",
    "target_rates",
    "per_class_feature_stats_three",
    "cohens_d_ranking",
    "stratified_sample",
    "eta_squared_by_class",
    "cramers_v",
    "mutual_information_regression",
    "feature_associations_classes",
    "interaction_signals",
    "run_quality_rules",
    "assemble_findings",
]


def whole_profile(spark, sf: str) -> None:
    """Every result table of one call over lineitem."""
    from tabscope import profile

    key = ["l_orderkey", "l_linenumber"]
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(*key, *numbers, "l_returnflag", "l_linestatus")
    for rows in profile(df, target="l_returnflag", duplicates=0, key=key).values():
        rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Whatever the session prints must not mix with the one line of the result.
    out = os.dup(1)
    os.dup2(2, 1)
    from catalog.check import make_session
    from catalog.queries import QUERIES

    spark = make_session(cpus)
    QUERIES["missing_total"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds, jobs = {}, {}

    def timed(name: str, run) -> None:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        print(name, seconds[name], jobs[name], file=sys.stderr, flush=True)

    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    # Beside the total, which stays comparable between rounds.
    total = round(sum(seconds.values()), 3)
    timed("profile", lambda: whole_profile(spark, sf))
    spark.stop()
    result = {
        "metric": "profiling_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "jobs": jobs,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    os.write(out, (json.dumps(result) + "\n").encode())


if __name__ == "__main__":
    main()
