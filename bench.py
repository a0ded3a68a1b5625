"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion into Spark's ``noop`` sink (nothing is
collected), once to warm up and then ``$BENCH_RUNS`` times (default 3); the
reported time is the median; ``build`` holds its part before the sink's job starts (building the DataFrame,
with the jobs of queries that write tables on the way). ``value`` is the sum of the medians.
``--all`` times every registered query once instead (a profiling aid).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "stg_events_dedup",
    "fact_application",
    "fact_offer",
    "fact_stage_transition",
    "mart_status_by_scope",
    "mart_exec_overview",
    "mart_exec_overview_by_scope",
    "mart_recruiter_performance",
    "mart_recruiter_workload",
    "mart_funnel",
    "mart_funnel_by_scope",
    "mart_sla_breaches",
    "mart_tth_diagnostics",
    "stage_transitions_fractional",
    "recruiter_sla_summary",
    "plan_stage_change_focused",
    "apply_hire_request",
    "ops_to_applications",
    "serve_overview_scoped",
    "dq_suite",
)


def run(query, spark, sf_dir) -> tuple[float, float]:
    """Seconds in all, and until the DataFrame is built."""
    t0 = time.perf_counter()
    df = query(spark, sf_dir)
    built = time.perf_counter() - t0
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0, built


def main() -> None:
    from talentlake.plans.catalog import QUERIES
    from talentlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]", shuffle_partitions=cpus,
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tl-bench-ckpt-")},
    )
    names = sorted(QUERIES) if "--all" in sys.argv else list(HEADLINE)
    timings: dict[str, float] = {}
    build: dict[str, float] = {}
    for name in names:
        if "--all" in sys.argv:
            timings[name], build[name] = (round(x, 3) for x in run(QUERIES[name], spark, sf_dir))
            print(f"# {name} {timings[name]}", file=sys.stderr, flush=True)
            continue
        run(QUERIES[name], spark, sf_dir)  # warm-up
        samples = [run(QUERIES[name], spark, sf_dir) for _ in range(runs)]
        timings[name], build[name] = (round(x, 3) for x in sorted(samples)[len(samples) // 2])
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "build": build,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": 1 if "--all" in sys.argv else runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
