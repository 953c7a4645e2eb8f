"""Time registered queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8). ``python bench.py all`` or
query names time other selections than the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rungwork.plans.catalog import REGISTRY
from rungwork.session import build_session

HEADLINE = (
    "threshold_frontier",
    "arm_summary",
    "frontier_shift",
    "progressive_replay_full",
    "min_cost_hindsight",
    "strongest_solution",
    "curriculum_decisions",
    "rescue_by_variant",
    "causal_candidates",
    "pending_jobs",
    "nearest_size_control",
    "ring_control",
    "root_manifest_recovery",
    "key_problems",
    "admit_candidates",
    "numeric_grades",
    "job_table",
    "training_mix",
    "preconditioning_pairs",
    "importance_weights",
    "grouped_split",
    "routing_metrics",
    "probability_metrics",
    "eval_comparison",
    "stream_ingest",
    "stream_running_q",
    "stream_sequential_stop",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = sys.argv[1:]
    names = list(REGISTRY) if asked == ["all"] else (asked or [n for n in HEADLINE if n in REGISTRY])
    spark = build_session(cpus, "rungwork-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "rollout_analytics_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
