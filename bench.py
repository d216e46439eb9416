"""Benchmark: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.catalog import load  # noqa: E402
from hindcast.session import local_session  # noqa: E402

HEADLINE = [
    "pr_file_upsert", "normalize_timeline", "membership_intervals", "asof_snapshot", "latest_head_files", "codeowners_rank",
    "popularity_rank", "truth_first_response", "hit_mrr", "gate_correlation", "multi_window_counts", "repo_priors", "hybrid_membership",
    "touched_prs", "pair_social",
]
REPEAT_BUDGET = 240  # seconds in which queries are repeated


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors
    seconds: dict[str, float] = {}
    began = time.perf_counter()
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs: list[float] = []
        # Three runs while the budget lasts, then one; the median counts.
        while len(runs) < (3 if time.perf_counter() - began < REPEAT_BUDGET else 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1]}))


if __name__ == "__main__":
    main()
