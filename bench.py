"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beaconry.plans.registry import registered  # noqa: E402
from beaconry.session import build_session  # noqa: E402

HEADLINE = ["merge_candidates", "rank_snapshot", "star_growth", "balanced_order", "evidence_summary", "merge_signals", "action_state",
            "weekly_action_metrics", "decision_events", "balanced_personal_ranking", "search_topk", "contract_issues"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    queries = registered()
    # Start the JVM's code paths once before timing.
    queries["action_state"](spark, folder).limit(1).collect()
    spent = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
