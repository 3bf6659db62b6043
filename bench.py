"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and run to the end into a sink that keeps nothing, after one warm-up
query has started the JVM's code paths.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.plans.registry import QUERIES  # noqa: E402
from tracemill.session import local_session  # noqa: E402

HEADLINE = [
    "chat_positions", "arm_append", "last_user_rewrite", "trained_share", "list_append", "arm_counts",
    "group_split", "seeded_sample", "pairs_up_to_three", "preference_records", "final_answers", "mood_labels",
    "class_summary", "code_blocks", "fault_flags", "graded_code", "edited_files", "episodes", "case_pass_rates",
    "pooled_pass_rates", "flag_rates", "seed_table", "success_lift", "advantages", "signal_levels", "pass_at_k",
    "filter_waterfall", "normal_messages", "template_draws", "running_lift",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    QUERIES["complete_answers"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
