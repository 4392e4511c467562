"""Headline queries, timed: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siltworks import catalog  # noqa: E402
from siltworks.session import build_session  # noqa: E402

HEADLINE = (
    "full_profile",
    "quality_score",
    "semantic_warnings",
    "anomaly_summary",
    "value_histogram",
    "null_co_occurrence",
    "correlation_scan",
    "cross_column_frequency",
    "temporal_ordering",
    "detect_all",
    "detect_duplicates",
    "near_duplicates",
    "recipe_replay",
    "cleaning_passes",
    "frequency_encoding",
    "stratified_split",
    "roc_auc",
    "macro_f1",
    "node_durations",
    "span_timeline",
    "retry_sequences",
    "classify_lines",
)
WARM_RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(WARM_RUNS + 1):
            t0 = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
