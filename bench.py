"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moodtide.queries import QUERIES  # noqa: E402
from moodtide.session import build_session  # noqa: E402

HEADLINE = (
    "clean_by_lang clean_text clean_pages html_text second_clean_nostem second_clean gate_batch tokenize ngrams "
    "vocab_topk term_counts job_fanout match_phrases_indexed job_status new_jobs validate_query last_per_ts "
    "chunk_mean5_seconds global_chunks class_report stream_clean_append stream_window10s "
    "job_trend results_trend match_phrases match_phrases_shuffled stream_fanout train_eval predict_lines stream_predict analyse_jobs"
).split()
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timings = []
        # One warm-up run, then the median of the others.
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timings[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
