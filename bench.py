"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)

Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from talkframe.plans.catalog import QUERIES  # noqa: E402
from talkframe.session import build_session  # noqa: E402

HEADLINE = [
    "timed_segments",
    "repeat_flags",
    "orphan_flags",
    "transcript_dialogue",
    "speaker_report",
    "speaker_alignment",
    "segment_energy",
    "side_attribution",
    "speech_bounds",
    "voice_turns",
    "compare_forms",
    "word_errors",
    "term_recall",
    "value_anchors",
    "text_chunks",
    "draft_items",
    "content_findings",
    "meeting_list",
    "benchmark_roll_up",
    "live_flags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(rounds + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
