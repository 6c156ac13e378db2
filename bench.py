"""Seconds per headline query: median of BENCH_RUNS runs after a warm-up, as one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3), BENCH_QUERIES
(comma-separated names, default the headline queries; "all" for every query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "time_to_bar",
    "section_at",
    "nearest",
    "place_sections",
    "contiguous_bars",
    "normalize_tempo",
    "relabel_runs",
    "group_views",
    "thin_beats",
    "drop_close",
    "reconcile",
    "clean_folders",
    "archive_runs",
    "estimate_key",
    "infer_chords",
    "waveform_peaks",
    "mix_tracks",
    "latest_jobs",
    "change_log",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from metrum import build_session
    from metrum.queries.catalog import QUERIES

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, first = {}, {}
    for name in names:
        # The warm-up also derives and checkpoints the session views a query reads.
        first[name] = round(run(QUERIES[name], spark, sf_dir), 3)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: first {first[name]}, then {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_run": first,
        "first_run_total": round(sum(first.values()), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
