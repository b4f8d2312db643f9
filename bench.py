"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local threads. Every
query runs once to warm up; the shorter of two timed runs counts. Each run writes
all rows to a sink that discards them. Queries that read the daily profile or the
predictions read stage tables, which the warm-up writes.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from dayglass.session import build_session

QUERIES = (
    "a1_a2_daily_profile",
    "j3_j4_interval_label",
    "a3_role_daily_profile",
    "w1_self_zscores",
    "w2_peer_zscores",
    "w3_sequences_last_day",
    "m4_isolation_forest",
    "m9_sequence_deviation",
    "e1_weighted_ensemble",
    "e8_alerts",
    "q1_metrics",
    "q5_threshold_sweep",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "dayglass-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="dayglass-bench-"),
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    from dayglass.plans.catalog import QUERIES as known

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    only = os.environ.get("BENCH_ONLY", "").split() or QUERIES
    times = {}
    for name in only:
        run(name)
        times[name] = min(run(name), run(name))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
