"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the no-op sink (full work, no
collect), warm-up once, then the median of $BENCH_REPEAT runs. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contrail.plans.registry import queries  # noqa: E402

HEADLINE = [
    "trail_points", "full_flight_points", "latest_by_time", "due_alerts",
    "snapshot_hot_or_cold", "flight_events", "trail_paths", "route_pick", "clean_raw",
    "path_length", "route_interpolation", "search_prefix", "state_merge", "deadband",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    # a plain session, as a user makes it: no setting of this package's own
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("contrail-bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2)).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    out: dict[str, float] = {}
    for name in HEADLINE:
        fn = qs[name]
        run(fn(spark, sf_dir))  # warm-up
        times = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)

    # Streaming throughput: land the wire messages as files (the stand-in
    # producer), then stream them through parse/enrich and the fan-out.
    from contrail.plans import streams_q
    from contrail.sinks.history import read_history
    t0 = time.perf_counter()
    src = streams_q.land_wire_files(spark, sf_dir)
    t1 = time.perf_counter()
    hist, _, _ = streams_q._ingest(spark, sf_dir, src=src)
    t2 = time.perf_counter()
    n = read_history(spark, hist).count()
    out["stream_enrich"] = round(t2 - t0, 3)
    stream_rate = round(n / (t2 - t1), 1) if t2 > t1 else None
    end_to_end_rate = round(n / (t2 - t0), 1) if t2 > t0 else None

    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_sec",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "stream_enrich_records_per_sec": stream_rate,
        "stream_enrich_records_per_sec_incl_landing": end_to_end_rate,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
