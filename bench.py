"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

from strom.registry import all_queries
from strom.session import drop_intermediates, local_session

HEADLINES = (
    "trip_energy", "fct_vehicle_telemetry", "fct_trips", "station_power", "charging_infrastructure", "corridor_stations", "corridor_coverage",
    "coverage_query", "traffic_impact", "energy_by_temperature", "energy_by_speed", "points_to_segments", "segment_energy", "window_features",
    "validate_weather", "trip_series", "route_analysis",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the JVM's reader before the clock runs
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
        drop_intermediates(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
