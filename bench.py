"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Each query is
run to completion through a no-op sink, so nothing comes back to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barwright.plans import load_all
from barwright.session import local_session
from barwright.sources import panel

HEADLINE = [
    "regime_summary",
    "derived_metrics",
    "average_true_range",
    "gap_volume_heatmap",
    "hill_estimator",
    "z_anomalies",
    "return_acf",
    "hurst_exponent",
    "missing_date_ranges",
    "bar_upsert",
    "split_adjusted_bars",
    "new_filings",
    "rolling_volatility",
    "correlation_matrix",
    "rolling_var",
    "macd",
    "amplitude_spectrum",
    "key_metrics",
    "equity_measures",
    "monthly_distribution",
]


# Queries that do not read the panel.
OTHER_TABLES = {"new_filings", "key_metrics"}


def timed(df, label: str) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took = round(time.perf_counter() - start, 3)
    print(label, took, file=sys.stderr, flush=True)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "12g")
    queries, _ = load_all()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    # Cold: each query scans and aggregates its tables itself. Then the same queries on a
    # panel that is built once, as they would run on stored bars.
    times = {name: timed(queries[name](spark, sf_dir), name) for name in wanted}
    bars = panel.bars(spark, sf_dir).persist()
    stored = {"build_panel": timed(bars, "build_panel")}
    stored |= {name: timed(queries[name](spark, sf_dir), f"{name}, stored panel") for name in wanted if name not in OTHER_TABLES}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "stored_panel": stored, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
