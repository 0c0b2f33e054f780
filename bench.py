"""Headline queries on one machine: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs per query (median counts; one untimed run comes first).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.plans import load_all  # noqa: E402
from barloom.session import build_session  # noqa: E402

HEADLINE = [
    "src_01_bars_daily",
    "src_01_bars_hourly",
    "src_03_columnar_payload",
    "src_16_upsert",
    "win_01_sma",
    "win_02_ema",
    "win_03_macd",
    "win_05_adx",
    "win_06_rsi",
    "win_19_suite",
    "win_20_feature_suite",
    "agg_02_noise",
    "agg_08_quality",
    "agg_11_moments",
    "agg_14_trend",
    "agg_16_stationarity",
    "agg_17_regime_changes",
    "fea_01_adaptive_labels",
    "aug_03_time_warp",
    "eva_03_classification",
    "eva_08_threshold_search",
    "scn_03_paths",
    "scn_04_statistics",
    "bkt_01_cross_backtest",
    "bkt_02_optimise",
    "alr_02_alert_run",
    "mod_04_forecast",
    "str_01_streaming_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        f"local[{cpus}]", max(4, cores or 4), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
