"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Set $BENCH_EVENT_LOG to a scratch folder to keep Spark's event log (stage / task times)
for ``tools/stage_times.py``.

Each query runs to completion into a ``noop`` sink (full execution, no collect). The
stored panel is materialised first (reported as ``panel_load``, not in the total).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "scan_panel_range", "profile_summary", "profile_ids", "missing_ratio", "market_avg", "responder_lag",
    "aux_targets", "rolling_mean", "rolling_mean_prefix", "rolling_w1000", "model_frame", "standardize_apply",
    "weighted_r2_by_date", "universe_growth", "day_sequences", "canonical_order_rank", "cadence_sweep",
    "variant_summary", "walk_forward_multi", "walk_forward_wide", "split_grid_scores", "marketroll_sweep",
    "gbt_fit_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidepanel import queries as Q
    from tidepanel.operators import features as FE
    from tidepanel.session import get_spark

    extra = {"spark.driver.memory": "16g"}
    log_dir = os.environ.get("BENCH_EVENT_LOG")  # e.g. a fresh `mktemp -d` folder
    if log_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="tidepanel-bench", extra=extra)

    def rolling_w1000(spark, sf):
        p = Q.panel(spark, sf)
        out = FE.rolling_stats(p, Q.ROLL_FEATURES, window=1000)
        return out.select("date_id", "time_id", "symbol_id", *[c for c in out.columns if "_roll_" in c])

    from tidepanel.session import size_shuffles
    from tidepanel.sources.fixtures import panel_path

    def folder_bytes(path: str) -> int:
        return sum(os.path.getsize(os.path.join(b, f)) for b, _d, fs in os.walk(path) for f in fs)

    registry = dict(Q.QUERIES)
    registry["rolling_w1000"] = rolling_w1000
    t0 = time.time()
    Q.panel(spark, sf_dir).count()
    timings = {"panel_load": round(time.time() - t0, 3)}
    # Partition sizing from the stored panel's bytes (the same rule a cluster run uses).
    size_shuffles(spark, folder_bytes(panel_path(spark, sf_dir)))
    total = 0.0
    for name in HEADLINE:
        t = time.time()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        dt = time.time() - t
        timings[name] = round(dt, 3)
        total += dt
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
