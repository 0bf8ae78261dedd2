"""Time the headline queries: one warm-up, then the median of the timed runs.

A query whose warm-up took over ``LONG_S`` seconds is timed once. ``listing_scan`` is the three-table join
that stands for a listing table in most of the others, by itself.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS``
(default 3) and ``BENCH_QUERIES`` (comma-separated name parts) and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workloads  # noqa: E402
from parcelwise import adapters  # noqa: E402
from parcelwise.session import build_session, clear_scratch  # noqa: E402

LONG_S = 8
HEADLINE = [
    "listing_scan",
    "F1_T1_search_page_newest_first",
    "A6_count_of_matches",
    "T2_F4_J2_map_pins",
    "A1_A2_J1_breakdown_by_district",
    "A1_A2_J7_breakdown_by_disposition",
    "A3_yield_by_district",
    "A4_W4_segment_price_stats",
    "A5_J15_G2_G3_relaxation_ladder",
    "K3_score_rows_without_model",
    "K3_S12_nightly_scores",
    "A10_U3_P5_hedonic_models",
    "J8_W6_M5_nearest_places_within_radius",
    "J10_N12_property_link_ladder",
    "J12_W5_A7_density_clusters",
    "W1_S13_latest_score_per_listing",
    "W2_changed_payloads",
    "W3_same_source_duplicates",
    "W7_change_records",
    "R1_to_R9_risk_flags_and_score",
    "N2_normalize_for_match",
    "S8_listing_upsert",
    "X1_to_X7_detail_documents_to_listings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    spark = build_session(
        "parcelwise-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    workloads.load_all()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if picked and not any(p in name for p in picked):
            continue
        took: list[float] = []
        query = adapters.listings if name == "listing_scan" else workloads.QUERIES[name]
        i = 0
        while i <= runs and not (i > 1 and warm_up > LONG_S):
            t0 = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - t0)
            else:
                warm_up = time.perf_counter() - t0
            i += 1
        clear_scratch(spark)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
