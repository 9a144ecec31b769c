"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from redtide.plans import catalog
from redtide.session import build_session

HEADLINE = [
    "e1_daily_p95",
    "d5_box_join",
    "e5_grid_matchup",
    "e5_swath_matchup",
    "e8_patch_matchup",
    "e9_scene_cloud_fraction",
    "d8_lag_join",
    "d3_composite",
    "e14_impute_median",
    "x_spectral_indices",
    "v8_quadtree_adaptive",
    "d14_merge_sparse_blocks",
    "v11_moran_sweep",
    "v1_shuffle_split",
    "v16_prf",
    "v19_average_precision",
    "v20_mean_pr_curve",
    "v22_macro_by_fold",
    "v24_mann_whitney",
    "v25_mann_whitney_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
