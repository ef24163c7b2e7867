"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airgauge.session import build_session  # noqa: E402
from workloads import QUERIES  # noqa: E402

HEADLINE = (
    "metric_summary",
    "metric_summary_by_partition",
    "cdf",
    "cdf_all_rows",
    "cdf_all_rows_ranked",
    "time_series",
    "time_series_all_rows",
    "downsample",
    "downsample_all_rows",
    "downsample_all_rows_sliced",
    "facet_cascade",
    "compare_cdf",
    "compare_all_rows",
    "catalog_tree",
    "catalog_semi_join",
    "content_hash",
    "latest_snapshot",
    "snapshot_plan",
    "canonicalize_nr_pdsch",
    "csv_scan",
    "snapshot_write",
    "ingest_end_to_end",
    "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "airgauge-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up cost of the JVM is not part of any query.
    QUERIES["cdf"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
