"""Time the headline queries on local cores and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from docpipe.queries.registry import QUERIES
from docpipe.session import local_session

HEADLINE = [
    "kind_histogram",
    "html_to_markdown",
    "html_section_markdown",
    "html_links",
    "text_chunks",
    "text_merge_small",
    "csv_cells",
    "csv_row_groups",
    "json_pretty",
    "json_items",
    "json_members",
    "archive_member_chunks",
    "list_records",
    "retention_counts",
    "chunk_lookup",
    "record_summary",
    "encoding_report",
]
WARM_UP = 1
RUNS = 3


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    # All columns of all rows are computed; nothing is written.
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", shuffle_partitions=cores if cores.isdigit() else "8")
    times = {}
    for name in HEADLINE:
        for _ in range(WARM_UP):
            timed(spark, name, sf_dir)
        times[name] = round(sorted(timed(spark, name, sf_dir) for _ in range(RUNS))[RUNS // 2], 3)
    spark.stop()
    result = {
        "metric": "headline queries, warm, median of 3, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
