"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8).
"""

import json
import os
import re
import sys
import time

from quire.catalog import QUERIES
from quire.session import local_session

HEADLINES = [
    "block_category_counts", "page_direction", "dedupe_lines", "assign_regions", "assign_lines_to_cells",
    "table_captions", "body_regions", "merge_positions", "resolve_duplicate_lines", "merge_detections",
    "reading_order", "format_paragraphs", "is_subheading", "apply_rules_engine", "merge_footnotes",
    "renumber_notes", "drop_running_headers_carried", "extract_tables", "apply_merges", "search_pages",
    "merge_cross_page", "batch_dashboard", "read_ocr_lines", "ingest_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="quire-bench")
    QUERIES["page_sizes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        # The noop sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
