"""Time the headline queries; prints one JSON line.

The views an extractor would deliver (spans, nodes, links ...) are first written as
Parquet under a scratch folder (BENCH_FOLDER), so the numbers are the queries', not the fixtures'.
Each query's full result is produced (noop sink), best of BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "contrast_failures", "nontext_contrast", "contrast_darken_linear", "heading_issues", "heading_repair", "bookmarks",
    "reading_level", "abbreviations", "sensory", "language_issues", "link_quality", "link_text", "alt_quality",
    "fonts", "table_header_ids", "table_issues", "table_normalize", "captions", "running_headers", "header_artifacts",
    "swatches", "toc", "hit_test", "unmarked_content", "islands", "conformance", "score", "scoreboard",
]

VIEWS = [
    "spans", "annots", "paths", "page_sizes", "images", "headings", "nodes", "links", "fonts", "cells", "tables", "figures",
    "fills", "toc_nodes", "stream_ops", "tree", "docs", "layers", "fields", "runs",
]

# tables read as they are, rewritten only so that they come in as many files as a corpus would
TABLES = ["documents"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    from tagloom.session import get_spark
    spark = get_spark("bench", f"local[{cpus}]", spark__driver__memory="16g",
                      spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    import catalog
    from catalog.dialect import materialize
    started = time.time()
    folder = os.environ.get("BENCH_FOLDER") or tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    materialize(spark, sf_dir, folder, int(cpus), VIEWS + TABLES)
    prepared = time.time() - started
    queries = catalog.queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "prepare_sec": round(prepared, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
