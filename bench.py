"""Benchmark the headline queries: warm, median of 5, full execution (noop sink).

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (default 5).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logloom.plans.queries import QUERIES  # noqa: E402
from logloom.session import get_session  # noqa: E402

HEADLINE = [
    "parse_lines",        # raw lines -> entries
    "dedup_first",        # first write wins
    "query_combined",     # namespace + severity + time + full text, one page
    "query_desc",         # newest page
    "page_info",          # cursor info
    "stats",              # count / oldest / newest
    "search_term",        # stemmed term over all messages
    "search_documents",   # full text over the documents
    "build_vocabulary",   # distinct tokens + stems
    "container_events",   # lifecycle state machine
]


def stored_table_queries(spark, sf_dir: str) -> dict:
    """The production path: the log table written once (terms stored, date
    partitions, files sorted by id), then queried."""
    from pyspark.sql import functions as F

    from itertools import count

    from logloom.operators.paging import get_by_id, page, stored_page
    from logloom.operators.query import LogQuery
    from logloom.plans.fixtures import logs_from_events
    from logloom.session import scratch_path
    from logloom.sinks.table import append_new, write_log_table
    from logloom.sources.logs import read_logs

    path, stage = scratch_path(spark, "bench-table"), scratch_path(spark, "bench-stage")
    rows = logs_from_events(spark, sf_dir)
    write_log_table(rows, path)
    runs = count(1)

    def append_batch():
        """One batch of a hundredth of the rows, half of them stored before."""
        k = next(runs)
        part = rows.where(F.pmod("id", F.lit(100)) == k % 100).withColumnRenamed("id", "arrival")
        batch = part.withColumn("ts_ns", F.when(F.col("arrival") % 2 == 0, F.col("ts_ns") + k).otherwise(F.col("ts_ns")))
        return spark.createDataFrame([tuple(append_new(spark, batch, path, stage).values())], "offered long, inserted long")

    q = LogQuery(namespace="live", min_severity=5, search="ledger cache",
                 start_ns=1704844800 * 10**9, limit=100)
    return {
        "stored_combined_page": lambda: page(read_logs(spark, path), q),
        "stored_newest_page": lambda: stored_page(spark, path, LogQuery()),
        "stored_get_by_id": lambda: get_by_id(spark, path, 4242),
        "append_batch": append_batch,  # anti-join with the batch's days, ids, terms, write
    }


def run_once(spark, name: str, sf_dir: str, extra: dict | None = None) -> float:
    t0 = time.perf_counter()
    df = extra[name]() if extra and name in extra else QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(cpus),
                                             "spark.driver.memory": "16g"})
    results = {}
    extra = stored_table_queries(spark, sf_dir)
    for name in HEADLINE + list(extra):
        for _ in range(2):  # warm-up (JIT, file listing caches)
            run_once(spark, name, sf_dir, extra)
        times = [run_once(spark, name, sf_dir, extra) for _ in range(runs)]
        results[name] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
