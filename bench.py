"""Time every registered query at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and
width; BENCH_QUERIES, a comma-separated list, narrows the run while working on a query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tagloom.session import build_session
from tagloom.workloads.catalog import QUERIES


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = build_session(
        "tagloom-bench",
        **{
            "spark.master": f"local[{cpus}]", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds, failed = {}, {}
    for name in chosen:
        start = time.perf_counter()
        try:
            # The whole result is computed and thrown away; nothing reaches the driver.
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
            print(f"{name} failed: {failed[name]}", file=sys.stderr)
    spark.stop()
    result = {
        "metric": "sum of seconds over all registered queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
