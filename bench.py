"""Time the registered queries and print one JSON line.

Each query runs in full into a no-op sink. BENCH_SF_DIR names the tables,
BENCH_CPUS the local cores; query names on the command line narrow the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from claimweave.registry import QUERIES
from claimweave.session import local_session


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    names = names or list(QUERIES)
    run(spark, sf_dir, names[0])  # warm the JVM once
    times = {name: round(run(spark, sf_dir, name), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
