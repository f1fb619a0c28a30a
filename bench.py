"""Time the registered queries; prints one JSON line.

Every query runs in full (all columns, all rows) into a no-op sink. The first
query of a session pays for JVM start-up, so one untimed query runs before.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.fixtures import table
from checks.queries import QUERIES
from checks.scratch import with_scratch
from rosterlake.session import local_session

DEFAULT_SF = "/root/testdata/sf0.1"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", DEFAULT_SF)
    spark = with_scratch(local_session(os.environ.get("BENCH_CPUS", "8")))
    names = sys.argv[1:] or list(QUERIES)
    table(spark, sf_dir, "pages").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
