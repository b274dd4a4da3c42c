"""Time every registered query: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_KEYS (comma list).
Each query is run to completion into Spark's no-op sink, so whole results are computed
and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from paritymill.plans.queries import queries
from paritymill.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "paritymill-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]
    todo = {k: q for k, q in queries().items() if not chosen or k in chosen}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors' clocks alike
    times: dict[str, float] = {}
    for key, query in todo.items():
        begun = time.perf_counter()
        try:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - begun, 3)
        except Exception as exc:  # noqa: BLE001 - one failing query must not hide the others
            print(f"{key}: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total seconds over registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
