"""Time the headline queries: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import time

from checks.queries import QUERIES
from grapevine.session import build_session

HEADLINE = [
    "redemptions",
    "interactions",
    "name_similarity",
    "users",
    "influencers",
    "order_lines",
    "weekly_customer_store",
    "customer_history",
    "category_flags",
    "behaviour",
    "client_means",
    "child_sharing",
    "child_behaviour",
    "k_factor",
    "k_factor_events",
    "user_interactions",
    "user_stages",
    "mape",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in ("user_stages", "name_similarity"):  # start the JVM and the Python workers
        seconds(name)
    times = {name: seconds(name) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
