"""Times the registered queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables, default sf0.1), BENCH_CPUS (local threads, default 8),
BENCH_QUERIES (comma-separated names, default all).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import plans
from lakejobs.operators.layout import file_counts, files_touched, key_ranges
from lakejobs.operators.reports import top_counts
from lakejobs.plans import layouts, stored
from lakejobs.session import build_session

# Tables that several queries read; written and timed first, so queries show reading alone.
STORES = {
    "write_by_category": stored.by_category,
    "write_by_market_year": stored.by_market_year,
    "write_sorted": stored.by_sort,
    "write_bucketed": stored.by_bucket,
    "write_ranged": stored.by_range,
    "write_names_by_day": stored.names_by_day,
    "write_grid": stored.grid_store,
    "write_regions": stored.region_cells,
}


def run(df: DataFrame) -> None:
    """Computes every row without keeping any."""
    df.write.format("noop").mode("overwrite").save()


def timed(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def ratios(spark: SparkSession, sf_dir: str, times: dict[str, float]) -> dict[str, float]:
    """How much less a selective read touches, and what layouts cost: the baseline's ratios."""
    market = spark.read.parquet(stored.by_market_year(spark, sf_dir))
    pruned = market.where("marketplace = 'AMERICA' AND review_year = 1997")

    def size(df: DataFrame) -> int:
        return key_ranges(df, "product_id").agg(F.sum("bytes")).first()[0]

    def touched(path: str) -> int:
        return files_touched(spark.read.parquet(path), "product_id", [layouts.KEY]).first()["bytes_touched"]

    def top10(df: DataFrame) -> float:
        return min(timed(lambda: run(top_counts(df, "product_id", 10))) for _ in range(3))

    def lookup(path: str) -> float:
        rows = spark.read.parquet(path).where(F.col("product_id") == layouts.KEY)
        return min(timed(lambda: run(file_counts(rows, "product_id"))) for _ in range(3))

    in_buckets, in_order = stored.by_bucket(spark, sf_dir), stored.by_sort(spark, sf_dir)
    return {
        "bytes_all_over_pruned": round(size(market) / size(pruned), 2),
        "seconds_all_over_pruned": round(top10(market) / top10(pruned), 2),
        "key_bytes_bucketed_over_sorted": round(touched(in_buckets) / touched(in_order), 2),
        "key_seconds_bucketed_over_sorted": round(lookup(in_buckets) / lookup(in_order), 2),
        "write_seconds_sorted_over_bucketed": round(times["write_sorted"] / times["write_bucketed"], 2),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled=False,
        spark__ui__showConsoleProgress=False,
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1_000_000).groupBy((F.col("id") % 10).alias("k")).count())

    times = {}
    if not chosen:
        for name, store in STORES.items():
            times[name] = timed(lambda: store(spark, sf_dir))
    for name, query in plans.QUERIES.items():
        if not chosen or name in chosen:
            times[name] = timed(lambda: run(query(spark, sf_dir)))
    result = {
        "metric": "total time of all queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    if not chosen:
        result["ratios"] = ratios(spark, sf_dir, times)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
