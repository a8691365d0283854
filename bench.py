"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built anew and run three times after one warm-up; the median of both together counts, and that of building
is told apart. k-means runs every iteration it is told. Results go to Spark's noop sink,
so that every column of every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tallymill.plans.catalog import FIT_ITERATIONS, QUERIES  # noqa: E402
from tallymill.plans.reports import commerce_report  # noqa: E402
from tallymill.session import local_session  # noqa: E402
from tallymill.sources import sample_tables as sample  # noqa: E402

HEADLINE = (
    "category_region_summary",
    "seller_performance",
    "customer_cohort",
    "report_category_region",
    "log_totals",
    "log_facets",
    "log_parsed",
    "report_log_facets",
    "kmeans_objective",
    "kmeans_fit",
)
REPEATS = 3


def seconds(spark, query, sf_dir: str) -> tuple[float, float]:
    """Seconds to build the DataFrame, which some operators do with jobs of their own, and to run it."""
    start = time.perf_counter()
    built = query(spark, sf_dir)
    between = time.perf_counter()
    built.write.format("noop").mode("overwrite").save()
    return between - start, time.perf_counter() - between


def whole_report(spark, sf_dir: str):
    """All three summaries from one pass, settled and read back."""
    tables = (sample.sample_orders(spark, sf_dir), sample.sample_products(spark, sf_dir), sample.sample_customers(spark, sf_dir))
    report = commerce_report(*tables, key_tables=sample.order_key_tables(spark, sf_dir))
    return report.cells.table


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tallymill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    measured = {name: QUERIES[name] for name in HEADLINE} | {"report_all_summaries": whole_report}
    for query in measured.values():
        seconds(spark, query, sf_dir)
    runs = {name: [seconds(spark, measured[name], sf_dir) for _ in range(REPEATS)] for name in measured}
    timed = {name: round(statistics.median(a + b for a, b in own), 3) for name, own in runs.items()}
    built = {name: round(statistics.median(a for a, _ in own), 3) for name, own in runs.items()}
    rows = {
        "order_lines": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(),
        "log_lines": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
        "vectors": spark.read.parquet(f"{sf_dir}/embeddings.parquet").count(),
    }
    lines_bytes = QUERIES["log_lines"](spark, sf_dir).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    rates = {
        "orders_per_sec": round(rows["order_lines"] / timed["category_region_summary"]),
        "log_lines_per_sec": round(rows["log_lines"] / timed["log_facets"]),
        "log_mb_per_sec": round(lines_bytes / 1e6 / timed["log_facets"], 2),
        "kmeans_sec_per_iteration": round(timed["kmeans_fit"] / FIT_ITERATIONS, 3),
    }
    result = {
        "metric": "sum of the median seconds of the headline queries",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "build": built,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "rows": rows,
        "rates": rates,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
