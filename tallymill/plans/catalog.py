"""Registered queries: every operator on the sample tables, over the whole tables.

Each query takes (spark, folder of the tables). What reports and files of a run leave below the checkpoint folder goes
with :func:`tallymill.session.delete_work_files`. Computed doubles are rounded, money sums to cents and the rest to
six places, because two engines add up in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions.scoring import CUSTOMER_FORMULAS, PRODUCT_FORMULAS
from tallymill.functions.scoring import ORDER_FLAG_FORMULAS, ORDER_VALUE_FORMULAS, SCORE_FORMULAS
from tallymill.operators import commerce, kmeans, logs
from tallymill.operators.sampling import hash_sample, shuffle_key
from tallymill.plans.reports import commerce_report, log_file_report, log_reconciliation, log_report
from tallymill.session import limit_methods, work_folder
from tallymill.sources import sample_tables as sample
from tallymill.sources.tables import settle_parts
from tallymill.sources.textlogs import read_lines, write_lines

Query = Callable[[SparkSession, str], DataFrame]

CLUSTERS = 10
SEED = 42
OBJECTIVE_ITERATIONS = 5
FIT_ITERATIONS = 20
STARTS = 3
SHIFT = 1e8
QUARANTINE_EVERY = 37
LINE_FILES = 4

_HELPERS = ("product_pull", "customer_pull")
_ID_COLUMNS = ("order_id", "customer_id", "product_id", "seller_id")
_CENTS = ("total_revenue", "total_margin", "max_order_value", "total_gmv", "lifetime_value", "lifetime_margin")


def _round(column: str, digits: int) -> Column:
    # Half to even in double arithmetic. Spark's round() goes through decimals and takes many times longer.
    scale = 10.0**digits
    return F.rint(F.col(column) * scale) / scale


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[_round(c, 2 if c in _CENTS else 6).alias(c) if c in doubles else c for c in df.columns])


def _tables(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        sample.sample_orders(spark, sf_dir, **options),
        sample.sample_products(spark, sf_dir),
        sample.sample_customers(spark, sf_dir),
    )


def _scored(spark: SparkSession, sf_dir: str, **join_options) -> DataFrame:
    scored = commerce.score_orders(
        sample.order_lines(spark, sf_dir),
        sample.sample_products(spark, sf_dir),
        sample.sample_customers(spark, sf_dir),
        order_lookups=sample.order_lookups(spark, sf_dir),
        key_tables=sample.order_key_tables(spark, sf_dir),
        **join_options,
    )
    return scored.drop("n_nationkey", "r_regionkey")


def _derived_names(*formulas) -> list[str]:
    return [name for groups in formulas for group in groups for name in group if name not in _HELPERS]


def order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = commerce.order_flags(sample.sample_orders(spark, sf_dir))
    return flagged.select("order_id", "product_id", "month", "day_of_week", "is_festive_season", "is_weekend")


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = commerce.order_values(sample.sample_orders(spark, sf_dir))
    return rounded(valued.select(*_ID_COLUMNS, *_derived_names(ORDER_VALUE_FORMULAS)))


def _joined_columns(joined: DataFrame) -> DataFrame:
    measures = ("base_cost", "rating", "review_count", "account_age_days", "credit_score", "is_prime")
    return rounded(joined.select(*_ID_COLUMNS, "category", "region", "quantity", *measures))


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_columns(commerce.star_join(*_tables(spark, sf_dir)))


def star_join_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join as it runs when neither side may be broadcast: hot keys salted."""
    key_tables = sample.order_key_tables(spark, sf_dir)
    joined = commerce.star_join(*_tables(spark, sf_dir, broadcast_bytes=0), broadcast_bytes=0, key_tables=key_tables)
    return _joined_columns(joined)


def category_region_summary_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as it runs when no lookup may be broadcast."""
    key_tables = sample.order_key_tables(spark, sf_dir)
    tables = _tables(spark, sf_dir, broadcast_bytes=0)
    scored = commerce.score_orders(*tables, broadcast_bytes=0, key_tables=key_tables)
    return rounded(commerce.category_region_summary(scored))


def commerce_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_methods(spark)
    names = _derived_names(
        ORDER_VALUE_FORMULAS, ORDER_FLAG_FORMULAS, PRODUCT_FORMULAS, CUSTOMER_FORMULAS, SCORE_FORMULAS
    )

    def settled(parts: list[DataFrame]) -> DataFrame:
        needed = [part.select(*_ID_COLUMNS, *commerce.SCORED_FROM) for part in parts]
        return settle_parts(needed, work_folder(spark), "commerce-lines").table

    return rounded(_scored(spark, sf_dir, in_parts=settled).select(*_ID_COLUMNS, *names))


def category_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(commerce.category_region_summary(_scored(spark, sf_dir)))


def seller_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(commerce.seller_performance(_scored(spark, sf_dir)))


def customer_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(commerce.customer_cohort(_scored(spark, sf_dir)))


def _top(summary: commerce.Summary, n: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return commerce.top_of(summary, rounded(summary.of(_scored(spark, sf_dir))), n)

    return query


def _commerce_report(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key_tables = sample.order_key_tables(spark, sf_dir)
        return rounded(commerce_report(*_tables(spark, sf_dir), names=[name], key_tables=key_tables).summaries[name])

    return query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_log_lines(spark, sf_dir)


def _broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_log_lines(spark, sf_dir, bad_number_every=QUARANTINE_EVERY)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(_lines(spark, sf_dir))


def _facet(dimension: str) -> Query:
    return lambda spark, sf_dir: logs.log_facet(_parsed(spark, sf_dir), dimension)


def _totals(totals: DataFrame) -> DataFrame:
    """For comparison: the total latency, an exact decimal, as the whole number it is here."""
    return rounded(totals.withColumn("total_latency", F.col("total_latency").cast("bigint")))


def _written(spark: SparkSession, sf_dir: str, compression: str) -> str:
    """The sample lines as text files below the checkpoint folder."""
    path = f"{work_folder(spark)}/lines-{uuid.uuid4().hex}"
    write_lines(_lines(spark, sf_dir), path, LINE_FILES, compression)
    return path


def log_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample lines written as plain text and read back."""
    return read_lines(spark, [_written(spark, sf_dir, "none")])


def log_gzip_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the sample lines from gzip files."""
    lines = read_lines(spark, [_written(spark, sf_dir, "gzip")], parallelism=2 * LINE_FILES)
    return _totals(logs.log_totals(logs.parse_lines(lines)))


def report_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the sample lines from text files, with the files' number and bytes."""
    return _totals(log_file_report(spark, [_written(spark, sf_dir, "none")]).totals)


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sample.sample_vectors(spark, sf_dir)
    return rounded(kmeans.assign(vectors, kmeans.initial_centers(vectors, CLUSTERS, SEED)))


def _long_centers(fit: kmeans.KMeansFit, spark: SparkSession) -> DataFrame:
    table = fit.center_table(spark)
    return rounded(table.select("cluster", F.posexplode("center").alias("dim", "value")))


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after one step."""
    vectors = sample.sample_vectors(spark, sf_dir)
    return _long_centers(kmeans.kmeans(vectors, CLUSTERS, max_iter=1, seed=SEED), spark)


def kmeans_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sample.sample_vectors(spark, sf_dir)
    fit = kmeans.kmeans(vectors, CLUSTERS, max_iter=OBJECTIVE_ITERATIONS, seed=SEED)
    return rounded(fit.objective_table(spark))


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after a whole fit."""
    vectors = sample.sample_vectors(spark, sf_dir)
    return _long_centers(kmeans.kmeans(vectors, CLUSTERS, max_iter=FIT_ITERATIONS, seed=SEED), spark)


def kmeans_assign_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment far from the origin: all vectors as double, moved by 1e8 in every direction."""
    vectors = sample.sample_vectors(spark, sf_dir)
    centers = kmeans.initial_centers(vectors, CLUSTERS, SEED) + SHIFT
    moved = F.transform("embedding", lambda x: x.cast("double") + F.lit(SHIFT))
    found = kmeans.assign(vectors.select("vec_id", moved.alias("embedding")), centers)
    return found.select("vec_id", "cluster", _round("distance", 4).alias("distance"))


def kmeans_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest objective of three starts."""
    vectors = sample.sample_vectors(spark, sf_dir)
    fit = kmeans.kmeans(vectors, CLUSTERS, max_iter=OBJECTIVE_ITERATIONS, n_redo=STARTS, seed=SEED)
    return rounded(spark.range(1).select(F.lit(fit.inertia).alias("inertia"), F.lit(fit.iterations).alias("iterations")))


def kmeans_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that a fit starts from, in the order of the seed."""
    vectors = sample.sample_vectors(spark, sf_dir)
    chosen = hash_sample(vectors, "vec_id", CLUSTERS, SEED)
    order = Window.orderBy(shuffle_key("vec_id", SEED), "vec_id")  # over k rows
    return chosen.select("vec_id", (F.row_number().over(order) - 1).alias("cluster"))


QUERIES: dict[str, Query] = {
    "order_flags": order_flags,
    "order_values": order_values,
    "star_join": star_join,
    "star_join_shuffled": star_join_shuffled,
    "commerce_scored": commerce_scored,
    "category_region_summary": category_region_summary,
    "category_region_summary_shuffled": category_region_summary_shuffled,
    "seller_performance": seller_performance,
    "customer_cohort": customer_cohort,
    "top_category_region": _top(commerce.CATEGORY_REGION, 10),
    "top_sellers": _top(commerce.SELLER, 5),
    "top_customers": _top(commerce.CUSTOMER, 5),
    **{f"report_{name}": _commerce_report(name) for name in commerce.SUMMARIES},
    "log_lines": _lines,
    "log_parsed": lambda spark, sf_dir: logs.parse_log_fields(_lines(spark, sf_dir)),
    "log_unmatched": lambda spark, sf_dir: logs.unmatched_lines(_lines(spark, sf_dir)),
    "log_quarantine": lambda spark, sf_dir: logs.quarantined_lines(_broken_lines(spark, sf_dir)),
    "log_text_roundtrip": log_text_roundtrip,
    "log_totals": lambda spark, sf_dir: _totals(logs.log_totals(_parsed(spark, sf_dir))),
    "log_totals_with_bad_numbers": lambda spark, sf_dir: _totals(
        logs.log_totals(logs.parse_lines(_broken_lines(spark, sf_dir)))
    ),
    "log_gzip_totals": log_gzip_totals,
    "log_status_class": lambda spark, sf_dir: logs.log_status_classes(_parsed(spark, sf_dir)),
    "log_reconcile": lambda spark, sf_dir: log_reconciliation(log_report(_broken_lines(spark, sf_dir))),
    "log_facets": lambda spark, sf_dir: logs.log_facets(_parsed(spark, sf_dir)),
    "log_top_levels": _facet("level"),
    "log_top_services": _facet("service"),
    "log_top_methods": _facet("method"),
    "log_top_statuses": _facet("status"),
    "log_top_paths": _facet("path"),
    "log_top_exceptions": _facet("exception"),
    "log_slow_endpoints": _facet("slow_endpoint"),
    "report_log_totals": lambda spark, sf_dir: _totals(log_report(_lines(spark, sf_dir)).totals),
    "report_log_facets": lambda spark, sf_dir: log_report(_lines(spark, sf_dir)).facets,
    "report_log_files": report_log_files,
    "kmeans_assign": kmeans_assign,
    "kmeans_update": kmeans_update,
    "kmeans_objective": kmeans_objective,
    "kmeans_fit": kmeans_fit,
    "kmeans_assign_shifted": kmeans_assign_shifted,
    "kmeans_redo": kmeans_redo,
    "kmeans_start": kmeans_start,
}
