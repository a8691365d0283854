"""Adapters from the sample tables (TPC-H-like tables, events, embeddings) to the library's inputs.

The joins go through :func:`tallymill.operators.lookup.lookup_joins`, so that they broadcast only what was
counted to be small and stay balanced when one key holds a large part of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.lookup import BROADCAST_BYTES, lookup_joins
from tallymill.sources.tables import spread

# The columns that are read of each table.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _product_id():
    # Every tenth part is ordered under a number that no product has, so that some order lines find none.
    return F.when(F.col("l_partkey") % 10 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))


def order_key_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Where each key of the order lines can be counted without a join. Customers are counted by orders instead of lines."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), _product_id().alias("product_id"))
    heads = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"))
    return {"order_id": lines, "product_id": lines, "customer_id": heads}


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, measures as double, without customer and region."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        _product_id().alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").cast("double").alias("discount_pct"),
        F.col("l_tax").cast("double").alias("tax_rate"),
        (F.col("l_linenumber") * F.lit(7.5)).alias("shipping_cost"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).cast("tinyint").alias("is_returned"),
        F.weekday("l_shipdate").cast("tinyint").alias("day_of_week"),
        F.month("l_shipdate").cast("tinyint").alias("month"),
    )


def order_lookups(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str]]:
    """What gives the order lines their customer and region; lines without them drop out. Nation and region keys come along."""
    heads = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")
    )
    buyers = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    regions = _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    steps = [(heads, "order_id"), (buyers, "customer_id"), (nations, "n_nationkey"), (regions, "r_regionkey")]
    return [(lookup, key, "inner") for lookup, key in steps]


def sample_orders(spark: SparkSession, sf_dir: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per order line with its customer and region, measures as double."""
    placed = lookup_joins(
        order_lines(spark, sf_dir),
        order_lookups(spark, sf_dir),
        ("order_id", "product_id", "seller_id"),
        broadcast_bytes=broadcast_bytes,
        key_tables=order_key_tables(spark, sf_dir),
    )
    return placed.drop("n_nationkey", "r_regionkey")


def sample_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        (F.col("p_retailprice") * F.lit(0.6)).alias("base_cost"),
        (F.lit(1.0) + F.col("p_size") % 5).alias("rating"),
        (F.col("p_size") * 100).alias("review_count"),
    )


def sample_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_custkey") % 3650 + 1).cast("double").alias("account_age_days"),
        (F.lit(300.0) + F.abs("c_acctbal") / F.lit(20.0)).alias("credit_score"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(1.0)).otherwise(F.lit(0.0)).alias("is_prime"),
    )


def sample_log_lines(spark: SparkSession, sf_dir: str, bad_number_every: int | None = None) -> DataFrame:
    """One log line per event; every fiftieth event gives a line that is not a log record.

    With ``bad_number_every``, every so many events have a latency of 25 nines, which no integer type holds.
    """
    event_id, user_id = F.col("event_id"), F.col("user_id")
    level = (
        F.when(F.col("event_type") == "click", "INFO")
        .when(F.col("event_type") == "view", "DEBUG")
        .when(F.col("event_type") == "signup", "TRACE")
        .when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARN")
    )
    method = F.element_at(
        F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "PATCH", "DELETE")]), (event_id % 5 + 1).cast("int")
    )
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 503, 301)]), (event_id % 4 + 1).cast("int"))
    path = F.when(event_id % 3 == 0, "/health").otherwise(F.concat(F.lit("/api/r"), user_id % 11))
    failure = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit(' exception="E'), user_id % 4, F.lit('" stack="S.java:'), event_id, F.lit('"')),
    ).otherwise("")
    latency = F.floor(F.col("value") * 20).cast("int").cast("string")
    if bad_number_every:
        latency = F.when(event_id % bad_number_every == 0, "9" * 25).otherwise(latency)
    record = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("Z "),
        level,
        F.lit("  [svc-"),
        event_id % 7,
        F.lit("] [traceId=ab"),
        event_id,
        F.lit("] userId="),
        user_id,
        F.lit(" ip=10.0."),
        user_id % 256,
        F.lit("."),
        event_id % 256,
        F.lit(" method="),
        method,
        F.lit(" path="),
        path,
        F.lit(" status="),
        status,
        F.lit(" latencyMs="),
        latency,
        F.lit(' msg="m"'),
        failure,
    )
    line = F.when(event_id % 50 == 0, F.concat(F.lit("garbage "), event_id)).otherwise(record)
    return spread(_table(spark, sf_dir, "events")).select(line.alias("value"))


def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
