"""Order tables in Parquet: declared schemas, reading, writing, key check."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns of the three tables.
TABLE_SCHEMAS = {
    "orders": "order_id int, customer_id int, product_id int, seller_id int, category string, region string,"
    " payment_type string, quantity int, unit_price float, discount_pct float, tax_rate float,"
    " shipping_cost float, is_returned tinyint, day_of_week tinyint, hour_of_day tinyint, month tinyint",
    "products": "product_id int, base_cost float, rating float, review_count int, weight_kg float,"
    " is_perishable tinyint",
    "customers": "customer_id int, age tinyint, account_age_days float, credit_score float, is_prime float,"
    " lifetime_orders int",
}

# Deletes what a query shuffled at its end, not when the driver happens to collect its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_SCHEMAS[name])


def _kind(data_type: T.DataType) -> str:
    return "number" if isinstance(data_type, T.NumericType) else data_type.simpleString()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of ``folder``; a missing column or a text where a number belongs is an error.

    Numbers may be wider than declared, as the operators widen them anyway.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    found = {field.name: field.dataType for field in df.schema.fields}
    for field in table_schema(name).fields:
        if field.name not in found:
            raise ValueError(f"{name}: no column {field.name}")
        if _kind(found[field.name]) != _kind(field.dataType):
            raise ValueError(f"{name}.{field.name}: {found[field.name].simpleString()} is not {_kind(field.dataType)}")
    return df


def read_order_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, products and customers of one folder."""
    return tuple(read_table(spark, folder, name) for name in TABLE_SCHEMAS)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Snappy Parquet."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The same table, or an error if a key occurs twice: a lookup with such a key would multiply the orders."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} occurs {twice[0][1]} times")
    return df


@dataclass(frozen=True)
class Settled:
    """A table written below the checkpoint folder. ``table`` reads it until ``delete`` removes its files."""

    table: DataFrame
    path: str

    def delete(self) -> None:
        spark = self.table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if fewer tasks would read it, as those of one file that cannot be split.

    An input of at least as many splits as cores stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle_parts(parts: Sequence[DataFrame], checkpoint_dir: str, name: str) -> Settled:
    """Write tables of the same columns one after the other and read them back as one.

    What Spark shuffled for a part is deleted as soon as the part is written. Zstandard took a fifth less than Snappy for scored order lines.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{checkpoint_dir.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        for at, part in enumerate(parts):
            part.write.option("compression", "zstd").parquet(f"{path}/{at}")
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return Settled(spark.read.schema(schema).parquet(*[f"{path}/{at}" for at in range(len(parts))]), path)


def settle(df: DataFrame, checkpoint_dir: str, name: str, partition_by: tuple[str, ...] = ()) -> Settled:
    """Write ``df`` under the checkpoint folder and read it back.

    Several results can then come from it without running its plan again, also after executors are lost, and a
    filter on ``partition_by`` reads only its part. Rows are gathered by these columns first, large groups in several tasks,
    so that the number of files does not grow with that of the tasks.
    """
    path = f"{checkpoint_dir.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    write_table(df.hint("rebalance", *partition_by) if partition_by else df, path, partition_by)
    return Settled(df.sparkSession.read.schema(schema).parquet(path), path)
