"""What several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import work_folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    What follows does not run the plan again, also after an executor was lost.
    """
    path = shared_folder(df, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def shared_folder(df: DataFrame, name: str) -> str:
    """A new path in the run's work folder, which :func:`tallymill.session.delete_work_files` deletes."""
    return f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def running_totals(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over all rows that come before in the ``order``, which tells the rows apart.

    Ranges of the order are summed on their own; one number per range reaches the driver.
    """
    ranged = df.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")
    sums = {r["range"]: r["sum"] for r in ranged.groupBy("range").agg(F.sum(weight).alias("sum")).collect()}
    starts, total = [], 0
    for at in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(at, 0)
    if not starts:
        return ranged.withColumn("before", F.lit(0).cast("bigint")).drop("range")
    start = F.get(F.lit(starts).cast("array<bigint>"), F.col("range"))
    inside = Window.partitionBy("range").orderBy(*order)
    return ranged.withColumn("before", F.sum(weight).over(inside) - F.col(weight) + start).drop("range")


_TABLE_BLOCK = 1 << 16
_TABLE_ROWS = 1000
_TABLES_AT_ONCE = 32


def count_table(df: DataFrame, size: int, slots: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often ``slots`` of the rows' batches name each of ``size`` places; the size does not depend on the rows.

    Every task of the input counts into a table of its own. The tables are added up in blocks, some tens at a time, until there is
    one of each block; only these reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.uint32)  # no task reads 2 ** 32 rows of one place
        for batch in batches:
            for at in range(0, batch.num_rows, _TABLE_ROWS):
                np.add.at(table, slots(batch.slice(at, _TABLE_ROWS)), 1)
        task = TaskContext.get().partitionId()
        for block in range(0, size, _TABLE_BLOCK):
            part = table[block : block + _TABLE_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([task]), pa.array([shrunk(part)], pa.binary())], names)

    # In as few bytes as the counts need: what a task passes on grows with its rows, not with the table, as runs of zeros are packed.
    def shrunk(part: np.ndarray) -> bytes:
        small = part.astype(np.min_scalar_type(part.max()))
        return bytes([small.itemsize]) + small.tobytes()

    def grown(part: bytes) -> np.ndarray:
        return np.frombuffer(part, f"u{part[0]}", offset=1).astype(np.int64)

    def add(group: pa.Table) -> pa.Table:
        total = sum(grown(part.as_buffer().to_pybytes()) for part in group.column("counts"))
        task = group.column("task")[0].as_py() // _TABLES_AT_ONCE
        return pa.table({"block": group.column("block")[:1], "task": [task], "counts": pa.array([shrunk(total)], pa.binary())})

    names = ["block", "task", "counts"]
    schema = "block bigint, task bigint, counts binary"
    tasks = df.rdd.getNumPartitions()
    counted = df.mapInArrow(count, schema)
    while True:
        counted = counted.groupBy("block", F.floor(F.col("task") / _TABLES_AT_ONCE)).applyInArrow(add, schema)
        tasks = -(-tasks // _TABLES_AT_ONCE)
        if tasks <= 1:
            break
    table = np.zeros(size, dtype=np.int64)
    for row in counted.collect():
        part = grown(row["counts"])
        table[row["block"] : row["block"] + len(part)] = part
    return table


_MARKS = 8 * 4096  # bits of one of Spark's bitmaps
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 27


def marked_places(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` with a one at every number in the first column, made of partial bitmaps of each task."""
    place = F.col(places.columns[0])
    marked = places.where(place.isNotNull()).select((place.cast("bigint") + F.lit(1)).alias("place"))
    found = marked.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks")
    )
    table = np.zeros(bits // 8, dtype=np.uint8)
    for row in found.collect():  # the bitmap's own size at most
        part = np.frombuffer(row["marks"], np.uint8)
        start = (row["bucket"] - 1) * len(part)
        table[start : start + len(part)] = part[: len(table) - start]
    return table


def is_marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def only_likely(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Rows of ``df`` whose 64-bit integer ``column`` may be among ``wanted``: all that are, and few others."""
    return likely_and_not(df, column, wanted, wanted_column)[0]


def likely_and_not(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose 64-bit integer ``column`` may be among ``wanted``, and those where it is not, or is null.

    A bitmap of eight to sixteen bits per wanted row, between 8 KB and 16 MB, goes to the tasks. It spares a join the shuffle of
    rows that cannot match.
    """
    bits = min(max(1 << (wanted.count().bit_length() + 3), _LEAST_BITS), _MOST_BITS)

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("bigint")), F.lit(bits)).alias("_place")

    told = wanted.where(F.col(wanted_column).isNotNull())
    marked = df.sparkSession.sparkContext.broadcast(marked_places(told.select(place(wanted_column)), bits))
    at = len(df.columns)
    placed = df.select("*", place(column), F.col(column).isNotNull().alias("_told"))

    def side(likely: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pc.and_(pa.array(is_marked(marked.value, batch.column(at).to_numpy())), batch.column(at + 1))
                own = pa.RecordBatch.from_arrays(batch.columns[:at], batch.schema.names[:at])
                yield own.filter(found if likely else pc.invert(found))

        return run

    return placed.mapInArrow(side(True), df.schema), placed.mapInArrow(side(False), df.schema)


BROADCAST_ROWS = 1_000_000  # of two numbers


def without(df: DataFrame, gone: DataFrame, key: str, check: str) -> DataFrame:
    """Rows of ``df`` whose 64-bit ``key`` and ``check`` are not together in ``gone``, which has these two columns only.

    Up to a million of them travel to the tasks. Beyond that a bitmap does, and only rows that it cannot rule out are shuffled.
    """
    if gone.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(gone), [key, check], "left_anti").select(*df.columns)
    likely, rest = likely_and_not(df, key, gone, key)
    return rest.unionByName(likely.join(gone, [key, check], "left_anti").select(*df.columns))
