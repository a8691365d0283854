"""Shards of nearly equal bytes: sampled splitters, range partitions, overfull ranges divided again.

A record's place is the hash of its text and then its own row number. So equal texts lie side by side, no two records
share a place, and a text that makes up a third of all records is divided by row number like any other range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallymill.llm.common import kept

RECORD_BYTES = 8
SAMPLES_PER_RANGE = 20
ROWS_PER_RANGE = 200_000
RANGES_PER_SHARD = 32


def measured_records(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, size, checksum and place of every record; a null text counts as empty."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("record_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )


def _splitters(records: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int]]:
    """At most ``wanted`` - 1 places that cut records of ``total`` bytes into ranges of about equal bytes.

    Records are drawn with a chance in proportion to their size: each draws an exponential waiting time with its size as rate,
    and those below a time that so many records are expected to stay below are the sample. No task needs to know of another.
    """
    waiting = -F.log1p(-F.rand(seed)) / F.col("size")
    drawn = records.where(waiting < F.lit(SAMPLES_PER_RANGE * wanted / total)).select("place", "row").toArrow()
    # In all about SAMPLES_PER_RANGE * wanted rows of two numbers.
    places = sorted(zip(drawn.column("place").to_pylist(), drawn.column("row").to_pylist()))
    at = sorted({len(places) * i // wanted for i in range(1, wanted)} - {0})
    return [places[i] for i in at]


def _with_range(records: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """The number of each record's range: how many cuts lie at or below its place."""
    places = np.array([p for p, _ in cuts], dtype=np.int64)
    rows = np.array([r for _, r in cuts], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            row = batch.column("row").to_numpy()
            first = np.searchsorted(places, place, "left")
            last = np.searchsorted(places, place, "right")
            found = last.copy()
            for start, end in set(zip(first[first < last].tolist(), last[first < last].tolist())):
                tied = (first == start) & (last == end)  # cuts inside one text
                found[tied] = start + np.searchsorted(rows[start:end], row[tied], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype("int32"))], [*batch.schema.names, "range"])

    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("range", IntegerType())]))


def shard_records(
    docs: DataFrame, n_shards: int = 24, id_column: str = "doc_id", text_column: str = "text", seed: int = 7
) -> DataFrame:
    """One row per record: record_id, size, text_crc32, shard (0 to n - 1), slot (0, 1, ... in the shard).

    Shards follow each other in the order of places and differ by about one record in their bytes. A null text is empty; a
    null id stays null; repeated rows are records of their own; an empty table gives no row. Other columns do not matter.
    """
    records = kept(measured_records(docs, id_column, text_column), "shard-records")
    total = records.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    if not total["rows"]:
        return records.select("record_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ranges = max(RANGES_PER_SHARD * n_shards, -(-total["rows"] // ROWS_PER_RANGE))
    ranges = min(ranges, total["rows"])
    cuts = _splitters(records, total["bytes"], ranges, seed)
    limit_bytes, limit_rows = 2 * total["bytes"] / ranges, 2 * max(total["rows"] / ranges, 1)
    while True:
        ranged = _with_range(records, cuts)
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        found = {r["range"]: r for r in sizes.collect()}  # one row per range
        overfull = [
            k for k, r in found.items() if r["rows"] > 1 and (r["bytes"] > limit_bytes or r["rows"] > limit_rows)
        ]
        if not overfull:
            break
        seed += 1
        parts = sum(max(2, round(max(found[k]["bytes"] / limit_bytes, found[k]["rows"] / limit_rows) * 2)) for k in overfull)
        inside = ranged.where(F.col("range").isin(overfull))
        more = sorted({*cuts, *_splitters(inside, sum(found[k]["bytes"] for k in overfull), parts, seed)})
        if more == cuts:  # nothing but a record or two that are larger than a range
            break
        cuts = more

    starts, bytes_before, rows_before = [], 0, 0
    for k in range(len(cuts) + 1):
        if k in found:
            starts.append((k, bytes_before, rows_before))
            bytes_before, rows_before = bytes_before + found[k]["bytes"], rows_before + found[k]["rows"]
    starts = records.sparkSession.createDataFrame(starts, "range int, start_bytes bigint, start_rows bigint")
    inside = Window.partitionBy("range").orderBy("place", "row")
    placed = (
        ranged.join(starts, "range")
        .withColumn("bytes_before", F.sum("size").over(inside) - F.col("size") + F.col("start_bytes"))
        .withColumn("rows_before", F.row_number().over(inside) - F.lit(1) + F.col("start_rows"))
        .withColumn(
            "shard",
            F.expr(f"cast(bytes_before * {n_shards} div {total['bytes']} as int)"),
        )
    )
    placed = kept(placed.select("record_id", "size", "text_crc32", "shard", "rows_before"), "shard-places")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rows_before").alias("first")).collect()}
    first = F.get(F.lit([firsts.get(s, 0) for s in range(n_shards)]), F.col("shard"))
    return placed.select(
        "record_id", "size", "text_crc32", "shard", (F.col("rows_before") - first).cast("bigint").alias("slot")
    )
