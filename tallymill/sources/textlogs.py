"""Text logs, plain or gzip: reading, sizes, writing in parts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: Sequence[str], parallelism: int | None = None) -> DataFrame:
    """One row ``value`` per line of the files, in UTF-8; ``.gz`` files are unpacked. A path named twice is read twice.

    Plain files are split where they lie. Gzip files cannot be: name a ``parallelism`` to deal their lines out to so many
    tasks before the costly parsing.
    """
    lines = spark.read.text(list(paths))
    return lines if parallelism is None else lines.repartition(parallelism)


def input_bytes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row: number of files and their bytes on disk (packed bytes for gzip). No content is read."""
    if not paths:
        raise ValueError("name at least one path")
    times = Counter(paths)
    # A path named n times is in n of the layers; one layer, and so one listing, is the usual case.
    layers = [[path for path, n in times.items() if n > layer] for layer in range(max(times.values()))]
    files = [spark.read.format("binaryFile").load(layer).select("path", "length") for layer in layers]
    found = reduce(DataFrame.unionByName, files)
    return found.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def write_lines(lines: DataFrame, path: str, parts: int, compression: str = "gzip") -> None:
    """Lines as ``parts`` text files, gzip unless told otherwise."""
    lines.select("value").repartition(parts).write.option("compression", compression).text(path)
