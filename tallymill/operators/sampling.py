"""Exact-size random sample that gives the same rows on any cluster and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first four hex digits of the hash: at most 65,536 groups, however many rows there are.
_PREFIX_DIGITS = 4


def shuffle_key(id_column: str, seed: int) -> Column:
    """Position of a row in the random order of ``seed``, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in the random order of ``seed``; all rows if there are no more than ``n``.

    Rows are counted per hash prefix, which reads the id alone. One more scan takes the prefixes up to the cut; the rows
    of the prefix at the cut, one 65,536th of the table, are ranked by their keys alone, without the other columns.
    """
    key = shuffle_key(id_column, seed)
    prefix = F.substring(key, 1, _PREFIX_DIGITS)
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        df.select(prefix.alias("prefix"))
        .groupBy("prefix")
        .agg(F.count("*").alias("rows"))
        .select("prefix", "rows", F.sum("rows").over(running).alias("so_far"))
        .where(F.col("so_far") >= n)
        .orderBy("prefix")
        .first()
    )
    if cut is None:
        return df
    wanted = n - (cut["so_far"] - cut["rows"])
    if wanted == cut["rows"]:
        return df.where(prefix <= cut["prefix"])
    at_cut = df.where(prefix == cut["prefix"]).select(key.alias("key")).orderBy("key").limit(wanted)
    last = at_cut.agg(F.max("key").alias("key"), F.count("*").alias("rows")).first()["key"]
    ties = df.where(key == last).count()
    below = df.where(key < last).count() if ties > 1 else n - 1
    if below + ties == n:
        return df.where(key <= last)
    # Copies of one id share a key; as many of them as are wanted, whichever.
    return df.where(key < last).unionByName(df.where(key == last).limit(n - below))
