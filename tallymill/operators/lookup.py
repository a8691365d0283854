"""Equi-join of a fact table with lookup tables that have one row per key."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What all lookups of one join together may take as broadcast tables. A row costs its values plus the hash table around them.
BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 48
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Parts of a join whose shuffles shall not lie on disk all at once. Each reads the fact once.
PARTS = 4

# Size of a heavy-hitter sketch: at least so many keys, and so many per shuffle partition. Its counts are off by a small
# part of what a partition holds on average.
_TRACKED_KEYS = 4096
_TRACKED_PER_PARTITION = 8
_MOST_TRACKED = 1_000_000
_SKETCH_BRANCHES = 1024


def measured_bytes(lookups: Sequence[DataFrame]) -> list[float]:
    """Size of each lookup as a broadcast table, counted in one job; infinite where a row has no clear width."""
    widths = []
    for at, lookup in enumerate(lookups):
        texts = [f.name for f in lookup.schema.fields if isinstance(f.dataType, T.StringType)]
        width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(t), F.lit(0)) for t in texts], F.lit(0))
        widths.append(lookup.select(F.lit(at).alias("at"), width.cast("bigint").alias("text")))
    counted = reduce(DataFrame.unionByName, widths).groupBy("at").agg(F.count("*").alias("rows"), F.sum("text").alias("text"))
    found = {row["at"]: row for row in counted.collect()}  # one row per lookup that has any
    sizes = []
    for at, lookup in enumerate(lookups):
        fields = lookup.schema.fields
        known = all(isinstance(f.dataType, (T.StringType, *_FIXED_WIDTH)) for f in fields)
        size = found[at]["rows"] * (8 * len(fields) + _ROW_OVERHEAD) + found[at]["text"] if at in found else 0.0
        sizes.append(float(size) if known else float("inf"))
    return sizes


def within_budget(sizes: Sequence[float], budget: float) -> list[bool]:
    """Which lookups are broadcast: the smallest first, while all of them together stay within the budget."""
    chosen, left = [False] * len(sizes), budget
    for at in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if sizes[at] <= left:
            chosen[at], left = True, left - sizes[at]
    return chosen


def salt_counts(counts: Mapping, rows: int, partitions: int) -> dict:
    """Number of salts of each hot key. A key is hot from half of a partition's mean share on, and gets a salt for each such
    half, so that the rows of one (key, salt) never outweigh what a partition holds anyway."""
    share = rows / (2 * partitions)
    return {key: math.ceil(n / share) for key, n in counts.items() if n >= share and math.ceil(n / share) > 1}


def hot_keys(table: DataFrame, keys: Sequence[str], partitions: int) -> dict[str, dict]:
    """Salts per hot key of each of the columns of one table."""
    return hot_keys_of([(table, keys)], partitions)


def hot_keys_of(tables: Sequence[tuple[DataFrame, Sequence[str]]], partitions: int) -> dict[str, dict]:
    """Salts per hot key of each of the columns of several tables, found with mergeable sketches in one pass over these columns of each table.

    All tables are counted by one query. The sketches of the tasks are merged in two levels, so that no task receives those of
    all others. Keys are counted as text, and but for integers come back as such. A key that is listed or missed by the sketch's error costs
    time only, never a row. At most 2 * partitions keys of a column come back.
    """
    tracked = min(_MOST_TRACKED, max(_TRACKED_KEYS, _TRACKED_PER_PARTITION * partitions))
    listed = []
    for table, keys in tables:
        entries = [F.struct(F.lit(key).alias("key"), F.col(key).cast("string").alias("item")) for key in keys]
        listed.append(table.select(F.inline(F.array(*entries))).where("item is not null"))
    counted = (
        reduce(DataFrame.unionByName, listed)
        .groupBy("key", (F.spark_partition_id() % _SKETCH_BRANCHES).alias("branch"))
        .agg(F.count("*").alias("rows"), F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("sketch"))
        .groupBy("key")
        .agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    )
    top = F.expr(f"approx_top_k_estimate(sketch, {min(2 * partitions, tracked)})")
    found: dict[str, dict] = {key: {} for _, keys in tables for key in keys}
    as_number = {key: isinstance(table.schema[key].dataType, T.IntegralType) for table, keys in tables for key in keys}
    for row in counted.select("key", "rows", top.alias("top")).collect():  # one row per column
        own = int if as_number[row["key"]] else str
        counts = {own(item["item"]): item["count"] for item in row["top"]}
        found[row["key"]] = salt_counts(counts, row["rows"], partitions)
    return found


def _salt(spread_by: Sequence[str], salts: Column) -> Column:
    # A hash of the row's own values: a retried task must give every row the salt it had before, which rand() or a
    # row number cannot promise after a shuffle.
    return F.pmod(F.xxhash64(*spread_by), salts).cast("int")


def salted_joins(
    fact: DataFrame, lookups: Sequence[tuple[DataFrame, str]], key: str, hot: Mapping, spread_by: Sequence[str], partitions: int
) -> DataFrame:
    """Shuffle joins on (key, salt) with (lookup, how) pairs of one key, for which ``fact`` is shuffled once.

    Rows of hot keys spread over the key's salts by a hash of their ``spread_by`` columns, rows without a key over all
    partitions; the lookup rows of hot keys repeat once per salt.
    """
    for _, how in lookups:
        if how not in ("left", "inner"):
            raise ValueError(f"a lookup keeps the rows of the fact side: left or inner, not {how}")
    salts = F.coalesce("_salts", F.lit(1))
    listed = fact.sparkSession.createDataFrame([(str(k), n) for k, n in hot.items()], "item string, _salts int")
    spread = None
    for lookup, how in lookups:
        own = F.col("item").try_cast(lookup.schema[key].dataType).alias(key)
        known = F.broadcast(listed.select(own, "_salts"))  # at most 2 * partitions rows
        if spread is None:
            salt = _salt(spread_by, F.when(F.col(key).isNull(), partitions).otherwise(salts))
            spread = fact.join(known, key, "left").withColumn("_salt", salt).drop("_salts")
        repeated = lookup.join(known, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        # Counted to be too large, so Spark must not take it for small from the size of its files.
        spread = spread.join(repeated.hint("merge"), [key, "_salt"], how)
    return spread.drop("_salt")


# Bits of the types that can share a 64-bit word. Each column takes one bit more, which tells a null.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32}
_WORD = "_word"


def packed(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Those of the named columns that fit into one 64-bit word as one column, and what puts them back.

    A shuffled row spends eight bytes on each column, however narrow its type.
    """
    types, places, free = dict(df.dtypes), {}, 64
    for name in names:
        bits = _BITS.get(types.get(name), 64) + 1
        if bits <= free:
            places[name], free = (64 - free, bits - 1), free - bits
    if len(places) < 2:
        return df, lambda joined: joined
    word = F.lit(0).cast("bigint")
    for name, (at, bits) in places.items():
        value = F.col(name).cast("bigint").bitwiseAND((1 << bits) - 1) * 2
        word = word.bitwiseOR(F.shiftleft(F.coalesce(value, F.lit(1).cast("bigint")), at))

    def restored(joined: DataFrame) -> DataFrame:
        values = {}
        for name, (at, bits) in places.items():
            value = F.shiftright(F.shiftleft(F.col(_WORD), 63 - at - bits), 64 - bits)  # keeps the sign
            given = F.shiftright(F.col(_WORD), at).bitwiseAND(1) == 0
            values[name] = F.when(given, value.cast(types[name]))
        return joined.withColumns(values).drop(_WORD)

    return df.withColumn(_WORD, word).drop(*places), restored


def _same_integers(a: T.DataType, b: T.DataType) -> bool:
    return isinstance(a, T.IntegralType) and a == b


class _Side:
    """A table and the lookups to join with it, as (position, lookup, key, how)."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.columns = set(table.columns)
        self.steps: list[tuple[int, DataFrame, str, str]] = []

    def joined(
        self, small: Sequence[bool], hot: Mapping[str, Mapping], spread_by: Sequence[str], partitions: int, packs: Sequence[str] = ()
    ) -> DataFrame:
        """Large lookups first, as soon as their key is there, so that a shuffled row carries less of what others bring."""
        left, table, restored = list(self.steps), self.table, None
        while left:
            there = [step for step in left if step[2] in table.columns]
            large = [step for step in there if not small[step[0]]]
            if large:
                key = large[0][2]
                if restored is None:
                    table, restored = packed(table, packs)
                done = [step for step in large if step[2] == key]
                table = salted_joins(table, [(lookup, how) for _, lookup, _, how in done], key, hot[key], spread_by, partitions)
            else:
                done = (there or left)[:1]
                _, lookup, key, how = done[0]
                table = table.join(F.broadcast(lookup), key, how)
            left = [step for step in left if step[0] not in {at for at, *_ in done}]
        return table if restored is None else restored(table)


def lookup_joins(
    fact: DataFrame,
    lookups: Sequence[tuple],
    spread_by: Sequence[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    key_tables: Mapping[str, DataFrame] | None = None,
    sizes: Sequence[float] | None = None,
    packs: Sequence[str] = (),
    in_parts: Callable[[list[DataFrame]], DataFrame] | None = None,
) -> DataFrame:
    """Join ``fact`` with each (lookup, key), or (lookup, key, how) where that is not ``how``, as if in turn.

    ``spread_by`` names a few columns that tell the rows of one key apart, best an id of the row. They are read
    in any case, so they should be columns that the result needs. So are ``packs``: narrow whole numbers, none of them a key, that
    cross a shuffle in one word.

    The lookups are counted first, unless ``sizes`` tells. Those that fit a common budget are broadcast, and the fact is not
    shuffled for them. For a larger one both sides are shuffled on the key, with hot keys salted. Adaptive execution alone
    would not do there: it leaves a skewed join alone when the next step groups by the join key, since splitting would cost
    one more shuffle.

    What is shuffled lies on disk until the query ends, so the fact, the longest table, is shuffled once for each large lookup with a
    key of its own. A lookup whose key a large one brings is joined to that one, once per row of it instead of once per row
    of the fact. Where that still leaves more than one such key, ``in_parts`` gets the joined rows in ``PARTS`` tables, by a hash of the
    last of these keys, and returns all of them: if it writes one after the other, what one part shuffles can go before the next.

    Hot keys are counted in ``key_tables``: per key a table that holds it as often as the table it is joined to, or nearly, and has no
    join in its plan. A key not named there is counted in the fact if that has it, else in the lookup that brings it.
    """
    steps = [(at, lookup, key, *(own or [how])) for at, (lookup, key, *own) in enumerate(lookups)]
    tables = [lookup for _, lookup, _, _ in steps]
    if sizes is None:
        sizes = measured_bytes(tables) if broadcast_bytes > 0 else [math.inf] * len(tables)
    small = within_budget(sizes, broadcast_bytes)
    partitions = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted: dict[str, DataFrame] = {}
    for at, _, key, _ in steps:
        if not small[at] and key not in counted:
            holders = [fact, *[t for _, t, own, _ in steps[:at] if own != key]]
            named = (key_tables or {}).get(key)
            counted[key] = next(t for t in holders if key in t.columns) if named is None else named
    holders = {id(t): t for t in counted.values()}.values()
    hot = hot_keys_of([(table, [key for key, t in counted.items() if t is table]) for table in holders], partitions) if counted else {}

    whole, branches, names = _Side(fact), {}, fact.columns
    for step in steps:
        at, lookup, key, kind = step
        names = [key, *[c for c in names if c != key], *[c for c in lookup.columns if c != key]]
        # Rows that find nothing in a left join must still meet an inner one after it.
        bringing = [b for root, b in branches.items() if key in b.columns and (steps[root][3] == "inner" or kind == "left")]
        side = whole if key in whole.columns or not bringing else bringing[0]
        side.steps.append(step)
        if side is whole and not small[at]:
            branches[at] = _Side(lookup)
        else:
            side.columns |= set(lookup.columns)

    def joined(split: str | None = None, part: int = 0) -> DataFrame:
        own = None if split is None else F.pmod(F.xxhash64(split), F.lit(PARTS)) == part
        placed = _Side(fact if own is None else fact.where(own))
        for at, lookup, key, kind in whole.steps:
            if at in branches:
                # Equal whole numbers of one type have the same hash; a lookup with other keys stays whole.
                alike = key == split and _same_integers(lookup.schema[key].dataType, fact.schema[key].dataType)
                branch = _Side(lookup.where(own) if alike else lookup)
                branch.steps = branches[at].steps
                lookup = branch.joined(small, hot, [key], partitions)
            placed.steps.append((at, lookup, key, kind))
        rows = placed.joined(small, hot, spread_by, partitions, packs)
        return rows.select(*names) if len(set(names)) == len(names) else rows

    shuffled_by = list(dict.fromkeys(key for at, _, key, _ in whole.steps if at in branches and key in fact.columns))
    if in_parts is None or len(shuffled_by) < 2:
        return joined()
    return in_parts([joined(shuffled_by[-1], part) for part in range(PARTS)])
