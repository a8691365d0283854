import zlib

import pytest

from tallymill.llm.sharding import shard_records


def check(spark, rows, n_shards=4, schema="doc_id bigint, text string, size string, place int"):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    found = [tuple(r) for r in shard_records(docs, n_shards).collect()]
    wanted = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r[0]), r[1], r[2]) for r in found) == wanted
    slots = {}
    for _, _, _, shard, slot in found:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n_shards))
    return found


def test_bytes_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "the same text") for i in range(400)] + [(i, f"text {i} " * (i % 50)) for i in range(400, 1200)]
    found = check(spark, rows, 6)
    sums = [sum(r[1] for r in found if r[3] == s) for s in range(6)]
    assert max(sums) - min(sums) <= 2 * max(r[1] for r in found)


def test_equal_texts_share_a_shard_unless_it_is_cut(spark):
    rows = [(i, f"text {i // 3}") for i in range(600)]
    found = check(spark, rows, 4)
    where = {}
    for r in found:
        where.setdefault(r[2], set()).add(r[3])
    assert sum(len(s) > 1 for s in where.values()) <= 3


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None)],
        [(1, None), (1, None), (1, ""), (None, "a")] * 5,
        [(1, "long " * 100_000), (2, "b"), (3, "b")],
        [(i, "one row, repeated") for i in [7] * 300],
    ],
)
def test_odd_rows(spark, rows):
    check(spark, rows)
