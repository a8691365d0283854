import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import codes
from tallymill.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code int, block int"


def brute(rows):
    """(vec_id, code, error, label_error) and the digest, with Python's own integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    lengths = [len(r[1]) for r in kept]
    width = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    kept = [(r[0], r[2], [math.floor(1024 * x) for x in r[1]]) for r in kept if len(r[1]) == width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    parts = [slice(width * p // 4, width * (p + 1) // 4) for p in range(4)]
    books = [[r[2][s] for r in first] for s in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(4):
        for s, book in zip(parts, books):
            members = {}
            for r in kept:
                members.setdefault(nearest(r[2][s], book)[1], []).append(r[2][s])
            for e, own in members.items():
                book[e] = [sum(column) // len(own) for column in zip(*own)]
    found = [(r[0], r[1], [nearest(r[2][s], book) for s, book in zip(parts, books)]) for r in kept]
    sums = {}
    for _, label, near in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in near)
    told = [(i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), sums[label]) for i, label, near in found]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted(map(repr, told)), hashlib.sha256(text.encode()).hexdigest()


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    told, books = codes.compress(table)
    return sorted(repr(tuple(r)) for r in told.select("vec_id", "code", "error", "label_error").collect()), codes.digest_of(books)


def made_rows(n, d, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (clusters, d))
    points = (centers[rng.integers(0, clusters, n)] + rng.normal(0, 0.05, (n, d))).astype(np.float32)
    return [(i, p.tolist(), int(rng.integers(0, 4))) for i, p in enumerate(points)]


@pytest.mark.parametrize("n, d", [(700, 8), (100, 16), (1, 4)])
def test_equals_brute_force(spark, monkeypatch, n, d):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 50)
    rows = made_rows(n, d)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = made_rows(300, 8, 2)
    bad = [None, [], [None] * 8, [1.0] * 7 + [None], [math.nan] * 8, [math.inf] + [0.0] * 7, [1.0] * 5]
    rows += [(i, v, 1) for i, v in enumerate(bad)] + [(None, [0.5] * 8, None), (None, [-0.5] * 8, None)]
    rows += [(3, rows[3][1], None)] * 40 + [(500, [0.0] * 8, 1)] * 40 + [(501, [-1e-9] * 8, 1), (502, [100.0, -131071.0] * 4, 2)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [])[0] == [] and found(spark, [(1, None, 1)])[0] == []


def test_ties_and_large_numbers(spark):
    rng = np.random.default_rng(7)
    small = rng.integers(-3, 4, (600, 8)) / 1024
    large = rng.integers(-3, 4, (600, 8)) * 16384.0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate([*small, *large])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert found(spark, rows) == brute(rows)


def test_length_that_four_does_not_divide(spark):
    rows = made_rows(60, 10, 3)
    assert found(spark, rows) == brute(rows)


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (64, 16))
    points = entries[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (4000, 16))
    before = codes.squares(points, entries).argmin(axis=1)
    moved = entries + rng.integers(-40, 40, entries.shape)
    own, best, taken = codes.Balls.of(moved).nearest(points, before)
    apart = codes.squares(points, moved)
    assert (own == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert taken < 0.05 * apart.size
    scattered = rng.integers(-4000, 4000, (4000, 16))
    own, best, taken = codes.Balls.of(moved).nearest(scattered, codes.squares(scattered, entries).argmin(axis=1))
    apart = codes.squares(scattered, moved)
    assert (own == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_blocks_and_codes_meet_without_a_shuffle(spark, monkeypatch):
    from tests.conftest import plan_of

    monkeypatch.setattr(codes, "BLOCK_ROWS", 50)
    rows = spark.createDataFrame([(r[0], r[2], [int(x * 1024) for x in r[1]]) for r in made_rows(500, 8)], "id long, label int, vector array<int>")
    dealt = codes._Dealt(4)
    blocks = dealt.keep(codes._blocks(rows, 8, "int"), "blocks")
    round_ = dealt.keep(blocks.select("block", F.lit(b"x").alias("codes")), "codes", dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = blocks.join(round_, "block")
        assert joined.count() == blocks.count() >= 10
        assert "Exchange" not in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        dealt.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallymill_")]


def test_sql_gives_the_same(spark, small):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    theirs = connection.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLE_SQL['op11_codes']})").fetchall()
    told, books = codes.compress(spark.read.parquet(f"{small}/embeddings.parquet"))
    ours = told.withColumn("digest", F.lit(codes.digest_of(books))).select("vec_id", "code", "error", "label_error", "digest").collect()
    assert sorted(theirs) == sorted(tuple(r) for r in ours)
