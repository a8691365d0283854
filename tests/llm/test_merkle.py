import hashlib
import random
import zlib

import duckdb
import pytest

from tallymill.llm import merkle
from tallymill.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, words int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    ordered = {k: sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in names}
    below = {k: levels_of([leaf(r) for r in ordered[k]]) for k in names}
    above = levels_of([below[k][-1][0] for k in names])
    found = []
    for tree, k in enumerate(names):
        for place, r in enumerate(ordered[k]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = leaf(r, int(tampered)), ""
            for levels, at in ((below[k], place), (above, tree)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    node, proof, at = sha(other + node if at & 1 else node + other), proof + other, at >> 1
            found.append((r[0], leaf(r), below[k][-1][0], above[-1][0], sha(proof), node, node == above[-1][0]))
    return sorted(map(repr, found))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in merkle.manifest(docs.repartition(5)).collect())


def made_rows(n, ids, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "z", None, "", "-"]
    return [(i, f"text {rng.random()}", rng.choice(langs), rng.choice(["a", None, "ü"]), rng.choice([3, None, 0])) for i in ids[:n]]


@pytest.mark.parametrize("n", [1, 3, 1025, 5000])
def test_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = made_rows(n, rng.sample(range(-40_000, 40_000), n))
    assert found(spark, rows) == brute(rows)


def test_far_apart_ids(spark):
    rng = random.Random(4)
    rows = made_rows(300, [-(2**63), 2**63 - 1, 0, -1, *(rng.randrange(-(2**63), 2**63) for _ in range(296))])
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = made_rows(700, [i % 200 for i in range(700)]) + made_rows(100, [None] * 100, 2)
    rows += [(7, "same", "en", "a", 2**63 - 1)] * 400 + [(None, None, None, None, None)] * 50 + [(7, None, "en", "a", 1), (7, "", "en", "a", 1)]
    rows += [(64, "x" * 1_000_000, "en", "a", 1)]
    assert found(spark, rows) == brute(rows)


def test_one_language_or_none(spark):
    rows = [(i, "t", "en", "s", i) for i in range(2049)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_tampered_rows_and_only_they_fail(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = merkle.manifest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def test_sql_gives_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    theirs = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op13_merkle']})").fetchall()
    assert sorted(theirs) == sorted(tuple(r) for r in merkle.manifest(docs).select(columns).collect())
