import random
import re

import numpy as np
import pytest

from tallymill.llm import jaccard
from tallymill.llm.components import components


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                top[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(repr((rows[i][0], len(sets[i]), least[find(i)])) for i in range(len(rows)))


def found(spark, rows, limits=jaccard.Limits()):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, node int, shingles string")
    return sorted(repr(tuple(r)) for r in jaccard.link_documents(docs.repartition(4), limits=limits).collect())


def made_rows(seed, n):
    """Copies, edited copies, chains of edits, shared passages of many sizes."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    texts = []
    while len(texts) < n:
        words = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 120]))]
        if rng.random() < 0.3:
            words = passage + words
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = word()
            words += [word() for _ in range(rng.choice([0, 1, 4]))]
            texts.append(rng.choice([" ", "\n", "\t  "]).join(words).upper())
    rng.shuffle(texts)
    return list(enumerate(texts[:n]))


# The second has lists salted and tiles in blocks.
@pytest.mark.parametrize("limits", [jaccard.Limits(), jaccard.Limits(6, 8, 3)])
def test_components_equal_brute_force(spark, limits):
    rows = made_rows(3, 400)
    assert found(spark, rows, limits) == brute(rows)


def test_sample_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a b c d"), (8, "é a b c d")]
    rows += [(9, "a\xa0b c"), (None, "one"), (None, None), (None, "alone here"), (11, long), (10, long + " y"), (6, "one two")]
    rows += [(20 + i, "the same six words in all") for i in range(30)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_threshold_is_met_exactly(spark):
    def numbered(n, start=0):
        return " ".join(f"t{start + i}" for i in range(n))

    # 34 words give 30 shingles, 40 shared of 44 words; 30 of 40 is 0.75, 29 of 39 is below.
    rows = [(1, numbered(34)), (2, numbered(44)), (3, numbered(33, 1000)), (4, numbered(43, 1000))]
    assert found(spark, rows) == brute(rows)


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(1)
    for _ in range(300):
        universe = np.unique(rng.integers(0, 2**63, rng.integers(2, 600)).astype(np.uint64))
        x, y = (np.sort(universe[rng.random(len(universe)) < rng.random()]) for _ in "ab")
        if len(x) and len(y):
            a, b = jaccard.signature(x), jaccard.signature(y)
            length = min(len(a), len(b))
            differ = int(np.bitwise_count(jaccard.folded(a, length) ^ jaccard.folded(b, length)).sum())
            assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 7), (200, 200), (300, 301)]
    made = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {-5: -5} | {i: -5 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def group_below(seed, n, own=0.9):
    """Sets of which any two share less than three quarters, as each keeps a random part of one text."""
    rng = random.Random(seed)
    base = rng.sample(range(1 << 62), 400)
    return [sorted({x for x in base if rng.random() < own} | set(rng.sample(range(1 << 62), 30))) for _ in range(n)]


def test_a_group_below_the_threshold_gives_no_more_rows_than_it_has(spark):
    sets = [np.array(s, dtype=np.uint64) for s in group_below(4, 2000)]
    rows = [
        (1, 0, 0, 0, 0, n, len(s), True, n, 0, s.tobytes(), np.uint64(len(s)).tobytes() + jaccard.signature(s).tobytes())
        for n, s in enumerate(sets)
    ]
    schema = (
        "list bigint, band int, i int, j int, block int, node bigint, size int, inner boolean, component bigint, guest int,"
        " shingles binary, bits binary"
    )
    table = spark.createDataFrame(rows, schema)
    tile, known = table.drop("shingles", "bits"), table.select("node", "shingles", "bits")
    partners = jaccard._with_partner(tile, known).collect()
    links = [(r["a"], r["b"]) for r in jaccard._tile_links(tile, known).collect()]
    assert 1000 < len(partners) <= len(rows) and len(links) < len(rows)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        assert jaccard._similar(sets[a], sets[b])
        top[find(a)] = find(b)
    some = random.Random(1).sample(range(len(sets)), 60)
    for i in some:
        for j in range(0, len(sets), 7):
            assert find(i) == find(j) or not jaccard._similar(sets[i], sets[j])


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    lengths = np.array([len(s) for s in sets])
    shared = jaccard.overlaps(sets[3], np.cumsum(lengths) - lengths, lengths, np.concatenate(sets))
    assert shared.tolist() == [len(set(sets[3].tolist()) & set(s.tolist())) for s in sets]


def test_tables_of_tasks_are_added_up(spark):
    from tallymill.llm import common

    rows = spark.range(0, 5000, 1, 70).selectExpr("id % 997 as n")
    table = common.count_table(rows, 1 << 17, lambda batch: batch.column(0).to_numpy())
    assert table.sum() == 5000 and table[:997].tolist() == [5 + (n < 15) for n in range(997)]
    near, far = common.likely_and_not(spark.range(3000), "id", spark.range(0, 300, 3).withColumnRenamed("id", "n"), "n")
    kept = {r["id"] for r in near.collect()}
    assert set(range(0, 300, 3)) <= kept and len(kept) < 160
    assert kept.isdisjoint(r["id"] for r in far.collect()) and far.count() + len(kept) == 3000
