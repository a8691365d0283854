import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import ann


def brute(rows, every, k=5):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    found = {}
    for q, x in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        x = np.array(x)
        best = {}
        for i, v in usable:
            if i != q:
                cosine = (x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum()))
                best[i] = max(best.get(i, -2), float(cosine))
        ranked = sorted((-s, i) for i, s in best.items())[:k]
        found[q] = [(round(s, 9), i) for s, i in ranked]
    return found


def search(spark, rows, every=50, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows_ in found.values():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, len(rows_) + 1))
    return {q: [(-round(s, 9), i) for _, i, s in v] for q, v in found.items()}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, small, folder):
    df = spark.read.parquet(small.replace("sf0.001", folder) + "/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    wanted, found = brute(rows, 50), search(spark, rows)
    hits = sum(len({i for _, i in wanted[q]} & {i for _, i in found[q]}) for q in wanted)
    assert set(found) == set(wanted) and hits >= 0.9 * sum(map(len, wanted.values()))


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(400)]  # many copies, ties and zero vectors
    rows = list(enumerate(vectors))
    assert search(spark, rows, every=20, share=1.0, centroids=4) == brute(rows, 20)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (None, [1.0, 0.0])]
    assert search(spark, rows) == {}
    rows += [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (50, [1e30, 1e30]), (9, [1.0, 2.0, 3.0])]
    found = search(spark, rows)
    assert found[0] == [(-1.0, 7), (-1.0, 8), (-round(0.5**0.5, 9), 50)]
    assert [i for _, i in found[50]] == [0, 7, 8]
    assert search(spark, []) == {}


def test_a_vector_that_most_rows_share(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300 + i, [float(i + 1), 1.0, 0.0, 2.0]) for i in range(30)]
    found = search(spark, rows)
    assert [i for _, i in found[0]] == [1, 2, 3, 4, 5] and [i for _, i in found[100]] == [0, 1, 2, 3, 4]


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(2)
    index = ann.MultiIndex(rng.random((6, 2)), rng.random((5, 2)))
    a, b, sizes = rng.random(6), rng.random(5), rng.integers(0, 9, 30)
    order = np.argsort((a[:, None] + b[None, :]).ravel())
    for wanted in range(0, sizes.sum() + 5, 7):
        seen = index.visited(a, b, sizes, wanted)
        count = int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1 if wanted else 0
        assert set(np.flatnonzero(seen)) == set(order[:count].tolist())


def test_shards_hold_every_cell_once_and_split_only_overfull_ones():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 30, 100)
    sizes[[7, 50]] = 500, 131
    shards = ann.Shards.of(sizes.tolist(), 100)
    held = [0] * len(shards.first)
    for cell, (first, parts) in enumerate(shards.of_cell):
        assert parts == max(1, -(-sizes[cell] // 100))
        for part in range(parts):
            assert shards.first[first + part] <= cell < shards.end[first + part]
            held[first + part] += -(-sizes[cell] // parts)
    assert max(held) <= 100 and sum(held) >= sizes.sum()
    visited = rng.random(100) < 0.2
    sent = {s for s, _ in shards.marks(visited)}
    assert sent == {f + p for cell in np.flatnonzero(visited) for f, n in [shards.of_cell[cell]] for p in range(n)}


def test_only_entries_of_visited_cells_are_scored():
    rng = np.random.default_rng(6)
    vectors, queries = rng.normal(size=(4000, 16)), rng.normal(size=(50, 16))
    index = ann.MultiIndex(ann._fit(vectors[:, :8] / 4, 16, rng), ann._fit(vectors[:, 8:] / 4, 16, rng))
    cells = index.cell_of(vectors)
    sizes = np.bincount(cells, minlength=index.cells)
    a, b = index.halves(queries)
    visited = np.stack([index.visited(x, y, sizes, 800) for x, y in zip(a, b)])
    shards, scored = ann.Shards.of(sizes.tolist(), 500), 0
    for first, end in zip(shards.first, shards.end):
        own = np.flatnonzero((cells >= first) & (cells < end))
        lists = ann.Lists(vectors[own], [[int(i)] for i in own], cells[own], first)
        scores = lists.scores(queries, visited[:, first:end])
        plain = np.where(visited[:, cells[[i for x in lists.ids for i in x]]], 0, -np.inf)
        assert (np.isneginf(scores) == np.isneginf(plain)).all()
        scored += lists.scored
    assert scored == visited[:, cells].sum() and 800 * 50 <= scored <= 1000 * 50


def test_entries_are_not_copied_and_one_shard_holds_a_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRIES_PER_SHARD", 50)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    assert search(spark, rows, every=30, share=1.0, centroids=4) == brute([(i, np.float32(v).tolist()) for i, v in rows], 30)
