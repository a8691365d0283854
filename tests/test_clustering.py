import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.operators import kmeans as km
from tallymill.operators.sampling import hash_sample
from tallymill.sources import sample_tables

from conftest import plan_of


def frame(spark, matrix, parts=3):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts)


def plain_kmeans(x, centers, steps):
    objectives = []
    for _ in range(steps):
        apart = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        clusters = apart.argmin(axis=1)
        objectives.append(apart.min(axis=1).sum())
        centers = np.array([x[clusters == j].mean(axis=0) for j in range(len(centers))])
    return centers, objectives


def test_steps_against_plain_numpy(spark):
    x = np.random.default_rng(1).normal(size=(400, 5)).astype("float32").astype("float64")
    fit = km.kmeans(frame(spark, x), 6, max_iter=8, centers=x[:6])
    centers, objectives = plain_kmeans(x, x[:6], 8)
    assert fit.objectives == pytest.approx(objectives, rel=1e-12)
    assert np.allclose(fit.centers, centers)
    assert all(a >= b for a, b in zip(fit.objectives, fit.objectives[1:]))
    assert (fit.iterations, fit.inertia) == (8, fit.objectives[-1])


def test_vectors_far_from_the_origin(spark):
    rows = [(i, [1e8 + i % 2]) for i in range(8)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    start = np.array([[1e8], [1e8 + 1]])
    assert {tuple(r) for r in km.assign(vectors, start).collect()} == {(i, i % 2, 0.0) for i in range(8)}
    fit = km.kmeans(vectors, 2, max_iter=3, centers=start)
    assert fit.inertia == 0.0 and fit.centers.ravel().tolist() == [1e8, 1e8 + 1]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_the_nearest_center_is_found_anywhere(spark, offset):
    rng = np.random.default_rng(8)
    x, centers = rng.normal(size=(2000, 16)) + offset, rng.normal(size=(20, 16)) + offset
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["cluster"] for r in km.assign(vectors, centers).collect()}
    wanted = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [found[i] for i in range(len(x))] == wanted.tolist()


def test_known_objectives_of_the_sample(spark):
    vectors = sample_tables.sample_vectors(spark, "/root/testdata/sf0.01")
    start = np.array([r["embedding"] for r in vectors.orderBy("vec_id").limit(10).collect()])
    fit = km.kmeans(vectors, 10, max_iter=4, centers=start)
    assert fit.objectives == pytest.approx((791.4910940141983, 466.049462, 461.838606, 459.649935), abs=1e-6)


def test_every_point_a_center(spark):
    x = np.arange(12, dtype=float).reshape(6, 2)
    assert km.kmeans(frame(spark, x), 6, max_iter=2).inertia == 0


def test_assign_prefers_the_lowest_cluster(spark):
    vectors = frame(spark, [[0, 0], [0, 0], [4, 0]])
    found = km.assign(vectors, np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(0, 0, 1.0), (1, 0, 1.0), (2, 0, 9.0)]


def test_empty_cluster_keeps_its_center(spark):
    x = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 3.0], [9.0, 9.0]])
    start = np.array([[0.0, 2.0], [9.0, 9.0], [500.0, 500.0]])
    fit = km.kmeans(frame(spark, x), 3, max_iter=3, centers=start)
    assert fit.inertia == 2.0 and fit.centers.tolist() == start.tolist()


def test_every_iteration_is_run(spark, monkeypatch):
    passes, sums = [], km.cluster_sums
    monkeypatch.setattr(km, "cluster_sums", lambda *args: passes.append(1) or sums(*args))
    x = [[0.0], [1.0], [10.0], [11.0]]
    fit = km.kmeans(frame(spark, x), 2, max_iter=7, centers=np.array([[0.0], [10.0]]))
    assert fit.iterations == len(passes) == 7 and fit.inertia == 1.0
    assert fit.objective_table(spark).count() == 7 and fit.center_table(spark).count() == 2


def test_redo_keeps_the_best(spark):
    x = np.random.default_rng(3).normal(size=(60, 2))
    vectors = frame(spark, x)
    single = [km.kmeans(vectors, 5, max_iter=3, seed=42 + i).inertia for i in range(3)]
    assert km.kmeans(vectors, 5, max_iter=3, seed=42, n_redo=3).inertia == pytest.approx(min(single))


def test_without_cache_and_other_partitions(spark):
    x = np.random.default_rng(4).normal(size=(100, 3))
    a = km.kmeans(frame(spark, x, 1), 4, max_iter=5)
    b = km.kmeans(frame(spark, x, 7), 4, max_iter=5, cache=False)
    assert a.objectives == pytest.approx(b.objectives)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_bad_input(spark):
    with pytest.raises(ValueError):
        km.kmeans(frame(spark, [[1.0]]), 2)
    with pytest.raises(ValueError):
        km.kmeans(frame(spark, [[1.0]]), 1, max_iter=0)
    with pytest.raises(ValueError, match="more than 8 bytes"):
        km.kmeans(frame(spark, [[1.0, 2.0]]), 1, model_bytes=8)
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="every vector must have"):
        km.assign(ragged, np.array([[1.0]])).collect()


def test_sample_is_exact(spark):
    ids = spark.range(5000).withColumnRenamed("id", "vec_id")
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    for n in (1, 37, 4999, 5000, 6000):
        found = sorted(r[0] for r in hash_sample(ids, "vec_id", n, 9).collect())
        assert found == sorted(order[:n]), n


def test_sample_with_copies_of_one_id(spark):
    ids = spark.range(300).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("vec_id"))
    for n in (1, 50, 150, 299):
        assert hash_sample(ids, "vec_id", n, 1).count() == n


def test_plan_shuffles_only_partial_rows(spark, small):
    packed = km.pack_vectors(sample_tables.sample_vectors(spark, small), 64)
    plan = plan_of(km.cluster_sums(packed, np.zeros((2, 64))))
    assert plan.count("Exchange") <= 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("ReadSchema: struct<embedding:array<float>>") > 0
