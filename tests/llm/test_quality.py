import math

import numpy as np
from pyspark.sql import functions as F

from conftest import plan_of
from tallymill.llm import quality


def rows_of(texts, grades):
    return [(g, 1.0, np.array([quality._hash(t) for t in quality.features(x)], dtype=np.uint32)) for x, g in zip(texts, grades)]


def made(n):
    kinds = ["good plain words about something", "rude nasty words about something", "|| ## !! junk junk junk junk"]
    return [f"{kinds[i % 3]} number{i}" for i in range(n)], [2 - i % 3 for i in range(n)]


def test_grades_are_ordered_and_learned():
    texts, grades = made(300)
    model = quality.fit(rows_of(texts, grades))
    assert model.grades == [0, 1, 2] and model.thresholds == sorted(model.thresholds)
    for text, grade in zip(texts[:30], grades):
        tails = model.at_least(sum(model.weights.get(quality._hash(t), 0) for t in quality.features(text)))
        assert tails == sorted(tails, reverse=True) and round(sum(tails)) == grade


def test_gradient_reaches_the_shares_without_features():
    model = quality.fit([(g, 1.0, np.empty(0, np.uint32)) for g in [0] * 20 + [1] * 30 + [2] * 50])
    assert [round(p, 2) for p in model.at_least(0.0)] == [0.8, 0.5]


def test_train_and_score(spark):
    texts, grades = made(240)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, grade string, expected_grade double")
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grades)] + [(None, 1), (3, None), (999, 2)], "doc_id long, grade int")
    model = quality.train(docs, ratings, per_grade=60)
    extra = spark.createDataFrame([(None, None, "x", 0.0), (7, "", "x", 0.0), (7, "good plain words " * 30_000, "x", 0.0)], docs.schema)
    found = quality.score(docs.union(extra), model, ["doc_id"]).collect()
    assert len(found) == 243 and found[0].asDict().keys() == {"doc_id", "expected_grade", "tail_probability", "accepted"}
    assert all(r["accepted"] == (grades[r["doc_id"]] == 2) for r in found[:240])
    assert all(math.isclose(a, b) for a, b in zip([r["tail_probability"] for r in found], [r["tail_probability"] for r in quality.score(docs.union(extra), model, []).collect()]))


def test_without_ratings_everything_is_accepted(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 2)], "doc_id long, grade int")
    for ratings in (none, none.where("false")):
        found = quality.score(docs, quality.train(docs, ratings), ["doc_id"]).collect()
        assert [(r["expected_grade"], r["accepted"]) for r in found] == [(None, True)] * 2
    assert quality.score(docs.where("false"), quality.train(docs, none), ["doc_id"]).collect() == []


def test_held_out_documents(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    held_out = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, rated.where(~held_out))
    found = quality.score(docs, model, ["doc_id"]).join(rated.where(held_out), "doc_id")
    sound = {r["accepted"]: r["count"] for r in found.where("grade = 2").groupBy("accepted").count().collect()}
    poor = {r["accepted"]: r["count"] for r in found.where("grade = 0").groupBy("accepted").count().collect()}
    assert sound.get(True, 0) >= 0.95 * sum(sound.values()) and poor.get(False, 0) >= 0.8 * sum(poor.values())


DECAY = 0.01


def plain_loss(weights, thresholds, sets, levels, scale):
    """Mean of -log P(level) of the cumulative-link model, and the decay of the unscaled weights."""

    def below(j, score):
        return 0.0 if j < 0 else 1.0 if j >= len(thresholds) else 1 / (1 + math.exp(score - thresholds[j]))

    loss = 0.5 * DECAY * sum((weights[h] / scale[h]) ** 2 for h in weights)
    for own, level in zip(sets, levels):
        score = sum(weights.get(h, 0.0) for h in own)
        loss -= math.log(below(level, score) - below(level - 1, score)) / len(sets)
    return loss


def test_fit_is_the_optimum_of_the_plain_loss():
    rng = np.random.default_rng(3)
    sets, levels = [], []
    for _ in range(120):
        own = [h for h in range(1, 7) if rng.random() < 0.5]
        score = 2.0 * (1 in own) - 1.5 * (2 in own) + rng.logistic()
        sets.append(own)
        levels.append(0 if score < -0.7 else 1 if score < 0.8 else 2)
    model = quality.fit([(g, 1.0, np.array(s, dtype=np.uint32)) for s, g in zip(sets, levels)], 6000, 0.01, DECAY)
    mean = sum(levels) / len(levels)
    spread = math.sqrt(sum((g - mean) ** 2 for g in levels) / len(levels))
    scale = {}
    for h in range(1, 7):
        inside = [g for s, g in zip(sets, levels) if h in s]
        errors = sum(g - mean for g in inside) / (spread * math.sqrt(len(inside)))
        scale[h] = min(max((errors / quality.SURE) ** 2, 0.001), 1.0)
    best = plain_loss(model.weights, model.thresholds, sets, levels, scale)
    # The loss is convex: no step along any parameter lowers it, so it is the optimum.
    for step in (1e-3, -1e-3, 1e-2, -1e-2):
        for h in model.weights:
            moved = {**model.weights, h: model.weights[h] + step * scale[h]}
            assert plain_loss(moved, model.thresholds, sets, levels, scale) >= best - 1e-7
        for j in range(2):
            thresholds = [t + step * (i == j) for i, t in enumerate(model.thresholds)]
            assert plain_loss(model.weights, thresholds, sets, levels, scale) >= best - 1e-7
    assert set(model.weights) == set(range(1, 7)) and model.weights[1] > 0 > model.weights[2]


def test_scores_equal_the_plain_formula(spark, small):
    from tallymill.llm import queries

    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op1_quality(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = {quality._hash(t) for t in quality.features(texts[r["doc_id"]] or "")}
        score = sum(model.weights.get(quality._hash(t), 0.0) for t in quality.features(texts[r["doc_id"]] or ""))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert own and math.isclose(r["tail_probability"], above[-1], abs_tol=1e-9)
        steps = [b - a for a, b in zip(model.grades, model.grades[1:])]
        assert math.isclose(r["expected_grade"], model.grades[0] + sum(s * p for s, p in zip(steps, above)), abs_tol=1e-9)
        assert r["accepted"] == (r["tail_probability"] >= 0.5)


def test_a_kept_text_is_sent_once(spark):
    texts, grades = made(60)
    model = quality.fit(rows_of(texts, grades))
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string").withColumn("other", F.lit(1))
    with_text = quality.score(docs, model, ["other", "text", "doc_id"])
    assert with_text.columns[:3] == ["other", "text", "doc_id"] and "_quality_text" not in plan_of(with_text)
    found = {r["doc_id"]: r for r in with_text.collect()}
    assert {i: r["text"] for i, r in found.items()} == {**dict(enumerate(texts)), 60: None, 61: ""}
    alone = {r["doc_id"]: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    for i, row in found.items():
        assert row["accepted"] == alone[i]["accepted"]
        assert all(math.isclose(row[n], alone[i][n]) for n in ("expected_grade", "tail_probability"))
    assert found[60]["expected_grade"] == found[61]["expected_grade"]
