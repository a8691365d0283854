import random
import time

import pytest
from pyspark.sql import functions as F

from tallymill.llm import secrets, spans

SPAN = "array<struct<start:int,kind_no:int,end:int,match:string,before:string,after:string>>"


def made(rng, n, room):
    """Spans in order that do not overlap each other."""
    places = sorted(rng.sample(range(room), 2 * n))
    return [(a, 0, b, "m", "", "") for a, b in zip(places[::2], places[1::2])]


@pytest.mark.parametrize("n", [0, 1, 3, 255, 256, 257, 1000])
def test_running_sums_and_maxima(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(50) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, most = df.select(
        spans.running(F.col("v"), F.lit(0), lambda a, b: a + b), spans.running(F.col("v"), F.lit(-1), lambda a, b: F.greatest(a, b))
    ).first()
    assert sums == [sum(values[:i]) for i in range(n)]
    assert most == [max(values[:i], default=-1) for i in range(n)]


def test_outside_and_masked_equal_the_plain_way(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        room = rng.choice([10, 100, 900])
        n, m = rng.randrange(room // 3), rng.randrange(room // 3)
        # What covers may overlap itself.
        covered = sorted((s, 1, s + rng.randrange(1, 9), "c", "", "") for s in rng.choices(range(room), k=m))
        text = "".join(rng.choices("aé😀\n ", k=room + 10))
        rows.append((i, text, made(rng, n, room), covered))
    df = spark.createDataFrame(rows, f"id int, text string, own {SPAN}, covered {SPAN}")
    found = df.select("id", spans.outside(F.col("own"), F.col("covered")), spans.masked(F.col("text"), F.col("covered"), "[X]")).collect()
    for (_, text, own, covered), (_, free, hidden) in zip(rows, sorted(found)):
        assert [tuple(s) for s in free] == [s for s in own if not any(c[0] < s[2] and s[0] < c[2] for c in covered)]
        plain, at = "", 0
        for start, _, end, *_ in covered:
            plain += text[at:start] + "[X]" if start >= at else ""
            at = max(at, end)
        assert hidden == plain + text[at:]


def seconds(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = secrets.find_secrets(docs, "text", ["doc_id"]).select("secret_spans").first()[0]
    return time.time() - began, found


def test_long_runs_and_many_matches_take_time_in_proportion(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    seconds(spark, "token=abcdefgh1")
    short, _ = seconds(spark, "".join(rng.choices(letters, k=20_000)))
    long, found = seconds(spark, "".join(rng.choices(letters, k=200_000)))
    assert [(s["start"], s["end"]) for s in found] == [(0, 200_000)]
    assert long < 2 * short + 20
    text = "\n".join(f"é token=abcdefgh{i:06}" for i in range(100_000))
    took, found = seconds(spark, text)
    assert [s["start"] for s in found] == [2 + 23 * i for i in range(100_000)]
    assert took < 2 * short + 30
