"""Quality of documents by ordinal regression: one weight per hashed feature, shared by all grades, and ordered thresholds.

P(grade <= j) = sigmoid(threshold_j - w . x). The features of a text are its distinct words and runs of other signs, and
buckets of a few shares (capitals, signs, repeated words, repeated lines, length), all hashed to 32 bits. The model is fitted
on a bounded sample of rated documents; every document is then scored in its own task.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

# Rated documents per grade that the fit reads, at most. They are taken by a hash of their id.
SAMPLE_PER_GRADE = 4_000
# A feature needs so many documents of the sample to get a weight.
LEAST_DOCUMENTS = 4
# Standard errors from which a feature counts in full.
SURE = 8.0
KEEP_PROBABILITY = 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CAPITALS = bytes(range(65, 91))
_SIGNS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_CACHED = 60_000


def _bucket(name: str, share: float) -> str:
    return f"\x00{name}:{round(2 * math.log2(share + 2**-10))}"


def features(text: str) -> set[str]:
    """Distinct tokens in lower case, their first four letters, and the buckets of the shares, which no token can equal."""
    words = text.split()
    tokens = set(_TOKEN.findall(text.lower()))
    if not words:
        return {"\x00empty"}
    tokens.update(["\x01" + token[:4] for token in tokens if len(token) > 4])
    data = text.encode("utf-8", "surrogatepass")
    lines = [line for line in text.split("\n") if line]
    tokens.add(_bucket("capitals", 1 - len(data.translate(None, _CAPITALS)) / len(data)))
    tokens.add(_bucket("signs", 1 - len(data.translate(None, _SIGNS)) / len(data)))
    tokens.add(_bucket("distinct", len(set(words)) / len(words)))
    tokens.add(_bucket("stutter", sum(map(operator.eq, words, words[1:])) / len(words)))
    tokens.add(_bucket("lines", 1 - len(set(lines)) / len(lines)))
    tokens.add(f"\x00words:{len(words).bit_length()}")
    return tokens


def _hash(token: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(token)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Rating of a labelled document: 0 poor, 1 sound but toxic, 2 sound; null where a label is missing."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by hashed feature and one threshold below each grade but the first."""

    grades: list[int]
    thresholds: list[float]
    weights: dict[int, float]

    def at_least(self, score: float) -> list[float]:
        """P(grade >= g) for every grade but the lowest."""
        return [1 / (1 + math.exp(max(-500.0, min(500.0, t - score)))) for t in self.thresholds]


def fit(rows: list[tuple[int, float, np.ndarray]], rounds: int = 250, rate: float = 0.08, decay: float = 1e-4) -> OrdinalModel:
    """Ordinal regression on (grade, weight, hashed features) by Adam on the whole sample's gradient."""
    grades = sorted({g for g, _, _ in rows})
    if len(grades) < 2:
        return OrdinalModel(grades, [], {})
    hashes = np.concatenate([f for _, _, f in rows])
    every, often = np.unique(hashes, return_counts=True)
    every = every[often >= LEAST_DOCUMENTS]
    place = np.searchsorted(every, hashes).astype(np.int32) if len(every) else np.zeros(len(hashes), dtype=np.int32)
    held = every[np.minimum(place, len(every) - 1)] == hashes if len(every) else np.zeros(len(hashes), dtype=bool)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for _, _, f in rows])
    owner, place = owner[held], place[held]
    del hashes, held
    level = np.searchsorted(grades, [g for g, _, _ in rows])
    # A feature counts by how sure its documents' mean grade differs from that of all (squared): thousands of words that say nothing
    # would otherwise learn the sample by heart and outvote the few that do.
    found = np.bincount(place, minlength=len(every))
    apart = np.bincount(place, (level - level.mean())[owner], len(every)) / (max(level.std(), 1e-9) * np.sqrt(found + 1e-9))
    scale = np.clip((apart / SURE) ** 2, 0.001, 1.0)
    weight = np.array([w for _, w, _ in rows])
    weight = weight / weight.sum()
    cuts = len(grades) - 1
    # thresholds = first + running sum of exp(gaps)
    below = [min(max(weight[level <= j].sum(), 1e-3), 1 - 1e-3) for j in range(cuts)]
    start = np.log(np.array(below) / (1 - np.array(below)))
    params = np.concatenate([np.zeros(len(every)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(every)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    for step in range(1, rounds + 1):
        w, thresholds = params[:n], np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])]))
        score = np.bincount(owner, (w * scale)[place], len(rows))
        bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
        high, low = sigmoid(bounds[level + 1] - score), sigmoid(bounds[level] - score)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        by_score = weight * (slope_high - slope_low) / chance  # of the loss
        by_high, by_low = -weight * slope_high / chance, weight * slope_low / chance
        by_cut = np.bincount(level, by_high, len(grades))[:cuts] + np.bincount(level, by_low, len(grades))[1:]
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(place, by_score[owner], n) * scale + decay * w, tails[:1], tails[1:] * np.exp(params[n + 1 :])])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])]))
    return OrdinalModel(grades, thresholds.tolist(), dict(zip(every.tolist(), (params[:n] * scale).tolist())))


def train(docs: DataFrame, ratings: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """Model of rated documents. ``ratings`` has (id, grade); rows without a grade or text do not count.

    At most ``per_grade`` ratings of each grade are read, weighted to the grades' shares among all ratings. Their documents
    become hashed features in the tasks; those of the bounded sample are what the fit sees.
    """
    rated = ratings.select(F.col(id_column).alias("_id"), "grade").where("_id is not null and grade is not null")
    total = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    # Twice the rows wanted by the hash alone, of which the exact number is ranked, so that no task ranks a whole grade.
    share = F.lit(0.0)
    for grade, count in total.items():
        share = F.when(F.col("grade") == grade, F.lit(min(1.0, 2 * per_grade / count))).otherwise(share)
    place = F.xxhash64("_id", F.lit(1))
    order = Window.partitionBy("grade").orderBy(place, "_id")
    likely = rated.where(F.pmod(place, F.lit(1 << 30)) <= share * (1 << 30))
    chosen = likely.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_grade).drop("_rank")
    # At most per_grade rows of two numbers for each grade: a bound that does not grow with the tables.
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where("_text is not null")
    joined = texts.join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([_hash(t) for t in features(x.as_py())], dtype=np.uint32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["_id", "grade", "found"])

    id_type = docs.schema[id_column].dataType.simpleString()
    columns = joined.select("_id", F.col("grade").cast("int").alias("grade"), "_text")
    rows = columns.mapInArrow(run, f"_id {id_type}, grade int, found binary").dropDuplicates(["_id", "grade"]).collect()
    sampled = {g: sum(r["grade"] == g for r in rows) for g in total}
    rows.sort(key=lambda r: (r["grade"], r["_id"]))
    return fit([(r["grade"], total[r["grade"]] / sampled[r["grade"]], np.frombuffer(r["found"], np.uint32)) for r in rows])


class _Weights(dict):
    """Weights by token, from those by hash."""

    def __init__(self, by_hash: dict[int, float]):
        self.by_hash = by_hash

    def __missing__(self, token: str) -> float:
        if len(self) >= _CACHED:
            self.clear()
        value = self[token] = self.by_hash.get(_hash(token), 0.0)
        return value


def score(docs: DataFrame, model: OrdinalModel, keep: list[str], text_column: str = "text", least: float = KEEP_PROBABILITY) -> DataFrame:
    """``keep``, expected_grade, tail_probability (of the highest grade) and ``accepted``, for every row.

    A null text is empty, which is a feature of its own. Without ratings of two grades there is no model: grade and probability
    are null and every row is accepted. Repeated rows, null ids and long texts are scored like others; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Texts are most of what a batch holds, in the task and in its worker: those that are kept are not sent twice.
    rows, at = docs.select(*keep), keep.index(text_column) if text_column in keep else len(keep)
    if at == len(keep) or rows.schema.fields[at].dataType != StringType():
        rows, at = docs.select(*keep, F.coalesce(F.col(text_column), F.lit("")).alias("_quality_text")), len(keep)
    added = _parse_datatype_string("expected_grade double, tail_probability double, accepted boolean")
    schema = StructType([*rows.schema.fields[: len(keep)], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = _Weights(model.weights)
        steps = np.diff(model.grades)
        for batch in batches:
            expected, tail = [], []
            for text in batch.column(at):
                tails = model.at_least(math.fsum(map(weights.__getitem__, features(text.as_py() or ""))))
                expected.append(float(model.grades[0] + np.dot(steps, tails)) if tails else None)
                tail.append(tails[-1] if tails else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(expected, pa.float64()), pa.array(tail, pa.float64())]
                + [pa.array([t is None or t >= least for t in tail], pa.bool_())],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
