"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks, decoded by Viterbi.

Each block has one of two labels. A label sequence scores the sum of the weights of the main blocks' features and of the
transitions between neighbours. Weights maximise the likelihood of labelled pages, with gradients by forward and backward sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymill.llm.html_blocks import Block, blocks_of
from tallymill.llm.html_training import labelled_pages


@dataclass(frozen=True)
class BlockModel:
    """Weight of each feature towards main text, and scores of the four transitions (from, to)."""

    weights: dict[str, float]
    bias: float
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest label sequence."""
        weights, moves = self.weights, self.transitions
        best, back = (0.0, 0.0), []
        for at, block in enumerate(blocks):
            main = self.bias + sum(weights.get(f, 0.0) for f in block.features)
            if at:
                from_0 = [best[0] + moves[0][0], best[0] + moves[0][1]]
                from_1 = [best[1] + moves[1][0], best[1] + moves[1][1]]
                back.append((int(from_1[0] > from_0[0]), int(from_1[1] > from_0[1])))
                best = (max(from_0[0], from_1[0]), max(from_0[1], from_1[1]) + main)
            else:
                best = (0.0, main)
        if not blocks:
            return []
        path = [int(best[1] > best[0])]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> BlockModel:
    """Model of labelled pages: the likelihood's gradient over all pages at once, with Adam."""
    parsed = [(blocks_of(page), labels) for page, labels in pages]
    parsed = [(blocks, labels) for blocks, labels in parsed if blocks]
    for blocks, labels in parsed:
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
    names = sorted({f for blocks, _ in parsed for b in blocks for f in b.features})
    place = {name: i for i, name in enumerate(names)}
    longest, count = max(len(b) for b, _ in parsed), len(parsed)
    gold = np.zeros((count, longest), dtype=int)
    valid = np.zeros((count, longest), dtype=bool)
    owner, feature = [], []
    for i, (blocks, labels) in enumerate(parsed):
        gold[i, : len(labels)], valid[i, : len(labels)] = labels, True
        for j, block in enumerate(blocks):
            for name in block.features:
                owner.append(i * longest + j)
                feature.append(place[name])
    owner, feature = np.array(owner), np.array(feature)
    follows = valid[:, 1:]
    gold_moves = np.zeros((2, 2))
    np.add.at(gold_moves, (gold[:, :-1][follows], gold[:, 1:][follows]), 1)
    n = len(names)
    params = np.zeros(n + 1 + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)

    def joined(x):  # log of the sum over the first axis of two
        return np.logaddexp(x[0], x[1])

    for step in range(1, rounds + 1):
        moves = params[n + 1 :].reshape(2, 2)
        main = np.bincount(owner, params[feature], count * longest).reshape(count, longest) + params[n]
        node = np.stack([np.zeros_like(main), main])
        forward, backward = np.zeros((2, count, longest)), np.zeros((2, count, longest))
        forward[:, :, 0] = node[:, :, 0]
        for t in range(1, longest):
            for y in (0, 1):
                forward[y, :, t] = joined([forward[x, :, t - 1] + moves[x, y] for x in (0, 1)]) + node[y, :, t]
            forward[:, :, t] = np.where(valid[:, t], forward[:, :, t], forward[:, :, t - 1])
        for t in range(longest - 2, -1, -1):
            for x in (0, 1):
                value = joined([moves[x, y] + node[y, :, t + 1] + backward[y, :, t + 1] for y in (0, 1)])
                backward[x, :, t] = np.where(valid[:, t + 1], value, 0.0)
        total = joined(forward[:, :, -1])
        chance = np.exp(forward[1] + backward[1] - total[:, None]) * valid
        error = (chance - gold) * valid
        expected = np.zeros((2, 2))
        for x in (0, 1):
            for y in (0, 1):
                both = forward[x, :, :-1] + moves[x, y] + node[y, :, 1:] + backward[y, :, 1:] - total[:, None]
                expected[x, y] = np.exp(both[follows]).sum()
        gradient = np.concatenate([np.bincount(feature, error.ravel()[owner], n), [error.sum()], (expected - gold_moves).ravel()]) / valid.sum()
        gradient += decay * params / n
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    a, b, c, d = params[n + 1 :].tolist()
    return BlockModel(dict(zip(names, params[:n].tolist())), float(params[n]), ((a, b), (c, d)))


@lru_cache(maxsize=1)
def default_model() -> BlockModel:
    return train(labelled_pages())


def main_text(page: str | None, model: BlockModel) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, main in zip(blocks, model.labels(blocks)) if main)


def extract_text(
    pages: DataFrame, keep: list[str], html_column: str = "html", model: BlockModel | None = None
) -> DataFrame:
    """``keep``, text and n_chars (code points) of every page, from its whole html.

    A null or empty page, and one without main text, gives an empty text. Pages are independent, so repeated rows, null ids
    and very long pages are treated like others; other columns do not matter.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    schema = StructType([*[pages.schema[c] for c in keep], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py(), shared.value) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    schema.names,
                )

    return pages.select(*keep, html_column).mapInArrow(run, schema)
