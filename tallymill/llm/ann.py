"""Nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves, each quantised by its own centroids; a pair of centroids is a cell. For a query, a heap
yields the pairs in the order of their summed distance until the cells hold enough entries, and the entries of the cells
visited are ranked by their true cosine on the original vectors.

Equal vectors are one entry with as many ids as a result can use, so a vector that a third of the rows share costs one
comparison. A shard holds the inverted lists of neighbouring cells, one after the other, and an overfull cell is dealt out
to several shards. A query goes to the shards of the cells that it visits, and there meets their lists and no others. A
task reads the lists of a shard first and then lets the queries pass, so it holds one shard, however many queries come.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import kept

# Entries that the centroids are fitted on, at most; every entry is indexed.
SAMPLE = 20_000
CENTROIDS = 64
# Share of the entries whose cells a query visits at least. Vectors without any clusters, the worst case, need this much for a
# recall above 0.9.
SHARE = 0.36
ENTRIES_PER_SHARD = 8_192
_ROUNDS = 12
_QUERIES_AT_ONCE = 128


def is_usable(vector: Column) -> Column:
    """No null, only finite components, not all of them zero."""
    large = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < large))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _fit(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids by Lloyd's rounds from random distinct points."""
    distinct = np.unique(points, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(_ROUNDS):
        near = _distances(points, centers).argmin(axis=1)
        sizes = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    cross = points @ centers.T
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * cross + (centers**2).sum(axis=1), 0)


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves."""

    left: np.ndarray
    right: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = vectors / np.abs(vectors).max(axis=1)[:, None]  # first by the largest, so that no square overflows
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        cut = self.left.shape[1]
        return _distances(unit[:, :cut], self.left), _distances(unit[:, cut:], self.right)

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.halves(vectors)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visited(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Which cells a query with these distances to the centroids visits, nearest pair first, until ``wanted`` entries."""
        by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        near_a, near_b = a[by_a].tolist(), b[by_b].tolist()
        seen = np.zeros(self.cells, dtype=bool)
        heap, held, width = [(near_a[0] + near_b[0], 0, 0)], 0, len(by_b)
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = by_a[i] * width + by_b[j]
            seen[cell] = True
            held += int(sizes[cell])
            if j + 1 < width:
                heapq.heappush(heap, (near_a[i] + near_b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(by_a):
                heapq.heappush(heap, (near_a[i + 1] + near_b[0], i + 1, 0))
        return seen


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(entries: DataFrame, centroids: int, seed: int) -> MultiIndex:
    """Index fitted on a sample of at most ``SAMPLE`` entries, drawn by a hash of the vector.

    Hashes too large to be drawn are left out where they are, so that not much more than the sample is ranked.
    """
    order = F.xxhash64("vector", F.lit(seed))
    share = min(1.0, 1.2 * SAMPLE / max(1, entries.count()) + 0.001)
    likely = entries.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = likely.orderBy(F.pmod(order, F.lit(1 << 20)), order).limit(SAMPLE).select("vector").toArrow()
    vectors = _matrix(drawn.column("vector"))
    unit = vectors / np.abs(vectors).max(axis=1)[:, None]
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    cut = max(1, unit.shape[1] // 2)
    rng = np.random.default_rng(seed)
    return MultiIndex(_fit(unit[:, :cut], centroids, rng), _fit(unit[:, cut:], centroids, rng))


@dataclass(frozen=True)
class Shards:
    """Which shards hold which cells: shard s the lists of the cells from first[s] to before end[s]."""

    first: list[int]
    end: list[int]
    of_cell: list[tuple[int, int]]  # the first shard of each cell and their number

    @staticmethod
    def of(sizes: Sequence[int], entries: int) -> Shards:
        first, end, of_cell, held = [], [], [], entries + 1  # no shard that takes more
        for cell, size in enumerate(sizes):
            parts = max(1, -(-size // entries))
            if parts > 1 or held + size > entries:
                of_cell.append((len(first), parts))
                first += [cell] * parts
                end += [cell + 1] * parts
                held = entries + 1 if parts > 1 else size
            else:
                of_cell.append((len(first) - 1, 1))
                end[-1] = cell + 1
                held += size
        return Shards(first, end, of_cell)

    def marks(self, visited: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Every shard with a visited cell, and which of its cells are."""
        for shard, (first, end) in enumerate(zip(self.first, self.end)):
            if visited[first:end].any():
                yield shard, np.packbits(visited[first:end]).tobytes()


class Lists:
    """The inverted lists of one shard, sorted by cell."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], cells: np.ndarray, first: int):
        order = np.argsort(cells, kind="stable")
        self.vectors, self.ids = vectors[order], [ids[i] for i in order.tolist()]
        self.norms = _norms(self.vectors)
        self.units = self.vectors / self.norms[:, None]
        cells = cells[order] - first
        self.starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        self.ends = np.append(self.starts[1:], len(cells))
        self.cells = cells[self.starts]
        self.scored = 0  # pairs of a query and an entry

    def scores(self, units: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Cosines (query, entry) of the entries in the cells that each query visits, minus infinity for all others."""
        scores = np.full((len(units), len(self.units)), -np.inf)
        for cell, start, end in zip(self.cells.tolist(), self.starts.tolist(), self.ends.tolist()):
            who = np.flatnonzero(marks[:, cell])
            if len(who):
                scores[who, start:end] = units[who] @ self.units[start:end].T
                self.scored += len(who) * (end - start)
        return scores

    def best(self, own: int, query: np.ndarray, norm: float, scores: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The ``k`` nearest of the scored entries, their cosines taken anew from the original vectors."""
        limit = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -np.inf
        near = np.flatnonzero((scores >= limit - 1e-12) & (scores > -np.inf))
        exact = [(_cosine(query, norm, self.vectors[i], self.norms[i]), i) for i in near.tolist()]
        ranked = sorted((-score, vec_id) for score, i in exact for vec_id in self.ids[i] if vec_id != own)
        return [(own, vec_id, -score) for score, vec_id in ranked[:k]]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    share: float = SHARE,
    centroids: int = CENTROIDS,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row for which ``is_query`` holds.

    The score is the cosine in double precision; ties go to the smaller id. Rows without an id, or with a vector that is null,
    zero, not finite in some component, or of another length than most, take no part. A row's own id is no candidate; an id
    that occurs with several vectors is searched for by each and found by its best. With fewer than k other rows all are
    returned. An empty table, or one without queries, gives no row. Other columns do not matter.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), is_query.alias("query")
    ).where(F.col("id").isNotNull() & is_usable(F.col("vector")))
    rows = kept(rows, "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("vector") == lengths["n"])

    # The smallest k + 1 ids of a vector: one of them may be the query's own.
    distinct = rows.select("id", "vector").distinct()
    order = Window.partitionBy("vector").orderBy("id")
    few = distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    entries = kept(entries, "entries")
    model = vectors.sparkSession.sparkContext.broadcast(fit(entries, centroids, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = model.value.cell_of(_matrix(batch.column(0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["vector", "ids", "cell"])

    placed = kept(entries.mapInArrow(place, "vector array<double>, ids array<bigint>, cell int"), "placed-entries")
    sizes = np.zeros(model.value.cells, dtype=np.int64)
    for row in placed.groupBy("cell").count().collect():  # one row per cell
        sizes[row["cell"]] = row["count"]
    total = int(sizes.sum())
    wanted = max(int(np.ceil(share * total)), k + 1)

    shards = Shards.of(sizes.tolist(), ENTRIES_PER_SHARD)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, _QUERIES_AT_ONCE):
                part = batch.slice(at, _QUERIES_AT_ONCE)
                a, b = index.halves(_matrix(part.column(1)))
                found = [(i, *mark) for i in range(len(a)) for mark in shards.marks(index.visited(a[i], b[i], sizes, wanted))]
                rows, shard, marks = zip(*found)
                own = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shard, pa.int32()), pa.array(marks, pa.binary())], names)

    names = ["query_id", "vector", "shard", "cells"]
    asked = rows.where("query").select(F.col("id").alias("query_id"), "vector").distinct()
    asked = asked.mapInArrow(plan, "query_id bigint, vector array<double>, shard int, cells binary")
    places = [(cell, *place) for cell, place in enumerate(shards.of_cell)]
    places = vectors.sparkSession.createDataFrame(places, "cell int, first int, parts int")  # one row per cell
    shard = F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")
    nothing = {"query_id": "bigint", "ids": "array<bigint>", "cell": "int", "cells": "binary"}

    def side(df: DataFrame, is_query: bool) -> DataFrame:
        missing = [F.lit(None).cast(t).alias(c) for c, t in nothing.items() if c not in df.columns]
        return df.select("*", *missing).select("shard", F.lit(is_query).alias("is_query"), "query_id", "vector", "ids", "cell", "cells")

    held = side(placed.join(places, "cell").select(shard.alias("shard"), "vector", "ids", "cell"), False)
    met = held.unionByName(side(asked, True)).repartitionByRange(len(shards.first), "shard").sortWithinPartitions("shard", "is_query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, lists = None, [], None
        for batch in batches:
            own, asks = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if end == start:
                    continue
                if own[start] != shard:
                    shard, waiting, lists = int(own[start]), [], None
                part = batch.slice(start, end - start)
                if not asks[start]:
                    waiting.append(part)
                    continue
                if lists is None and waiting:
                    table = pa.Table.from_batches(waiting)
                    cells = table.column("cell").to_numpy()
                    lists = Lists(_matrix(table.column("vector")), table.column("ids").to_pylist(), cells, shards.first[shard])
                    waiting = []
                if lists is not None:
                    yield from answers(lists, part)

    def answers(lists: Lists, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, _QUERIES_AT_ONCE):
            part = queries.slice(at, _QUERIES_AT_ONCE)
            query = _matrix(part.column("vector"))
            norms = _norms(query)
            marks = np.stack([np.unpackbits(np.frombuffer(c, np.uint8)) for c in part.column("cells").to_pylist()]) > 0
            scores = lists.scores(query / norms[:, None], marks)
            found = []
            for row, own in enumerate(part.column("query_id").to_pylist()):
                found += lists.best(own, query[row], norms[row], scores[row], k)
            a, b, c = zip(*found) if found else ((), (), ())
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    near = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths; those whose squares leave the range of doubles by way of the largest component."""
    with np.errstate(over="ignore", under="ignore"):
        plain = np.sqrt((vectors**2).sum(axis=1))
    scale = np.abs(vectors).max(axis=1)
    odd = (scale > 1e150) | (scale < 1e-150)
    return np.where(odd, scale * np.linalg.norm(vectors / scale[:, None], axis=1), plain)


def _cosine(a: np.ndarray, a_norm: float, b: np.ndarray, b_norm: float) -> float:
    both = a_norm * b_norm
    if 1e-280 < both < 1e280:
        return float((a * b).sum() / both)
    return float(((a / a_norm) * (b / b_norm)).sum())
