"""k-means on dense vectors: one distributed pass per iteration, k partial rows per task.

The centres travel to the tasks inside the task's function. They are k x d numbers, chosen by the caller and not
by the data, and their size is checked. Vectors never leave their task: each task turns its vectors into at most k
rows (cluster, size, sum of vectors, cost), Spark adds them up, and k rows return to the driver.

All differences are taken after subtracting a common point, the mean of the centres, so that vectors far from the origin
lose nothing; near ties are settled by the squared differences themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallymill.operators.sampling import hash_sample, shuffle_key

MODEL_BYTES = 512 * 1024 * 1024
# Numbers in one distance block, and in one packed block of vectors.
_BLOCK_DISTANCES = 4_000_000
_BLOCK_VALUES = 64_000


def _checked(centers: np.ndarray, model_bytes: int = MODEL_BYTES) -> np.ndarray:
    centers = np.ascontiguousarray(centers, dtype=np.float64)
    if centers.ndim != 2 or centers.nbytes > model_bytes:
        raise ValueError(f"centres must be a matrix of at most {model_bytes} bytes, not {centers.shape}")
    return centers


def _nearest(centers: np.ndarray):
    """Function from a matrix to (cluster, squared distance) per row; the lowest cluster wins a tie.

    The matrix and ``centers`` are relative to the same point. It is built here, inside a function, so that Spark ships it
    by value and executors need numpy only.
    """
    rows_at_once = max(1, _BLOCK_DISTANCES // len(centers))
    half_norms = 0.5 * np.einsum("ij,ij->i", centers, centers)
    longest = np.sqrt(2 * half_norms.max())
    turned = np.ascontiguousarray(centers.T)
    # Of the rounding of a product and of a half norm, each a sum of as many terms as there are numbers in a vector.
    unit = 4 * (centers.shape[1] + 2) * np.finfo(np.float64).eps
    scratch = {}

    def space(name, rows, columns):
        # Reused from block to block: fresh pages cost more here than the arithmetic.
        if name not in scratch or len(scratch[name]) < rows:
            scratch[name] = np.empty((rows, columns))
        return scratch[name][:rows]

    def nearest(x):
        clusters = np.empty(len(x), dtype=np.int64)
        for at in range(0, len(x), rows_at_once):
            part = x[at : at + rows_at_once]
            scores = np.matmul(part, turned, out=space("scores", len(part), len(centers)))
            np.subtract(half_norms, scores, out=scores)
            found = scores.argmin(axis=1)
            least = np.take_along_axis(scores, found[:, None], axis=1)
            lengths = np.sqrt(np.einsum("ij,ij->i", part, part))
            open_ = scores <= least + unit * (longest * (lengths + longest))[:, None]
            for row in np.flatnonzero(np.count_nonzero(open_, axis=1) > 1).tolist():
                near = np.flatnonzero(open_[row])
                found[row] = near[((part[row] - centers[near]) ** 2).sum(axis=1).argmin()]
            clusters[at : at + rows_at_once] = found
        # The distance itself is taken from the difference as well.
        apart = np.take(centers, clusters, axis=0, out=space("apart", len(x), centers.shape[1]), mode="clip")
        np.subtract(x, apart, out=apart)
        return clusters, np.einsum("ij,ij->i", apart, apart)

    return nearest


def _matrix_reader(dims: int):
    """Function from a list<number> column to a float64 matrix."""

    def read(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != len(column) * dims or column.null_count:
            raise ValueError(f"every vector must have {dims} numbers")
        return flat.reshape(len(column), dims).astype("float64")

    return read


def assign(
    vectors: DataFrame,
    centers: np.ndarray,
    id_column: str = "vec_id",
    column: str = "embedding",
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Nearest centre and squared distance of every vector."""
    centers = _checked(centers, model_bytes)
    middle = centers.mean(axis=0)
    nearest, read = _nearest(centers - middle), _matrix_reader(centers.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                clusters, costs = nearest(read(batch.column(1)) - middle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(clusters.astype("int32")), pa.array(costs)],
                    ["id", "cluster", "distance"],
                )

    id_type = vectors.schema[id_column].dataType.simpleString()
    found = vectors.select(id_column, column).mapInArrow(run, f"id {id_type}, cluster int, distance double")
    return found.withColumnRenamed("id", id_column)


def _width(vectors: DataFrame, column: str) -> str:
    """The numbers of the column as they are stored: single precision stays so, everything else is double."""
    return "float32" if isinstance(vectors.schema[column].dataType.elementType, FloatType) else "float64"


def pack_vectors(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Vectors as blocks of a few hundred kilobytes, in the column's own width, cheap to cache and to hand to Python."""
    read, width = _matrix_reader(dims), _width(vectors, column)
    rows_at_once = max(1, _BLOCK_VALUES // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = read(batch.column(0)).astype(width)
            blocks = [x[at : at + rows_at_once].tobytes() for at in range(0, len(x), rows_at_once)]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return vectors.select(column).mapInArrow(run, "block binary")


def partial_sums(packed: DataFrame, centers: np.ndarray, width: str = "float32") -> DataFrame:
    """Size, sum of vectors less the mean of the centres, and cost per task and cluster: at most k rows of each task."""
    middle = centers.mean(axis=0)
    nearest = _nearest(centers - middle)
    k, dims = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, costs, sums = np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros((k, dims))
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), dtype=width).reshape(-1, dims).astype("float64") - middle
                clusters, squared = nearest(x)
                sizes += np.bincount(clusters, minlength=k)
                costs += np.bincount(clusters, weights=squared, minlength=k)
                order = np.argsort(clusters, kind="stable")
                present, starts = np.unique(clusters[order], return_index=True)
                sums[present] += np.add.reduceat(x[order], starts, axis=0)
        held = np.flatnonzero(sizes)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held.astype("int32")),
                    pa.array(sizes[held]),
                    pa.array(list(sums[held]), pa.list_(pa.float64())),
                    pa.array(costs[held]),
                ],
                ["cluster", "size", "total", "cost"],
            )

    return packed.mapInArrow(run, "cluster int, size bigint, total array<double>, cost double")


def cluster_sums(packed: DataFrame, centers: np.ndarray, width: str = "float32") -> DataFrame:
    """Size, sum of vectors less the mean of the centres, and cost of every cluster that is not empty: one row each."""
    return (
        partial_sums(packed, centers, width)
        .groupBy("cluster")
        .agg(
            F.sum("size").alias("size"),
            Summarizer.sum(array_to_vector("total")).alias("total"),
            F.sum("cost").alias("cost"),
        )
        .select("cluster", "size", vector_to_array("total").alias("total"), "cost")
    )


def _moved(centers: np.ndarray, sums: pa.Table) -> np.ndarray:
    """Means of the clusters. An empty cluster keeps its centre."""
    moved = centers.copy()
    if sums.num_rows:
        held, sizes = sums.column("cluster").to_numpy(), sums.column("size").to_numpy()
        totals = sums.column("total").combine_chunks().flatten().to_numpy().reshape(len(held), -1)
        moved[held] = centers.mean(axis=0) + totals / sizes[:, None]
    return moved


def initial_centers(
    vectors: DataFrame,
    k: int,
    seed: int,
    id_column: str = "vec_id",
    column: str = "embedding",
    model_bytes: int = MODEL_BYTES,
) -> np.ndarray:
    """``k`` vectors chosen at random by the seed, in the order of :func:`shuffle_key`."""
    first = vectors.select(F.size(column).alias("dims")).first()
    if first is not None and first["dims"] * k * 8 > model_bytes:
        raise ValueError(f"{k} centres of {first['dims']} numbers take more than {model_bytes} bytes")
    chosen = hash_sample(vectors.select(id_column, column), id_column, k, seed)
    rows = chosen.orderBy(shuffle_key(id_column, seed), id_column).collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters need at least as many vectors, there are {len(rows)}")
    return _checked(np.array([row[column] for row in rows]), model_bytes)


@dataclass(frozen=True)
class KMeansFit:
    """Centres after the last iteration, and the objective that each iteration found before moving them."""

    centers: np.ndarray
    objectives: tuple[float, ...]

    @property
    def iterations(self) -> int:
        return len(self.objectives)

    @property
    def inertia(self) -> float:
        return self.objectives[-1]

    def center_table(self, spark: SparkSession) -> DataFrame:
        """k rows: cluster, center."""
        rows = [(i, center.tolist()) for i, center in enumerate(self.centers)]
        return spark.createDataFrame(rows, "cluster int, center array<double>")

    def objective_table(self, spark: SparkSession) -> DataFrame:
        """One row per iteration: iteration from 1, objective."""
        return spark.createDataFrame(list(enumerate(self.objectives, 1)), "iteration int, objective double")


def _descend(packed: DataFrame, centers: np.ndarray, max_iter: int, width: str) -> KMeansFit:
    objectives: list[float] = []
    for _ in range(max_iter):
        sums = cluster_sums(packed, centers, width).toArrow()  # k rows at most
        objectives.append(float(sums.column("cost").to_numpy().sum()))
        centers = _moved(centers, sums)
    return KMeansFit(centers, tuple(objectives))


def kmeans(
    vectors: DataFrame,
    k: int = 100,
    max_iter: int = 50,
    n_redo: int = 1,
    seed: int = 42,
    centers: np.ndarray | None = None,
    id_column: str = "vec_id",
    column: str = "embedding",
    cache: bool = True,
    model_bytes: int = MODEL_BYTES,
) -> KMeansFit:
    """Lloyd's algorithm for squared Euclidean distance, a fixed number of iterations, best of ``n_redo`` starts.

    All vectors take part in every iteration. With ``cache`` the packed vectors are kept in memory and on local disk between
    iterations, and are read from the source again where an executor is lost. Without it each iteration reads the source.
    Centres above ``model_bytes`` are refused, as they travel to every task.
    """
    if max_iter < 1 or n_redo < 1:
        raise ValueError("max_iter and n_redo must be at least 1")
    starts = [_checked(centers, model_bytes)] if centers is not None else []
    starts += [initial_centers(vectors, k, seed + i, id_column, column, model_bytes) for i in range(len(starts), n_redo)]
    packed = pack_vectors(vectors, np.shape(starts[0])[1], column)
    try:
        if cache:
            packed.persist(StorageLevel.MEMORY_AND_DISK)
        fits = [_descend(packed, start, max_iter, _width(vectors, column)) for start in starts]
    finally:
        if cache:
            packed.unpersist()
    return min(fits, key=lambda fit: fit.inertia)
