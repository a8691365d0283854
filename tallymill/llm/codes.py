"""Vector codes by ball k-means: each vector part is replaced by the number of its codebook's nearest entry.

The members of an entry form a ball. Once entries have moved, every block of vectors takes its share of each ball, with the largest
distance from the entry as radius, and looks again only where another entry can be nearer:

1. Only an entry whose centre lies within twice the radius is a neighbour of the ball.
2. A member nearer to its entry than half the way to the nearest neighbour is in the stable core and keeps its code.
3. The others lie in rings between the half ways to the neighbours, in the order of these; a member of the k-th ring is
   compared with the first k neighbours, and with no other entry.

All numbers are integers, so neither order nor partition of the rows changes a code. Blocks of vectors are dealt out to buckets once;
the codes of a round, four bytes a vector, are dealt out alike, so that blocks and codes meet without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept, shared_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 8192
BLOCKS_PER_BUCKET = 4
# Integers beyond are taken as this, so that every squared distance of a vector fits a long.
LARGEST = 1 << 27
_EXACT = 1 << 53  # up to here floating-point sums of integers are exact


def is_whole(vector: Column) -> Column:
    """Not null or empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & (F.size(vector) > 0), F.lit(False))


def integers(vector: Column) -> Column:
    """The components as integers: floor(1024 * x)."""

    def one(x: Column) -> Column:
        # The product cannot leave the range of doubles, as the component is bounded first.
        bound = F.lit(float(LARGEST) / SCALE)
        return F.floor(F.greatest(F.least(x, bound), -bound) * F.lit(float(SCALE))).cast("int")

    return F.transform(vector.cast("array<double>"), one)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (point, entry) of integer vectors."""
    if not len(points) or not len(entries):
        return np.zeros((len(points), len(entries)), dtype=np.int64)
    largest = int(max(np.abs(points).max(), np.abs(entries).max()))
    if 4 * largest**2 * points.shape[1] < _EXACT:
        x, c = points.astype(np.float64), entries.astype(np.float64)
        found = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
        return found.astype(np.int64)
    return np.stack([((points - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


@dataclass(frozen=True)
class Balls:
    """The entries of one part, and for each the others in the order of their distance."""

    entries: np.ndarray
    order: np.ndarray
    ways: np.ndarray  # squared distances in that order

    @staticmethod
    def of(entries: np.ndarray) -> Balls:
        apart = squares(entries, entries)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]  # without the entry itself
        return Balls(entries, order, np.take_along_axis(apart, order, axis=1))

    def nearest(self, points: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of every point, ties to the lower number, its squared distance, and how many distances that took.

        ``codes`` are those of the last round; without them every point is compared with every entry.
        """
        if codes is None:
            apart = squares(points, self.entries)
            codes = apart.argmin(axis=1)
            return codes, apart[np.arange(len(points)), codes], apart.size
        own = ((points - self.entries[codes]) ** 2).sum(axis=1)
        codes, best, taken = codes.copy(), own.copy(), len(points)
        by_entry = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[by_entry], np.arange(len(self.entries) + 1))
        for entry in np.flatnonzero(np.diff(ends)).tolist():
            members = by_entry[ends[entry] : ends[entry + 1]]
            radius = own[members].max()
            # Half the way to a neighbour against the distance, both squared: a tie may go to a neighbour of lower number.
            near = int(np.searchsorted(self.ways[entry], 4 * radius, "right"))
            if not near:
                continue
            ring = np.searchsorted(self.ways[entry, :near], 4 * own[members], "right")
            outside = np.flatnonzero(ring)
            neighbours = self.order[entry, :near]
            for some in np.array_split(outside[np.argsort(ring[outside], kind="stable")], -(-len(outside) // 64) or 1):
                if not len(some):
                    continue
                last = int(ring[some[-1]])
                apart = squares(points[members[some]], self.entries[neighbours[:last]])
                taken += int(ring[some].sum())
                apart[np.arange(last) >= ring[some][:, None]] = np.iinfo(np.int64).max
                least = apart.min(axis=1)
                first = np.where(apart == least[:, None], neighbours[:last], len(self.entries)).min(axis=1)
                at = members[some]
                nearer = (least < best[at]) | ((least == best[at]) & (first < codes[at]))
                codes[at] = np.where(nearer, first, codes[at])
                best[at] = np.where(nearer, least, best[at])
        return codes, best, taken


def _vectors(block: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(block.as_buffer(), np.int32).reshape(-1, width).astype(np.int64)


def _blocks(rows: DataFrame, width: int, label_type: str) -> DataFrame:
    """block, ids, labels, vectors: the rows in blocks of up to ``BLOCK_ROWS``, the vectors as 32-bit integers."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"block bigint, ids array<bigint>, labels array<{label_type}>, vectors binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def block(size: int) -> pa.RecordBatch:
            nonlocal held, number
            table = pa.Table.from_batches(held)
            first, held = table.slice(0, size).combine_chunks(), table.slice(size).to_batches()
            vectors = first.column("vector").combine_chunks().flatten().to_numpy().astype(np.int32)
            number += 1
            columns = [[number], [first.column("id").to_pylist()], [first.column("label").to_pylist()], [vectors.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield block(BLOCK_ROWS)
        if held:
            yield block(BLOCK_ROWS)

    return rows.mapInArrow(run, schema)


class _Dealt:
    """Tables with a column ``block``, dealt out to the same buckets below the checkpoint folder."""

    def __init__(self, buckets: int):
        self.buckets, self.names = buckets, []

    def keep(self, df: DataFrame, what: str, dealt: bool = False) -> DataFrame:
        spark, name = df.sparkSession, f"tallymill_{what}_{uuid.uuid4().hex}"
        whole = df if dealt else df.repartition(self.buckets, "block")
        path = shared_folder(df, what)
        whole.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).saveAsTable(name)
        self.names.append((spark, name))
        return spark.table(name)

    def forget(self) -> None:
        """Takes the names from the catalog; the files stay."""
        for spark, name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


_ROUND = "block bigint, codes binary, part int, entry int, rows bigint, sums array<bigint>, taken bigint"


def _assigned(known: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """Per block its new codes, and per task the size and vector sum of every entry that has members."""
    cuts = [width * p // PARTS for p in range(PARTS + 1)]
    balls = known.sparkSession.sparkContext.broadcast([Balls.of(book) for book in books])  # 256 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book) for book in books]
        sizes = [np.zeros(len(book), dtype=np.int64) for book in books]
        block = None
        for batch in batches:
            for block, data, before in zip(batch.column("block").to_pylist(), batch.column("vectors"), batch.column("codes")):
                vectors = _vectors(data, width)
                last = np.frombuffer(before.as_buffer(), np.uint8).reshape(PARTS, -1) if before.is_valid else None
                codes, taken = [], 0
                for p in range(PARTS):
                    points = vectors[:, cuts[p] : cuts[p + 1]]
                    own, _, more = balls.value[p].nearest(points, None if last is None else last[p].astype(np.int64))
                    taken += more
                    np.add.at(sums[p], own, points)
                    sizes[p] += np.bincount(own, minlength=len(sizes[p]))
                    codes.append(own.astype(np.uint8).tobytes())
                yield row(block, b"".join(codes), taken)
        if block is not None:
            for p in range(PARTS):
                used = np.flatnonzero(sizes[p])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(used), pa.int64()),
                        pa.nulls(len(used), pa.binary()),
                        pa.array([p] * len(used), pa.int32()),
                        pa.array(used, pa.int32()),
                        pa.array(sizes[p][used], pa.int64()),
                        pa.array(sums[p][used].tolist(), pa.list_(pa.int64())),
                        pa.nulls(len(used), pa.int64()),
                    ],
                    names,
                )

    names = [field.split()[0] for field in _ROUND.split(", ")]

    def row(block: int, codes: bytes, taken: int) -> pa.RecordBatch:
        columns = [pa.array([block]), pa.array([codes], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())]
        columns += [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([taken], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    return known.select("block", "vectors", "codes").mapInArrow(run, _ROUND)


def _moved(round_: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries at the floored means of their members; at most 4 * 256 rows reach the driver."""
    most = max(book.shape[1] for book in books)
    # Sums are decimals, which do not overflow.
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(most)]
    totals = round_.where("entry is not null").groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *sums)
    moved = [book.copy() for book in books]
    for r in totals.collect():
        book = moved[r["part"]]
        book[r["entry"]] = [int(r[f"s{i}"]) // r["rows"] for i in range(book.shape[1])]
    return moved


def _told(known: DataFrame, books: list[np.ndarray], width: int, label_type: str) -> DataFrame:
    """id, label, code, error of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    cuts = [width * p // PARTS for p in range(PARTS + 1)]
    balls = known.sparkSession.sparkContext.broadcast([Balls.of(book) for book in books])
    schema = _parse_datatype_string(f"id bigint, label {label_type}, code string, error bigint")
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels, data, before = (batch.column(c)[at] for c in ("ids", "labels", "vectors", "codes"))
                vectors = _vectors(data, width)
                last = np.frombuffer(before.as_buffer(), np.uint8).reshape(PARTS, -1).astype(np.int64)
                error, codes = np.zeros(len(vectors), dtype=np.int64), []
                for p in range(PARTS):
                    own, apart, _ = balls.value[p].nearest(vectors[:, cuts[p] : cuts[p + 1]], last[p])
                    error += apart
                    codes.append(own.astype(np.uint8))
                text = np.ascontiguousarray(np.stack(codes, axis=1)).tobytes().hex()
                written = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                columns = [pa.array(ids.as_py(), pa.int64()), pa.array(labels.as_py(), types.field("label").type)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(written), pa.array(error)], ["id", "label", "code", "error"])

    return known.select("ids", "labels", "vectors", "codes").mapInArrow(run, schema)


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error of every kept row, and the codebooks of the four parts.

    Dropped are rows whose vector is null, empty, holds a null or non-finite component, or is of another length than most (of
    lengths equally common the smaller counts). Components beyond +-131,072 count as that. Parts of a length that four does not divide differ by one component. The codebooks start
    from the rows of the 256 smallest ids; rows without an id are kept and come last in that order, rows with the same id go by
    their vectors, so the same row can start several entries, of which only the first is ever nearest. With fewer rows there
    are fewer entries. Equal distances go to the lower entry. Labels may be null; those errors are added up together. Other columns do
    not matter. An empty table gives no row and empty codebooks.
    """
    spark = vectors.sparkSession
    label_type = vectors.schema[label_column].dataType.simpleString()
    rows = vectors.where(is_whole(F.col(vector_column))).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).alias("label"), integers(F.col(vector_column)).alias("vector")
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = f"vec_id bigint, label {label_type}, code string, error bigint, label_error bigint"
    if lengths is None:
        return spark.createDataFrame([], schema), [np.zeros((0, 0), dtype=np.int64) for _ in range(PARTS)]
    width, total = lengths["n"], lengths["count"]
    rows = rows.where(F.size("vector") == width)
    firsts = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).toArrow()
    start = firsts.column("vector").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, width)
    books = [start[:, width * p // PARTS : width * (p + 1) // PARTS] for p in range(PARTS)]

    dealt = _Dealt(max(1, -(-total // (BLOCK_ROWS * BLOCKS_PER_BUCKET))))
    try:
        blocks = dealt.keep(_blocks(rows, width, label_type), "blocks")
        known = blocks.withColumn("codes", F.lit(None).cast("binary"))
        for _ in range(ROUNDS):
            round_ = dealt.keep(_assigned(known, books, width), "codes", dealt=True)
            books = _moved(round_, books)
            known = blocks.join(round_.where("codes is not null").select("block", "codes"), "block")
        found = kept(_told(known, books, width, label_type), "codes")
    finally:
        dealt.forget()
    # A decimal sum that leaves the range of longs is null.
    sums = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    with_sums = found.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return with_sums.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error"), books
