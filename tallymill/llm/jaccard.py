"""Exact n-gram Jaccard join: size-banded tiles, parity bitmaps as bound, sorted-array intersection.

Two sets with a Jaccard similarity of t share one of their first ``n - ceil(t * n) + 1`` shingles in any common order. The
order here is by how often a shingle's bucket occurs in all documents, then by hash, so shared passages come last. If the other set is
no smaller, the shared one is among the first ``n - ceil(2 * t / (1 + t) * n) + 1``, the inner part.

1. Every text becomes a sorted set of 64-bit hashes; equal sets are one node from here on.
2. Lists of nodes per shingle of the first part. A shingle that could be in very many nodes is salted.
3. Each list's smallest node is compared with the others. That links most copies and costs as many pairs as rows.
4. Lists with the same smallest node, as a group of near copies or a shared passage gives them, are one from here on. Their nodes that
   are not yet connected meet in tiles of one list and one band of sizes; large tiles are divided into pairs of blocks. A bitmap
   of the parities of hashed shingles bounds the overlap from above: if d bits differ, at least d shingles are not shared.
5. Nodes with a partner within the bound get their sets into the tile, where exact intersections decide. The tile keeps
   a forest of what is linked: whoever is reached looks only among those not reached yet, and only the links that reached
   somebody leave the tile, less than it has rows.

Nodes already connected are never compared, so a group of thousands of copies gives few comparisons; what is returned are
the components, which need no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallymill.llm.common import count_table, kept, only_likely
from tallymill.llm.components import components

WORDS = 5
SIMILARITY = 75  # per cent
_CACHED_WORDS = 100_000
_EMIT_ROWS = 100_000


@dataclass(frozen=True)
class Limits:
    """Sizes that shape the work and never the result."""

    bucket_bits: int | None = None  # 2 ** bits buckets count how often shingles occur; by default by the number of rows
    list_rows: int = 65_536  # rows from which a list is salted, and those expected of each salt
    tile_rows: int = 2048  # expected rows of a block of a tile
    tile_shingles: int = 2_000_000  # and expected shingles of them


_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter; none without a word."""
    found = (text or "").encode().lower().split()  # ASCII letters and white space only, as bytes know no other
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORD_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    mixed = np.full(count, width, dtype=np.uint64)
    for at in range(width):
        mixed ^= hashes[at : at + count]
        mixed *= np.uint64(_FACTORS[at % 5])
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x7FB5D329728EA185)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles hashed to each bit; two bits a shingle, up to a power of two, 64 at least."""
    bits = max(64, 2 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """The signature that fewer bits would have given: halves laid over each other."""
    while len(words) > length:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def enough(overlap, sizes):
    """Whether an overlap makes two sets of this total size similar: 100 * overlap >= 75 * (sizes - overlap)."""
    return (100 + SIMILARITY) * overlap >= SIMILARITY * sizes


def first_part(size: int) -> int:
    """So many of the first shingles meet those of any similar set."""
    return size + 1 - (-(-SIMILARITY * size // 100))


def inner_part(size: int) -> int:
    """So many of them meet the first part of any similar set that is as large or larger."""
    return size + 1 - (-(-2 * SIMILARITY * size // (100 + SIMILARITY)))


def _sized(small, large):
    return 100 * small.astype(np.int64) >= SIMILARITY * large.astype(np.int64)


def shingled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (hash of the set, null if empty), shingles, bits (size and signature) of every row."""
    own = StructField("doc_id", docs.schema[id_column].dataType)
    schema = StructType(
        [own, StructField("n_shingles", LongType()), StructField("node", LongType())]
        + [StructField("shingles", BinaryType()), StructField("bits", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(text.as_py()) for text in part.column(1)]
                data = [s.tobytes() for s in sets]
                nodes = [xxhash.xxh3_64_intdigest(d) - (1 << 63) if d else None for d in data]
                bits = [np.uint64(len(s)).tobytes() + signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
                    + [pa.array(data, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "n_shingles", "node", "shingles", "bits"],
                )
        _WORD_HASHES.clear()  # the worker lives on

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bucket_bits_for(rows: int) -> int:
    """Four to eight buckets a row, at least 2 ** 20 and at most 2 ** 24, which is 64 MB of counts."""
    return min(max(rows.bit_length() + 2, 20), 24)


def _bucket_counts(sets: DataFrame, bits: int) -> np.ndarray:
    def slots(batch: pa.RecordBatch) -> np.ndarray:
        parts = [_buckets(np.frombuffer(x.as_buffer(), np.uint64), bits).astype(np.int32) for x in batch.column(0)]
        return np.concatenate(parts or [np.empty(0, np.int32)])

    return count_table(sets.select("shingles"), 1 << bits, slots)


def _postings(sets: DataFrame, counts: np.ndarray, bits: int, limits: Limits) -> DataFrame:
    """(shingle, salt, node, size) for the first part of every set; a negative size outside the inner part."""
    shared = sets.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
    usual = 8 * float(counts.mean()) + limits.list_rows
    list_rows = limits.list_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            hashes, inner, nodes, sizes = [], [], [], []
            held = 0
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                wanted = first_part(len(shingles))
                often = table[_buckets(shingles, bits)]
                order = np.argsort(often, kind="stable")[:wanted]  # the set is sorted, so ties go by hash
                hashes.append(shingles[order])
                inner.append(np.arange(wanted) < inner_part(len(shingles)))
                nodes.append(node)
                sizes.append(len(shingles))
                held += wanted
                if held >= _EMIT_ROWS:
                    yield emit(table, hashes, inner, nodes, sizes)
                    hashes, inner, nodes, sizes, held = [], [], [], [], 0
            if held:
                yield emit(table, hashes, inner, nodes, sizes)

    def emit(table, hashes, inner, nodes, sizes) -> pa.RecordBatch:
        counts = [len(h) for h in hashes]
        hashes = np.concatenate(hashes)
        node = np.repeat(np.array(nodes, dtype=np.int64), counts)
        often = table[_buckets(hashes, bits)].astype(np.float64)
        salts = np.where(often > usual, np.ceil(often / list_rows), 1).astype(np.uint64)
        salt = np.where(salts > 1, (node.view(np.uint64) % salts).astype(np.int32), -1).astype(np.int32)
        # The size is negative where the shingle is of the outer part only.
        size = np.repeat(np.array(sizes, dtype=np.int32), counts)
        size = np.where(np.concatenate(inner), size, -size)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(salt), pa.array(node), pa.array(size)],
            ["shingle", "salt", "node", "size"],
        )

    schema = "shingle bigint, salt int, node bigint, size int"
    return sets.where("node is not null").select("node", "shingles").mapInArrow(run, schema)


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            values = batch.column(key).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
            if held and values[0] != held[-1].column(key)[-1].as_py():
                changed[0] = True
        starts = np.flatnonzero(changed)
        if not len(starts):
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, starts[-1])]
        if sum(b.num_rows for b in whole):
            yield pa.Table.from_batches(whole)
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Rows of the lists that hold a node of similar size, each with the list's smallest node.

    ``near`` tells whether row and smallest node can be similar. Lists with the same smallest node are one, with what any of them
    allows: near copies are in many lists together, and this names most of them once.
    """
    together = postings.repartition("shingle", "salt").sortWithinPartitions("shingle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches, ["shingle"]):
            shingle, salt, node, size = (table.column(c).to_numpy() for c in ("shingle", "salt", "node", "size"))
            order = np.lexsort((node, shingle))
            shingle, salt, node, size = shingle[order], salt[order], node[order], size[order]
            inner, size = size > 0, np.abs(size)
            new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])))
            shingle, salt, node, size, inner = shingle[new], salt[new], node[new], size[new], inner[new]
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            lengths = np.diff(np.concatenate((starts, [len(shingle)])))
            first, first_size = np.repeat(node[starts], lengths), np.repeat(size[starts], lengths)
            # Of two sets the smaller must hold the shingle in its inner part.
            by_first = np.where(size < first_size, inner, np.where(size > first_size, inner[np.repeat(starts, lengths)], True))
            # Whoever is of similar size to anyone in the list is so to its neighbour in the order of sizes.
            by_size = np.lexsort((size, shingle))
            small, large = size[by_size][:-1], size[by_size][1:]
            met = (shingle[by_size][1:] == shingle[by_size][:-1]) & _sized(small, large)
            keep = np.zeros(len(node), dtype=bool)
            keep[by_size[1:][met]] = True
            keep[by_size[:-1][met]] = True
            # Outside its inner part a set can only meet smaller ones, and only they may hold it inside theirs.
            run_of = np.cumsum(np.concatenate(([0], shingle[1:] != shingle[:-1])))
            keep &= np.bincount(run_of, inner & keep, len(starts))[run_of] > 0
            keep |= salt >= 0  # the rest of a salted list is elsewhere
            number = np.where(salt >= 0, shingle, first)  # parts of a salted list have different smallest nodes
            near = keep & by_first & (node != first) & _sized(np.minimum(size, first_size), np.maximum(size, first_size))
            if keep.any():
                columns = [a[keep] for a in (number, node, size, inner, first, near)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["list", "node", "size", "inner", "first", "near"])

    found = together.mapInArrow(run, "list bigint, node bigint, size int, inner boolean, first bigint, near boolean")
    return found.groupBy("list", "node", "first").agg(
        F.max("size").alias("size"), F.bool_or("inner").alias("inner"), F.bool_or("near").alias("near")
    )


def _with_column(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with ``column`` of both nodes as ``left`` and ``right``."""
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end")))
    needed = only_likely(sets.select("node", column), "node", ends, "end").dropDuplicates(["node"])
    left = needed.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = needed.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _tested(pairs: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("left"), batch.column("right"))
            good = [
                bool(test(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))) for x, y in both
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    return enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose bitmaps allow enough overlap. A set's size stands before its bitmap."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        length, total = min(len(x), len(y)) - 1, int(x[0]) + int(y[0])
        differ = int(np.bitwise_count(folded(x[1:], length) ^ folded(y[1:], length)).sum())
        return enough((total - differ) // 2, total)

    return kept(_tested(_with_column(pairs, sets, "bits"), test), "possible-pairs")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar, by exact intersection of the sorted arrays."""
    return _tested(_with_column(pairs, sets, "shingles"), _similar)


def _tile_rows(lists: DataFrame, connected: DataFrame, limits: Limits) -> DataFrame:
    """Rows of the tiles (list, band, i, j) that hold nodes of several components."""
    rows = lists.select("list", "node", "size", "inner").join(
        connected.select("node", F.col("component").alias("_component")), "node", "left"
    )
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / SIMILARITY))).cast("int")
    # A set meets those of its own band, where it is at home, and those of the next, as the smaller one.
    bands = F.when(F.col("inner"), F.array(band, band + 1)).otherwise(F.array(band))
    rows = rows.select(
        "list", "node", "size", "inner", F.coalesce("_component", "node").alias("component"), F.posexplode(bands).alias("guest", "band")
    )
    tiles = rows.groupBy("list", "band").agg(
        F.count("*").alias("rows"),
        F.sum("size").alias("shingles"),
        F.min("guest").alias("no_home"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
        F.bool_or("inner").alias("some_inner"),
    )
    tiles = tiles.where("rows > 1 and no_home = 0 and least <> most and some_inner").select("list", "band", "rows", "shingles")
    rows = rows.join(tiles, ["list", "band"])
    blocks = F.ceil(F.greatest(F.col("rows") / limits.tile_rows, F.col("shingles") / limits.tile_shingles)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "list", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "size", "inner", "component", "guest",
    )


_TILE = ["list", "band", "i", "j"]


class _Tile:
    """Nodes of one tile, and which of them may link by sizes, places and bitmaps."""

    def __init__(self, columns: dict[str, np.ndarray], marks: list[np.ndarray]):
        length = min(len(m) for m in marks)
        self.marks = np.stack([folded(m, length) for m in marks])
        self.size, self.inner, self.home = columns["size"].astype(np.int64), columns["inner"], columns["guest"] == 0
        self.component, self.block = columns["component"], columns["block"]
        self.apart = columns["i"][0] != columns["j"][0]

    def possible(self, at: int, among: np.ndarray) -> np.ndarray:
        """Those of the positions ``among`` whose sets may be similar to that at ``at``."""
        size, here = self.size[among], self.size[at]
        good = (self.component[among] != self.component[at]) & (self.home[among] | self.home[at])
        good &= _sized(np.minimum(size, here), np.maximum(size, here))
        inner, own = self.inner[among], self.inner[at]
        good &= np.where(size < here, inner, np.where(size > here, own, inner | own))
        if self.apart:  # those of one block meet in a tile of their own
            good &= self.block[among] != self.block[at]
        among = among[good]
        if not len(among):
            return among
        differ = np.bitwise_count(self.marks[among] ^ self.marks[at]).sum(axis=1).astype(np.int64)
        total = self.size[among] + here
        return among[enough((total - differ) // 2, total)]


def _tiles(batches: Iterator[pa.RecordBatch], data: str) -> Iterator[tuple[pa.Table, list[tuple[int, int, dict]]]]:
    """Tables of whole tiles, and start, end and columns of each tile but ``data``."""
    for table in by_runs(batches, _TILE):
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c != data}
        cut = np.zeros(table.num_rows, dtype=bool)
        for key in _TILE:
            cut[1:] |= columns[key][1:] != columns[key][:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), table.num_rows]
        yield table, [(a, b, {c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts, starts[1:]) if b - a > 1]


def _with_partner(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the tile rows with a partner in their tile whose bitmap allows enough overlap."""
    names = rows.columns
    marks = only_likely(sets.select("node", "bits"), "node", rows, "node").dropDuplicates(["node"])
    together = rows.join(marks, "node").select(*rows.columns, "bits").repartition(*_TILE).sortWithinPartitions(*_TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tiles in _tiles(batches, "bits"):
            met = np.zeros(table.num_rows, dtype=bool)
            bits = table.column("bits").to_pylist()
            for start, end, columns in tiles:
                tile = _Tile(columns, [np.frombuffer(x, np.uint64)[1:] for x in bits[start:end]])
                for at in range(end - start):
                    found = tile.possible(at, np.arange(at + 1, end - start))
                    if len(found):
                        met[start + at] = True
                        met[start + found] = True
            yield from table.select(names).filter(pa.array(met)).to_batches()

    return together.mapInArrow(run, rows.schema)


def overlaps(own: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """How many of the sorted array's values are in each of the sorted arrays that start and last so in ``shingles``."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
    values = shingles[at]
    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
    return np.add.reduceat(own[place] == values, ends - lengths, dtype=np.int64)


_AT_ONCE = 1_000_000  # shingles intersected with another set at once


def _forest(tile: _Tile, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Positions linked by exact intersections, so many that all that link are joined."""
    lengths = np.array([len(s) for s in sets])
    starts, shingles = np.cumsum(lengths) - lengths, np.concatenate(sets)
    open_ = np.ones(len(sets), dtype=bool)
    step = max(1, _AT_ONCE // int(lengths.max()))
    for seed in range(len(sets)):
        waiting = [seed] if open_[seed] else []
        while waiting:
            at = waiting.pop()
            # With a node all that are connected to it already are reached.
            mates = np.flatnonzero(open_ & (tile.component == tile.component[at]))
            open_[mates] = False
            waiting += mates[mates != at].tolist()
            others = tile.possible(at, np.flatnonzero(open_))
            for some in np.array_split(others, range(step, len(others), step)):
                if not len(some):
                    continue
                shared = overlaps(sets[at], starts[some], lengths[some], shingles)
                near = some[enough(shared, lengths[some] + lengths[at])]
                open_[near] = False
                waiting += near.tolist()
                yield from ((at, other) for other in near.tolist())


def _tile_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within the tiles, a forest of each."""
    needed = only_likely(sets.select("node", "shingles"), "node", rows, "node").dropDuplicates(["node"])
    together = rows.join(needed, "node").select(*rows.columns, "shingles").repartition(*_TILE).sortWithinPartitions(*_TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tiles in _tiles(batches, "shingles"):
            data, found = table.column("shingles"), set()
            for start, end, columns in tiles:
                own = [np.frombuffer(data[at].as_buffer(), np.uint64) for at in range(start, end)]
                nodes = columns["node"].tolist()
                for a, b in _forest(_Tile(columns, [signature(x) for x in own]), own):
                    found.add((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return together.mapInArrow(run, "a bigint, b bigint")


def link_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that its links reach, its own included.

    Rows without a word, null texts included, link with nothing and are their own component, also where ids repeat. A null id
    counts as larger than any other, so such a row gets the smallest id it reaches, else null. Repeated rows are rows of one
    set. Very long texts are sets like others; an empty table gives no row; other columns do not matter.
    """
    sets = kept(shingled(docs, id_column, text_column), "shingle-sets")
    bits = limits.bucket_bits or bucket_bits_for(sets.count())
    lists = kept(_shared_lists(_postings(sets, _bucket_counts(sets, bits), bits, limits)), "shared-lists")
    near = lists.where("near")
    pairs = kept(near.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "first-pairs")
    links = kept(_verified(_possible(pairs, sets), sets), "first-links")
    rows = kept(_tile_rows(lists, components(links), limits), "tile-rows")
    rows = kept(_with_partner(rows, sets), "rows-with-partner")
    joined = components(links.unionByName(_tile_links(rows, sets)))

    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    tops = nodes.join(joined, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    tops = kept(tops, "node-components")
    least = tops.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = tops.join(least, "component").select("node", "component_id")
    rows = sets.select("doc_id", "n_shingles", "node")
    with_words = rows.where("node is not null").join(found, "node").select("doc_id", "n_shingles", "component_id")
    return with_words.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
