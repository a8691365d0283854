"""SimHash near duplicates by pivot distance tables.

A text's fingerprint is the majority of the hashes of its three-word shingles, bit by bit. Every distinct fingerprint gets a
row in a table of its Hamming distances to fixed reference fingerprints, of which each bit block counts on its own:

1. Two fingerprints with at most three different bits are equal in some of the blocks, so all distances of these blocks are
   equal too. These distances are the key under which fingerprints meet, so no pair is made that differs in all.
2. Of those that meet, the distances to a reference differ by at most three if they link. Pairs whose largest difference over
   all references is above that are discarded.
3. What survives is verified by the fingerprints themselves.

Within a key only links that join two parts are given, so a group of n fingerprints gives less than n of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallymill.llm.common import kept
from tallymill.llm.components import components
from tallymill.llm.jaccard import by_runs

WORDS = 3
SEED = 42
DIFFERENT = 3  # bits in which two linked fingerprints may differ
REFERENCES = 32
_BITS = 64
_CHUNK = 1 << 16  # shingles whose bits are counted at once
_AT_ONCE = 8  # references compared at once
_SMALL = 32  # rows up to which all pairs of a key are compared at once
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Sizes that shape the work and never the result."""

    tile_rows: int = 4096  # rows of a key from which it is divided into pairs of blocks of half as many
    blocks: int | None = None  # of the fingerprint; by default as the number of fingerprints asks for


def fingerprint(text: str | None) -> int:
    """Bits set in over half the hashes of the text's shingles; zero without a word."""
    import xxhash

    words = (text or "").encode().lower().split()  # ASCII letters and white space only, as bytes know no other
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(WORDS, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    set_bits = np.zeros(_BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(stops), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and node, the fingerprint as a signed number, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "node"])

    schema = StructType([StructField("doc_id", docs.schema[id_column].dataType), StructField("node", LongType())])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


@lru_cache
def references(count: int = REFERENCES) -> np.ndarray:
    """The reference fingerprints: random ones, the same in every task."""
    return np.random.default_rng(12).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def block_masks(blocks: int) -> list[np.uint64]:
    """The bits of each of so many blocks of about equal width."""
    cuts = [_BITS * b // blocks for b in range(blocks + 1)]
    return [np.uint64((1 << high) - (1 << low)) for low, high in zip(cuts, cuts[1:])]


def distances(prints: np.ndarray, masks: list[np.uint64]) -> np.ndarray:
    """Hamming distances (fingerprint, block, reference), each within the bits of the block."""
    apart = prints[:, None] ^ references()
    return np.stack([np.bitwise_count(apart & mask) for mask in masks], axis=1)


def keys_of(table: np.ndarray) -> np.ndarray:
    """Numbers (fingerprint, choice of blocks): a hash of all the distances within the blocks of each choice.

    Fingerprints that link have equal distances in all but three blocks, so they share the key of some choice.
    """
    blocks = table.shape[1]
    odd = np.random.default_rng(13).integers(0, 1 << 63, REFERENCES, dtype=np.uint64) | np.uint64(1)
    own = (table.astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64)
    own ^= own >> np.uint64(31)
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - DIFFERENT)):
        key = np.full(len(table), number + 1, dtype=np.uint64)
        for block in chosen:
            key = (key ^ own[:, block]) * _FACTOR
            key ^= key >> np.uint64(32)
        keys.append(key)
    return np.stack(keys, axis=1)


def blocks_for(count: int) -> int:
    """The number of blocks with the least work: rows under all keys, and pairs that meet if the bits were random."""

    def work(blocks: int) -> float:
        choices = len(list(combinations(range(blocks), DIFFERENT)))
        return choices * (count + count**2 / 2 ** (1 + _BITS * (blocks - DIFFERENT) / blocks) / 100)

    return min(range(DIFFERENT + 1, 2 * DIFFERENT + 4), key=work)


def pivot_table(nodes: DataFrame, blocks: int) -> DataFrame:
    """(key, node, far): every node under each of its keys with its distances to the references."""
    masks = block_masks(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                table = distances(prints, masks)
                keys = keys_of(table)
                choices = keys.shape[1]
                far = [row.tobytes() for row in table.sum(axis=1, dtype=np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.T.ravel().view(np.int64)),
                        pa.array(np.tile(prints.view(np.int64), choices)),
                        pa.array(far * choices, pa.binary()),
                    ],
                    ["key", "node", "far"],
                )

    return nodes.select("node").mapInArrow(run, "key bigint, node bigint, far binary")


class _Forest:
    """Disjoint sets of numbers: which of the pairs given so far join two of them."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def joins(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _survivors(a: np.ndarray, b: np.ndarray, prints: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Positions of the pairs that no reference discards and that differ in three bits at most."""
    left = np.arange(len(a))
    for at in range(0, far.shape[1], _AT_ONCE):
        apart = np.abs(far[a[left], at : at + _AT_ONCE] - far[b[left], at : at + _AT_ONCE])
        left = left[apart.max(axis=1) <= DIFFERENT]
        if not len(left):
            return left
    return left[np.bitwise_count(prints[a[left]] ^ prints[b[left]]) <= DIFFERENT]


def pairs_within(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within runs that start and last so."""
    first = np.repeat(starts, lengths) + _counted(lengths)
    later = np.repeat(starts + lengths, lengths) - first - 1
    a = np.repeat(first, later)
    return a, a + 1 + _counted(later)


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def links_of_run(prints: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that span the parts of one run: whoever is reached looks only among those not reached yet."""
    order = np.argsort(far[:, 0], kind="stable")
    prints, far = prints[order], far[order]
    near = far[:, 0]
    open_ = np.ones(len(prints), dtype=bool)
    for seed in range(len(prints)):
        waiting = [seed] if open_[seed] else []
        open_[seed] = False
        while waiting:
            x = waiting.pop()
            low, high = np.searchsorted(near, [near[x] - DIFFERENT, near[x] + DIFFERENT + 1])
            others = low + np.flatnonzero(open_[low:high])
            found = others[_survivors(np.full(len(others), x), others, prints, far)]
            open_[found] = False
            waiting += found.tolist()
            yield from ((int(prints[x]), int(prints[y])) for y in found)


def links(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``node``, enough to join all that link."""
    blocks = limits.blocks or blocks_for(nodes.count())
    rows = kept(pivot_table(nodes, blocks), "pivot-table")
    rows = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "far")
    hot = kept(rows.groupBy("key").count().where(F.col("count") > limits.tile_rows), "hot-keys")
    if not hot.isEmpty():
        parts = F.coalesce(F.ceil(2 * F.col("count") / limits.tile_rows), F.lit(1)).cast("int")
        rows = rows.join(hot, "key", "left").withColumn("parts", parts)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "far")
    keys = ["key", "i", "j"]
    together = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches, keys):
            columns = [table.column(k).to_numpy() for k in keys]
            prints = table.column("node").to_numpy().view(np.uint64)
            far = np.frombuffer(b"".join(table.column("far").to_pylist()), np.uint8).reshape(len(prints), -1).astype(np.int8)
            new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
            starts = np.flatnonzero(new)
            lengths = np.diff(np.concatenate((starts, [len(prints)])))
            forest, found = _Forest(), []
            few = (lengths > 1) & (lengths <= _SMALL)
            for at in range(0, int(few.sum()), 1024):
                a, b = pairs_within(starts[few][at : at + 1024], lengths[few][at : at + 1024])
                good = _survivors(a, b, prints, far)
                found += zip(prints[a[good]].tolist(), prints[b[good]].tolist())
            for start, length in zip(starts[lengths > _SMALL].tolist(), lengths[lengths > _SMALL].tolist()):
                found += links_of_run(prints[start : start + length], far[start : start + length])
            joined = [pair for pair in found if forest.joins(*pair)]
            if joined:
                ends = [np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*joined)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return together.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row: the smallest id that its links reach, its own included.

    Null texts and texts without a word have the fingerprint zero, which links like any other. A null id counts as larger than
    any other, so such a row gets the smallest id it reaches, else null. Repeated rows are rows of one fingerprint. Very long
    texts count whole; an empty table gives no row; other columns do not matter.
    """
    prints = kept(fingerprinted(docs, id_column, text_column), "fingerprints")
    nodes = kept(prints.groupBy("node").agg(F.min("doc_id").alias("least_id")), "nodes")
    joined = components(links(nodes, limits))
    tops = nodes.join(joined, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    tops = kept(tops, "node-components")
    least = tops.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = tops.join(least, "component").select("node", "component_id")
    written = F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint")
    return prints.join(found, "node").select("doc_id", written, "component_id")
