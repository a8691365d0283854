"""Harmonic packing of documents into token sequences of one capacity.

A document is cut into whole sequences and a rest. The rest is cut into pieces of reciprocal classes: class k holds
pieces of at most ``capacity // k`` tokens, and a sequence of class k takes exactly k of them. Every task fills the
sequences of its classes on its own. What stays open, at most k - 1 pieces per class and task, is brought together in
groups of a fixed number of tasks, level by level; the last group lays its rest end to end and cuts the final sequence
into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept

CAPACITY = 1024
END_ID = 0
# Unused tokens that a class may leave: of each piece (its share) and of the whole sequence (times the number).
_SLACK = 64
_LAST_CLASS = 64
_TASKS_PER_GROUP = 32
# Texts and words of these characters only are merged by tiktoken's core, all others by the library.
_PLAIN = re.compile("[\n !-~À-ɏ]*")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# No token reaches over a blank with no white space before it.
_BORDER = re.compile(r"(?<=\S)(?= )")


@lru_cache
def classes(capacity: int) -> list[int]:
    """Piece sizes of the classes, largest first. Those that would leave too much of a sequence empty are left out."""
    useful = {capacity // k for k in range(1, _LAST_CLASS + 1) if capacity - k * (capacity // k) <= capacity // 128}
    return sorted(useful | set(range(1, max(2, capacity // _LAST_CLASS))), reverse=True)


def cut_rest(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(piece length, pieces per sequence) of a rest below the capacity.

    A rest that nearly fills the next larger class is one piece; else the largest class below it is cut off.
    """
    sizes, pieces = classes(capacity), []
    while length:
        above = min((s for s in sizes if s >= length), default=capacity)
        size = above if above - length <= above // _SLACK else max(s for s in sizes if s <= length)
        piece = min(size, length)
        pieces.append((piece, capacity // size))
        length -= piece
    return pieces


@lru_cache(maxsize=1)
def encoder(path: str):
    """Function from a text to its ids as little-endian 32-bit numbers, for a byte-level BPE file of ``tokenizers``.

    The ids are those of the library. It takes some 14 microseconds a word, so plain texts, and the plain words beside others, are
    merged by tiktoken's core with the vocabulary of the same file, at a fifth of that.
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {item["content"] for item in model["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special
    }
    core = tiktoken.Encoding("pieces", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> bytes:
        return core.encode_to_numpy(text).astype("<u4").tobytes() if text else b""

    def other(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return other(text)
        if _PLAIN.fullmatch(text):
            return plain(text)
        runs = groupby(_BORDER.split(text), lambda word: _PLAIN.fullmatch(word) is not None)
        return b"".join((plain if kind else other)("".join(words)) for kind, words in runs)

    return encode


_COLUMNS = ("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "task", "per_sequence")


class _Rows:
    """Rows gathered into batches of some megabytes."""

    def __init__(self, schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.held += len(row[4]) + 100

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_COLUMNS)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


class _Open:
    """Open sequences of the classes of one task or group, and the numbers of the sequences it fills."""

    def __init__(self, rows: _Rows, level: int, place: int):
        self.rows, self.place = rows, place
        self.next_id = (level << 58) | (place << 32)
        self.waiting = defaultdict(list)

    def fill(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, doc_tokens, ids in pieces:
            self.rows.add(doc_id, start, length, doc_tokens, ids, self.next_id, offset, self.place, None)
            offset += length
        self.next_id += 1

    def put(self, per_sequence: int, piece: tuple) -> None:
        waiting = self.waiting[per_sequence]
        waiting.append(piece)
        if len(waiting) == per_sequence:
            self.fill(self.waiting.pop(per_sequence))

    def leave(self) -> None:
        for per_sequence, pieces in self.waiting.items():
            for piece in pieces:
                self.rows.add(*piece, None, None, self.place, per_sequence)

    def finish(self, capacity: int) -> None:
        """All that waits, end to end; the last sequence in powers of two."""
        pieces = [p for k in sorted(self.waiting) for p in self.waiting[k]]
        total, at = sum(p[2] for p in pieces), 0
        rooms = [capacity] * (total // capacity)
        rest = total % capacity
        rooms += [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
        for room in rooms:
            inside, free = [], room
            while free:
                doc_id, start, length, doc_tokens, ids = pieces[at]
                taken = min(free, length)
                inside.append((doc_id, start, taken, doc_tokens, ids[: 4 * taken]))
                free -= taken
                if taken == length:
                    at += 1
                else:
                    pieces[at] = (doc_id, start + taken, length - taken, doc_tokens, ids[4 * taken :])
            self.fill(inside)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    tasks_per_group: int = _TASKS_PER_GROUP,
) -> DataFrame:
    """Pieces of documents and their place: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian 32-bit numbers, the end id closing each document. ``tokenizer`` is
    the path of a byte-level BPE file that every machine has. A null or empty text is a document of the end id alone. Null
    ids, repeated rows and very long texts are documents like others; an empty table gives no piece; other columns do
    not matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    own = StructField("doc_id", docs.schema[id_column].dataType)
    rest = _parse_datatype_string(
        "start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint, task bigint, per_sequence int"
    )
    schema = StructType([own, *rest.fields])
    arrow = to_arrow_schema(schema)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    tasks = max(1, source.rdd.getNumPartitions())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(tokenizer), _Rows(arrow)
        end = END_ID.to_bytes(4, "little")
        space = _Open(rows, 0, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    space.fill([(doc_id, start, capacity, total, ids[4 * start : 4 * (start + capacity)])])
                start = whole
                for length, per_sequence in cut_rest(total - whole, capacity):
                    space.put(per_sequence, (doc_id, start, length, total, ids[4 * start : 4 * (start + length)]))
                    start += length
                if rows.held > 4_000_000:
                    yield rows.batch()
        space.leave()
        yield rows.batch()

    def gather(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            rows = _Rows(arrow)
            place = group.column("task")[0].as_py() // tasks_per_group
            space = _Open(rows, level, place)
            columns = [group.column(c).to_pylist() for c in (*_COLUMNS[:5], "per_sequence")]
            for *piece, per_sequence in zip(*columns):
                space.put(per_sequence, tuple(piece))
            if last:
                space.finish(capacity)
            else:
                space.leave()
            return pa.Table.from_batches([rows.batch()])

        return run

    found = [kept(source.mapInArrow(pack, schema), "packed")]
    level = 0
    while True:
        level += 1
        tasks = -(-tasks // tasks_per_group)
        waiting = found[-1].where("sequence_id is null")
        group = F.floor(F.col("task") / tasks_per_group)
        found.append(kept(waiting.groupBy(group).applyInArrow(gather(level, tasks == 1), schema), "packed"))
        if tasks == 1:
            break
    placed = [part.where("sequence_id is not null").drop("task", "per_sequence") for part in found]
    return reduce(DataFrame.unionByName, placed)
