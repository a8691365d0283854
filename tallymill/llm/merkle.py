"""Merkle manifest of a table: places of leaves by ranks in bitmaps, levels by arrays of keyed slots.

1. A leaf is the hash of a row. Leaves of one language form a tree in the order of ids, the trees' roots one tree more.
2. The ids of each language are a bitmap, kept as its words that are not zero: each task joins the bits of its rows, equal words of
   several tasks are joined by an or. Words are gathered in containers of 4,096 ids; a container knows how many rows lie before
   it and each word how many before it in the container. The place of a leaf is the sum of both and of the bits below its own in
   its word, so no row is sorted to find its place. Ids that occur more than once, and rows without one, are counted beside.
3. Leaves of 1,024 neighbouring places meet under one key, each in its slot of an array, and are reduced ten levels to one node.
   The nodes are reduced likewise until each tree has one. Siblings are handed down the same way; those of the lowest levels
   are never stored, but found again from the arrays when the proofs are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import kept, running_totals

FAN_OUT = 2
_WORD_BITS = 6  # ids of a word of a bitmap, as a power of two
_CONTAINER_BITS = 12
_SLOT_BITS = 10
_SLOTS = 1 << _SLOT_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*values: Column) -> Column:
    """SHA-256, as bytes, of the values in order: ``-`` for null, else the length in bytes, a colon and the text."""
    texts = [v.cast("string") for v in values]
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*said), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree (of the language), doc_id, leaf, altered (the leaf after tampering, null where nobody tampers), row (a number)."""
    one_more = (F.col("n_chars").cast("decimal(20,0)") + F.lit(1)).cast("string")
    other = [one_more if name == "n_chars" else F.col(name) for name in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        # As text is compared by its bytes, the null comes first.
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_of(*map(F.col, FIELDS)).alias("leaf"),
        F.when(tampered, leaf_of(*other)).alias("altered"),
        F.monotonically_increasing_id().alias("row"),
    )


def _word(doc_id: Column) -> Column:
    return F.shiftright(doc_id, _WORD_BITS)


def _container(doc_id: Column) -> Column:
    return F.shiftright(doc_id, _CONTAINER_BITS)


def _bit(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")


def _shifted(number: int, places: Column) -> Column:
    return F.call_function("shiftleft", F.lit(number).cast("bigint"), places)


def bitmaps(leaves: DataFrame) -> DataFrame:
    """tree, container, words (word, bits, rows of the container before it), rows: the ids of every tree, merged over all tasks."""
    ids = leaves.where("doc_id is not null").select("tree", "doc_id")
    words = ids.groupBy("tree", _word(F.col("doc_id")).alias("word")).agg(
        F.bit_or(_shifted(1, _bit(F.col("doc_id")))).alias("bits"), F.count("*").alias("rows")
    )
    container = F.shiftright("word", _CONTAINER_BITS - _WORD_BITS).alias("container")
    inside = Window.partitionBy("tree", container).orderBy("word")  # 64 words at most
    words = words.select("tree", container, "word", "bits", "rows", (F.sum("rows").over(inside) - F.col("rows")).alias("before"))
    return words.groupBy("tree", "container").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.struct("bits", "before", "rows")))).alias("words"),
        F.sum("rows").alias("rows"),
    )


def _repeated(leaves: DataFrame, containers: DataFrame) -> DataFrame:
    """tree, doc_id, rows of the ids with several rows, null ids included. Only words with more rows than bits are looked into."""
    full = containers.select("tree", F.explode("words").alias("word", "found"))
    full = full.where("found.rows > bit_count(found.bits)").select("tree", "word")
    many = leaves.select("tree", "doc_id", _word(F.col("doc_id")).alias("word")).join(full, ["tree", "word"], "left_semi")
    none = leaves.where("doc_id is null").groupBy("tree").agg(F.lit(None).cast("bigint").alias("doc_id"), F.count("*").alias("rows"))
    return many.groupBy("tree", "doc_id").agg(F.count("*").alias("rows")).where("rows > 1").unionByName(none)


def _order_of_equals(leaves: DataFrame, repeated: DataFrame) -> DataFrame:
    """row, after: how many leaves of the same tree and id come before, by leaf; equal leaves take the places between them.

    Equal leaves of one input task are counted first, so that a row repeated without end comes as one count per task.
    """
    same = F.col("doc_id").eqNullSafe(F.col("their_id")) & (F.col("tree") == F.col("their_tree"))
    theirs = repeated.select(F.col("tree").alias("their_tree"), F.col("doc_id").alias("their_id"))
    rows = leaves.join(theirs, same, "left_semi").withColumn("task", F.shiftright("row", 33))
    rows = kept(rows.select("tree", "doc_id", "leaf", "task", "row"), "equal-ids")
    key = ["tree", "doc_id", "leaf", "task"]
    before = running_totals(rows.groupBy(*key).agg(F.count("*").alias("rows")), key, "rows")
    first = before.groupBy("tree", "doc_id").agg(F.min("before").alias("first"))
    inside = Window.partitionBy(*key).orderBy("row")  # rows of one input task
    rows = rows.withColumn("inside", F.row_number().over(inside) - F.lit(1))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        right = right.toDF(*[f"_{c}" if c in keys else c for c in right.columns])
        equal = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return left.join(right, equal).drop(*[f"_{k}" for k in keys])

    rows = joined(joined(rows, before.select(*key, "before"), key), first, ["tree", "doc_id"])
    return kept(rows.select("row", (F.col("before") - F.col("first") + F.col("inside")).alias("after")), "order-of-equals")


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """tree, place (0, 1, ... by id), doc_id, leaf, altered. Null ids come first; equal ids go by their leaves."""
    containers = kept(bitmaps(leaves), "bitmaps")
    repeated = kept(_repeated(leaves, containers), "repeated-ids")
    counts = containers.select("tree", "container", "rows").unionByName(
        repeated.where("doc_id is null").select("tree", F.lit(None).cast("bigint").alias("container"), "rows")
    )
    before = running_totals(counts, ["tree", "container"], "rows")
    first = before.groupBy("tree").agg(F.min("before").alias("first"))
    extras = repeated.where("doc_id is not null").groupBy("tree", _container(F.col("doc_id")).alias("container")).agg(
        F.collect_list(F.struct("doc_id", (F.col("rows") - 1).alias("more"))).alias("extras")  # 4,096 ids at most
    )
    directory = (
        containers.select("tree", "container", "words")
        .join(before.join(first, "tree").select("tree", "container", (F.col("before") - F.col("first")).alias("start")), ["tree", "container"])
        .join(extras, ["tree", "container"], "left")
    )
    directory = kept(directory, "directory")
    rows = leaves.withColumn("container", _container(F.col("doc_id"))).join(directory, ["tree", "container"], "left")
    own, word = F.col("doc_id"), F.element_at("words", _word(F.col("doc_id")))
    below = F.bit_count(word["bits"].bitwiseAND(F.bitwise_not(_shifted(-1, _bit(own)))))
    doubles = F.aggregate(
        F.filter("extras", lambda e: (_word(e["doc_id"]) == _word(own)) & (e["doc_id"] < own)), F.lit(0).cast("bigint"), lambda n, e: n + e["more"]
    )
    place = F.coalesce(F.col("start") + word["before"] + below + F.coalesce(doubles, F.lit(0)), F.lit(0))
    rows = rows.select("tree", "doc_id", "leaf", "altered", "row", place.alias("place"))
    if not repeated.isEmpty():
        rows = rows.join(_order_of_equals(leaves, repeated), "row", "left")
        rows = rows.withColumn("place", F.col("place") + F.coalesce("after", F.lit(0)))
    return rows.select("tree", "place", "doc_id", "leaf", "altered")


def _hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def reduced(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """Levels above a full or last array of nodes: ten of them, or if the array is the whole tree until one node remains."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= _SLOT_BITS:
        last = levels[-1]
        levels.append([_hash(last[i : i + FAN_OUT]) for i in range(0, len(last), FAN_OUT)])
    return levels


def path_of(levels: list[list[bytes]], at: int) -> bytes:
    """What stands beside a node on its way up: per level one byte and the sibling. 0: left, 1: right, 2: there is none."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append(b"\2" if other >= len(level) else (b"\1" if other > at else b"\0") + level[other])
        at >>= 1
    return b"".join(steps)


def siblings_in(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        side = path[at]
        yield side, path[at + 1 : at + 33] if side < 2 else b""
        at += 33 if side < 2 else 1


def folded(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in path:
        leaf = _hash([leaf] if side == 2 else [other, leaf] if side == 0 else [leaf, other])
    return leaf


def _arrays(nodes: DataFrame, place: str, *columns: str) -> DataFrame:
    """tree, block, slots, whole (is the block its whole tree): nodes of neighbouring places under one key."""
    slot = F.col(place).bitwiseAND(F.lit(_SLOTS - 1)).cast("int").alias("slot")
    block = F.shiftright(place, _SLOT_BITS).alias("block")
    blocks = nodes.groupBy("tree", block).agg(F.collect_list(F.struct(slot, *columns)).alias("slots"))  # 1,024 at most
    blocks = kept(blocks, "blocks")
    whole = blocks.groupBy("tree").agg((F.max("block") == 0).alias("whole"))
    return blocks.join(whole, "tree")


def _in_slots(slots: list[dict], column: str) -> list:
    found = [None] * len(slots)
    for item in slots:
        found[item["slot"]] = item[column]
    return found


def _next_nodes(blocks: DataFrame, column: str) -> DataFrame:
    """tree, place, node: what the arrays are reduced to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [
                reduced(_in_slots(s.as_py(), column), w.as_py())[-1][0]
                for s, w in zip(batch.column("slots"), batch.column("whole"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(tops, pa.binary())], ["tree", "place", "node"])

    only = blocks.withColumn("slots", F.transform("slots", lambda s: F.struct(s["slot"], s[column].alias(column))))
    return only.mapInArrow(run, "tree string, place bigint, node binary")


def paths(nodes: DataFrame) -> DataFrame:
    """tree, place, node, root, path of every node (tree, place, node); its path leads to the root of its tree."""
    blocks = _arrays(nodes, "place", "node")
    above = kept(_next_nodes(blocks, "node"), "nodes")
    if above.where("place > 0").isEmpty():
        above = above.select("tree", "place", F.col("node").alias("root"), F.lit(b"").alias("above"))
    else:
        above = paths(above).select("tree", "place", "root", F.col("path").alias("above"))
    known = blocks.join(above.withColumnRenamed("place", "block"), ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["tree", "block", "slots", "whole", "root", "above"]).to_pylist():
                own = _in_slots(row["slots"], "node")
                levels = reduced(own, row["whole"])
                n, first = len(own), row["block"] << _SLOT_BITS
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.string()),
                        pa.array(range(first, first + n), pa.int64()),
                        pa.array(own, pa.binary()),
                        pa.array([row["root"]] * n, pa.binary()),
                        pa.array([path_of(levels, at) + row["above"] for at in range(n)], pa.binary()),
                    ],
                    ["tree", "place", "node", "root", "path"],
                )

    return kept(known.mapInArrow(run, "tree string, place bigint, node binary, root binary, path binary"), "paths")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    ``docs`` has the columns doc_id, source, lang, n_chars and text, others do not matter. Nulls count as such in the leaf, a null
    language is a tree of its own before the others, and an empty text differs from none. Rows without an id come first in their
    tree; rows with the same id go by their leaves, and repeated rows take neighbouring places. A long text is hashed whole. The
    largest n_chars is tampered with like any other. A table of one row has its leaf as root; an empty one gives no row.
    """
    leaves = kept(leaves_of(docs), "leaves")
    arrays = _arrays(placed_leaves(leaves), "place", "doc_id", "leaf", "altered")
    upper = paths(kept(_next_nodes(arrays, "leaf"), "nodes")).select("tree", F.col("place").alias("block"), "root", "path")
    trees = upper.where("block = 0").select("tree", F.col("root").alias("node"), F.lit(1).alias("one"))
    trees = running_totals(trees, ["tree"], "one").select("tree", F.col("before").alias("place"), "node")
    tops = paths(trees.withColumns({"name": F.col("tree"), "tree": F.lit("")}).select("tree", "place", "node"))
    tops = trees.join(tops.select("place", F.col("root").alias("top"), F.col("path").alias("last")), "place").select("tree", "top", "last")
    known = arrays.join(upper, ["tree", "block"]).join(tops, "tree")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["slots", "whole", "root", "path", "top", "last"]).to_pylist():
                own, altered = _in_slots(row["slots"], "leaf"), _in_slots(row["slots"], "altered")
                levels, above = reduced(own, row["whole"]), list(siblings_in(row["path"] + row["last"]))
                proofs, results = [], []
                for at, leaf in enumerate(own):
                    way = [*siblings_in(path_of(levels, at)), *above]
                    proofs.append(hashlib.sha256("".join(s.hex() for _, s in way).encode()).hexdigest())
                    results.append(folded(leaf if altered[at] is None else altered[at], way).hex())
                n = len(own)
                columns = [[leaf.hex() for leaf in own], [row["root"].hex()] * n, [row["top"].hex()] * n, proofs, results]
                ids = pa.array(_in_slots(row["slots"], "doc_id"), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.string()) for c in columns]], names)

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return known.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
