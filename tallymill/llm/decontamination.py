"""Benchmark decontamination by templates: numbers, units and names become typed slots.

1. Windows of eight template tokens of every item are hashed. Where such a window has too few words between its slots, the same
   tokens count as they stand, and the window is widened until it has enough words. A window weighs the less the more items
   share it: an item is looked for by those that it shares with few others, or else by those that it shares with the fewest, so a
   prompt that stands before all items of a benchmark is no sign of any of them. Where a longer passage holds none of these, it is
   looked for as a whole, however many items share it.
2. Windows of the documents that a bitmap of these hashes lets pass meet the items by a hash join, dealt out by salts, as one
   window may stand in very many documents.
3. A document and an item that share a window are compared with all windows of the item. Those that lie on one diagonal
   (document position minus item position) form an alignment. Its slots must be filled consistently: one value in the item
   stands for one value in the document, so that a question with other numbers or names is found, and a chance meeting of slots is
   not. Where they are not, the windows that equal the item's still count, and so do the stretches that are consistent in
   themselves and longer than two windows.

What a document repeats depends on its text alone, so equal texts are compared once.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tallymill.llm.common import is_marked, kept, marked_places, only_likely, without

WINDOW = 8
LEAST_WORDS = 5
# Tokens of the shortest item that is searched, whole and as it stands.
LEAST_TOKENS = 3
# A window that so many different items share is still a sign of each.
SHARED = 8
# A passage of so many windows' length is a sign of all items that share it.
PASSAGE = 4
SALTS = 16
_WORD, _NUMBER, _UNIT, _CAPITAL, _NAME, _END = range(6)
# Scripts that put no blanks between words (Thai to Khmer, kana, Han): each character is a token.
_UNSPACED = (
    "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaadf"
    "\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\uff66-\uff9f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d]+|[.!?:;\n\"]")
_ANY_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|[{_UNSPACED}]|[^\W\d{_UNSPACED}]+|[.!?:;\n\"]")
_CACHED = 600_000
_FACTOR = 0x9E3779B97F4A7C15
_LONG_CHUNK = 64

# Words that count as numbers, units after a number, and first names.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml"
    " l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years cent"
    " cents dollar dollars euro euros percent degrees kmh mph meter meters metre metres kilometer kilometers".split()
)
FIRST_NAMES = frozenset(
    "alice anna ben bob carlos carol claire david elena emma eva frank hans ines jack jan jane jean john juan julia karl kate"
    " laura lena louis lucas luis marc maria marie mary michael mike olivia paul peter pierre robert sam sarah sofia sophie susan"
    " thomas tim tom william".split()
)


def _class_of(text: str, lower: str) -> int:
    if text[0].isdigit() or lower in NUMBER_WORDS:
        return _NUMBER
    if lower in FIRST_NAMES:
        return _NAME
    if text[0] in '.!?:;\n"':
        return _END
    if lower in UNITS:
        return _UNIT
    return _CAPITAL if text[0].isupper() and len(text) > 1 and text[1:].islower() else _WORD


def _tokens(chunk: str) -> list[tuple[int, str]]:
    """(class, text) of the tokens in a piece of text without blanks; names and units are settled by their neighbours."""
    if chunk.isascii() or max(chunk) < _UNSPACED[0]:
        found = [chunk] if chunk.isalpha() else _TOKEN.findall(chunk)
    else:
        found = _ANY_TOKEN.findall(chunk)
    return [(_class_of(text, lower), lower) for text in found for lower in (text.lower(),)]


class _Places(dict):
    """Number of a piece of text among those tokenised so far; a new one is tokenised on the way."""

    def __init__(self, canonical: Canonical):
        self.canonical = canonical

    def __missing__(self, chunk: str) -> int:
        place = self.canonical.add(chunk)
        if len(chunk) <= _LONG_CHUNK:
            self[chunk] = place
        return place


class Canonical:
    """Template hashes of texts. Pieces between blanks are tokenised once and kept in a bounded table."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places = _Places(self)
        self.starts, self.lengths = array("q"), array("q")
        self.classes, self.hashes = array("b"), array("Q")

    def add(self, chunk: str) -> int:
        place = len(self.starts)
        tokens = _tokens(chunk)
        self.starts.append(len(self.classes))
        self.lengths.append(len(tokens))
        for kind, text in tokens:
            self.classes.append(kind)
            self.hashes.append(xxhash.xxh3_64_intdigest(text))
        return place

    def _view(self, name: str, at: np.ndarray) -> np.ndarray:
        values = getattr(self, name)
        return np.frombuffer(values, dtype=values.typecode)[at] if len(values) else np.empty(0, dtype=values.typecode)

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and hash of each template token, and the hash of its text: words and slots, sentence ends are gone."""
        if len(self.starts) > _CACHED:
            self.clear()
        chunks = text.split(" ")
        place = np.fromiter(map(self.places.__getitem__, chunks), np.int64, len(chunks))
        starts, lengths = self._view("starts", place), self._view("lengths", place)
        total = int(lengths.sum())
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        kind, hashes = self._view("classes", at), self._view("hashes", at)
        before = np.concatenate(([_END], kind[:-1]))[:total]
        kind = np.where((kind == _CAPITAL) & (before != _END), _NAME, kind)
        kind = np.where((kind == _CAPITAL) | ((kind == _UNIT) & (before != _NUMBER)), _WORD, kind)
        kept = kind != _END
        kind, hashes = kind[kept], hashes[kept]
        return kind, np.where(kind == _WORD, hashes, kind.astype(np.uint64)), hashes


def _texts(text: str) -> list[str]:
    """Texts of the template tokens, in lower case."""
    return [lower for chunk in text.split(" ") for kind, lower in _tokens(chunk) if kind != _END]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every window, of pairs, pairs of pairs and so on, and the single steps that are left."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.uint64)
    mixed, have, factor = hashes, 1, _FACTOR
    while 2 * have <= width:
        mixed = mixed[:-have] * np.uint64(factor) + mixed[have:]
        have, factor = 2 * have, factor * factor % 2**64
    for at in range(have, width):
        mixed = mixed[: len(hashes) - at] * np.uint64(_FACTOR) + hashes[at:]
    return mixed ^ (mixed >> np.uint64(29))


def _enough_words(kind: np.ndarray, width: int, least: int = LEAST_WORDS) -> np.ndarray:
    """Whether a window has ``least`` words between its slots."""
    words = np.concatenate(([0], np.cumsum(kind == _WORD)))
    return words[width:] - words[:-width] >= least


def _item_windows(kind: np.ndarray, width: int) -> list[tuple[bool, int, np.ndarray]]:
    """(as it stands, width, positions) of the windows of an item.

    Templates of ``width`` tokens, or of the whole item if that is shorter, where they have enough words; elsewhere the same tokens
    as they stand. The shortest stretches with enough words that are wider, as templates. An item that has not that many words at
    all is one template too, if it has a word and as many tokens.
    """
    size = len(kind)
    own = min(width, size)
    if size < LEAST_TOKENS:
        return []
    enough = _enough_words(kind, own)
    found = [(False, own, np.flatnonzero(enough)), (True, own, np.flatnonzero(~enough))]
    words = np.flatnonzero(kind == _WORD)
    if len(words) >= LEAST_WORDS:
        first = words[: len(words) - LEAST_WORDS + 1]
        spans = words[LEAST_WORDS - 1 :] - first + 1
        found += [(False, wide, first[spans == wide]) for wide in sorted(set(spans[spans > own].tolist()))]
    elif len(words) and size >= LEAST_WORDS:
        found.append((False, size, np.zeros(1, dtype=np.int64)))
    return [window for window in found if len(window[2])]


def stretches(windows: list[tuple[int, int]], slot: Callable[[int], tuple | None]) -> list[tuple[int, int]] | None:
    """Longest runs of neighbouring windows, in order, in which no value stands for two; none if the windows all agree.

    ``slot`` gives the item's and the document's value at a position, or nothing for a word.
    """
    first: dict = {}
    pairs = (slot(at) for at in _positions(windows))
    if all(first.setdefault(pair[0], pair[1]) == pair[1] for pair in pairs if pair):
        return None
    runs: list[tuple[int, int]] = []
    held: dict = defaultdict(Counter)
    conflicts, low, left, high = 0, 0, 0, 0

    def put(start: int, end: int, step: int) -> int:
        """Change of the number of values in conflict by the positions that come (1) or go (-1)."""
        change = 0
        for pair in filter(None, map(slot, range(start, end))):
            theirs = held[pair[0]]
            before = len(theirs)
            theirs[pair[1]] += step
            if not theirs[pair[1]]:
                del theirs[pair[1]]
            change += (len(theirs) > 1) - (before > 1)
        return change

    for at, (start, end) in enumerate(windows):
        if low == at or start > high:
            held.clear()
            conflicts, low, left, high = 0, at, start, start
        if end > high:
            conflicts += put(high, end, 1)
            high = end
        while conflicts and low <= at:
            low += 1
            until = windows[low][0] if low <= at else high
            conflicts += put(left, until, -1)
            left = until
        if low <= at:
            if runs and runs[-1][0] == left:
                runs.pop()
            runs.append((left, high))
    return runs


def _positions(windows: list[tuple[int, int]]) -> Iterator[int]:
    """Positions in windows that are in order, each once."""
    reached = 0
    for start, end in windows:
        yield from range(max(start, reached), end)
        reached = max(reached, end)


class Tokens:
    """The template tokens of one text, and its windows as they are asked for."""

    def __init__(self, text: str):
        self.text = text
        self.kind, *self.hashes = _CANONICAL.template(text)
        self._windows: dict[tuple[bool, int], np.ndarray] = {}
        self._texts: list[str] | None = None

    def windows(self, literal: bool, width: int) -> np.ndarray:
        """Hashes of all windows; those as they stand are kept apart from those of templates."""
        found = self._windows.get((literal, width))
        if found is None:
            found = window_hashes(self.hashes[literal], width)
            found = self._windows[literal, width] = found * np.uint64(_FACTOR) if literal else found
        return found

    @property
    def texts(self) -> list[str]:
        if self._texts is None:
            self._texts = _texts(self.text)
        return self._texts


class Item:
    """One benchmark text: its tokens, and hash and place of its windows by kind and width."""

    def __init__(self, text: str, width: int):
        tokens = Tokens(text)
        self.kind, self.texts, self.long = tokens.kind.tolist(), tokens.texts, 2 * width
        self.windows = []
        for literal, own, where in _item_windows(tokens.kind, width):
            hashes = tokens.windows(literal, own)[where]
            order = np.argsort(hashes, kind="stable")
            self.windows.append((literal, own, hashes[order], where[order]))

    def leak(self, theirs: Tokens) -> tuple[int, str] | None:
        """Tokens of the item that the text repeats, and whether verbatim or reparameterised."""
        aligned: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for literal, width, hashes, where in self.windows:
            windows = theirs.windows(literal, width)
            first = np.searchsorted(hashes, windows, "left")
            last = np.searchsorted(hashes, windows, "right")
            for place in np.flatnonzero(first < last).tolist():
                for position in where[first[place] : last[place]].tolist():
                    aligned[place - position].add((position, position + width))
        best = (0, "")
        for shift, windows in aligned.items():
            covered, same = self._matched(shift, sorted(windows), theirs.texts)
            if covered:
                best = max(best, (covered, "verbatim" if same else "reparameterised"))
        return best if best[0] else None

    def _matched(self, shift: int, windows: list[tuple[int, int]], texts: list[str]) -> tuple[int, bool]:
        """Tokens of the item that count on one diagonal, and whether all of them are the item's own."""
        kind, own = self.kind, self.texts

        def slot(at: int) -> tuple | None:
            return None if kind[at] == _WORD else ((kind[at], own[at]), texts[at + shift])

        changed = [at for at in _positions(windows) if kind[at] != _WORD and texts[at + shift] != own[at]]

        def same(window: tuple[int, int]) -> bool:
            return bisect_left(changed, window[0]) == bisect_left(changed, window[1])

        runs = stretches(windows, slot)
        if runs is None:
            counted = windows
        else:
            counted = sorted([r for r in runs if r[1] - r[0] > self.long] + [w for w in windows if same(w)])
        return sum(1 for _ in _positions(counted)), all(map(same, counted))


def passages(text: str, width: int, signs: np.ndarray) -> list[tuple[bool, int, np.ndarray]]:
    """(as it stands, width, hashes) of the windows of ``PASSAGE`` times the width that hold none of the windows in ``signs``.

    Templates where they have as many words for their length as the short ones, elsewhere the tokens as they stand.
    """
    tokens, long = Tokens(text), PASSAGE * width
    last = len(tokens.kind) - long
    if last < 0:
        return []
    steps = np.zeros((2, last + 2), dtype=np.int64)  # of the number of signs inside, templates first
    for literal, own, where in _item_windows(tokens.kind, width):
        at = where[np.isin(tokens.windows(literal, own)[where], signs)]
        start, end = np.maximum(at + own - long, 0), np.minimum(at, last)
        inside = start <= end
        np.add.at(steps[int(literal)], start[inside], 1)
        np.add.at(steps[int(literal)], end[inside] + 1, -1)
    templates, literals = steps.cumsum(axis=1)[:, :-1]
    enough = _enough_words(tokens.kind, long, PASSAGE * LEAST_WORDS)
    # A text with other values holds the templates of a passage, and one with the same values all its windows.
    free = [(False, enough & (templates == 0)), (True, ~enough & (templates + literals == 0))]
    return [(literal, long, np.unique(tokens.windows(literal, long)[where])) for literal, where in free if where.any()]


def item_windows(texts: DataFrame, width: int, shared: int) -> DataFrame:
    """hash, literal, width, item: the windows by which each of the texts (item, item_text) is looked for.

    Windows that more than ``shared`` items share, and more than the item's rarest, are none on their own. Passages without any other
    are looked for as a whole, with all items that share them.
    """
    names = ["hash", "literal", "width", "item"]
    schema = "hash bigint, literal boolean, width int, item bigint"

    def rows(number: int, literal: bool, own: int, hashes: np.ndarray) -> pa.RecordBatch:
        n = len(hashes)
        columns = [pa.array(hashes.view(np.int64)), pa.array([literal] * n), pa.array([own] * n, pa.int32()), pa.array([number] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for literal, own, hashes, _ in Item(text, width).windows:
                    yield rows(number, literal, own, np.unique(hashes))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text, signs in zip(*(column.to_pylist() for column in batch.columns)):
                for found in passages(text, width, np.array(signs, dtype=np.int64).view(np.uint64)):
                    yield rows(number, *found)

    windows = kept(texts.mapInArrow(short, schema), "item-windows")
    windows = windows.join(windows.groupBy("hash").agg(F.count("*").alias("items")), "hash")
    # Of each kind on its own: what stands there word for word is rarer than any template, but no sign of other values.
    fewest = windows.groupBy("item", "literal").agg(F.min("items").alias("fewest"))
    is_sign = F.col("items") <= F.greatest(F.col("fewest"), F.lit(shared))
    weighed = kept(windows.join(fewest, ["item", "literal"]).select(*names, is_sign.alias("sign")), "weighed-windows")
    signs = weighed.groupBy("item").agg(F.collect_list(F.when(F.col("sign"), F.col("hash"))).alias("signs"), F.every("sign").alias("all"))
    common = texts.join(signs.where(~F.col("all")), "item").select("item", "item_text", "signs")
    chosen = weighed.where("sign").select(*names).unionByName(common.mapInArrow(long, schema))
    return kept(chosen, "chosen-windows")


_PROBES = 4
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 28


def _probe(values: np.ndarray, number: int, bits: int) -> np.ndarray:
    values = values.view(np.uint64)
    low, high = values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)
    return ((low + np.uint64(number) * high) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Marks at four places for every hash, the first its own last bits, 64 bits each up to 32 MB in all, and the number of bits."""
    bits = min(max(1 << (windows.count().bit_length() + 6), _LEAST_BITS), _MOST_BITS)
    low, high = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("hash", 32)
    places = F.array(*[F.pmod(low + F.lit(i) * high, F.lit(bits)) for i in range(_PROBES)])  # sums stay below 2 ** 35
    return marked_places(windows.select(F.explode(places)), bits), bits


def suspects(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """key, check, text, hashes: those of the texts that hold windows of an item, and few others."""
    widths = sorted((r["literal"], r["width"]) for r in windows.select("literal", "width").distinct().collect())
    bitmap, bits = _bitmap(windows)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owners = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for at, text in enumerate(batch.column(2)):
                tokens = Tokens(text.as_py())
                for literal, width in widths:
                    windows = tokens.windows(literal, width)
                    left = windows[is_marked(shared.value, (windows & np.uint64(bits - 1)).astype(np.int64))]
                    if len(left):
                        parts.append(left)
                        owners.append(np.full(len(left), at))
            left, owner = np.concatenate(parts), np.concatenate(owners)
            for number in range(1, _PROBES):
                hit = is_marked(shared.value, _probe(left, number, bits))
                left, owner = left[hit], owner[hit]
            if len(left):
                rows, starts = np.unique(owner, return_index=True)
                found = [np.unique(hashes).view(np.int64) for hashes in np.split(left, starts[1:])]
                own = batch.take(pa.array(rows)).columns
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int64()))], ["key", "check", "text", "hashes"])
        _CANONICAL.clear()  # the worker lives on

    return texts.mapInArrow(run, "key bigint, check bigint, text string, hashes array<bigint>")


def repeated_items(texts: DataFrame, benchmark: DataFrame, width: int, shared: int, salts: int) -> DataFrame:
    """key, check, item, matched, tokens, kind: the items (item, item_text) that each text (key, check, text) repeats."""
    windows = item_windows(benchmark, width, shared)
    found = kept(suspects(texts, windows).dropDuplicates(["key", "check"]), "suspects")
    theirs = found.select("key", "check", F.explode("hashes").alias("hash"), F.pmod("key", F.lit(salts)).alias("salt"))
    ours = windows.select("hash", "item").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    pairs = kept(theirs.join(ours, ["hash", "salt"]).select("key", "check", "item").distinct(), "suspected-pairs")
    both = pairs.join(benchmark, "item").join(found.select("key", "check", "text"), ["key", "check"])
    both = both.select("key", "check", "item", "item_text", "text").sortWithinPartitions("key", "check")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, Item] = {}
        theirs, last = None, None
        for batch in batches:
            rows = []
            for key, check, number, item_text, text in zip(*(c for c in batch.columns)):
                key, check, number = key.as_py(), check.as_py(), number.as_py()
                if (key, check) != last:
                    last, theirs = (key, check), Tokens(text.as_py())
                if number not in items:
                    if len(items) >= 1000:
                        items.clear()
                    items[number] = Item(item_text.as_py(), width)
                leak = items[number].leak(theirs)
                if leak:
                    rows.append((key, check, number, leak[0], len(items[number].texts), leak[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = "key bigint, check bigint, item bigint, matched int, tokens int, kind string"
    schema = to_arrow_schema(_parse_datatype_string(names))
    return kept(both.mapInArrow(run, names), "repeated-items")


def _known(docs: DataFrame, text_column: str) -> DataFrame:
    """The rows under numbers as names, with two numbers, key and check, that tell texts apart."""
    text = F.coalesce(F.col(str(docs.columns.index(text_column))), F.lit(""))
    numbered = docs.toDF(*[str(i) for i in range(len(docs.columns))])
    return numbered.withColumns({"key": F.xxhash64(text), "check": F.xxhash64(F.lit("check"), text), "text": text})


def _leaks(
    known: DataFrame, benchmark: DataFrame, item_column: str, item_text_column: str, width: int, shared: int, salts: int
) -> tuple[DataFrame, DataFrame]:
    """Items that the texts of ``known`` repeat, and item, item_id of the benchmark."""
    rows = benchmark.select(F.col(item_column).alias("item_id"), F.coalesce(item_text_column, F.lit("")).alias("item_text"))
    texts = kept(rows.select("item_text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_text"), "items")
    found = repeated_items(known.select("key", "check", "text"), texts, width, shared, salts)
    return found, rows.join(texts, "item_text").select("item", "item_id")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = WINDOW,
    shared: int = SHARED,
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, item_id, matched, tokens, kind: a row per document and benchmark item that it repeats.

    A text that repeats of an item only what more than ``shared`` items share (:func:`item_windows`) repeats it from a passage of
    ``PASSAGE`` windows' length on. An item with fewer template tokens than a window is searched as a whole; one with fewer than five words too, as it stands, and as a
    template if it has a word and five tokens. An item of one or two tokens is searched nowhere: it stands in texts by chance.
    Null texts are empty and repeat nothing; items with equal text all count; null ids, repeated rows and very long texts are
    rows like others. An empty benchmark gives no leak, an empty table no row.
    """
    known = _known(docs.select(id_column, text_column), text_column).select(F.col("0").alias("doc_id"), "key", "check", "text")
    found, items = _leaks(known, benchmark, item_column, item_text_column, width, shared, salts)
    rows = only_likely(known.drop("text"), "key", found, "key")
    told = rows.join(found, ["key", "check"]).join(items, "item")
    return told.select("doc_id", "item_id", "matched", "tokens", "kind")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = WINDOW,
    shared: int = SHARED,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item, with all their columns; see :func:`find_leaks`."""
    known = _known(docs, text_column)
    found, _ = _leaks(known, benchmark, item_column, item_text_column, width, shared, salts)
    gone = kept(found.select("key", "check").distinct(), "leaked-texts")
    names = [str(i) for i in range(len(docs.columns))]
    return without(known.drop("text"), gone, "key", "check").select(*names).toDF(*docs.columns)


_CANONICAL = Canonical()
