"""Places of pattern matches in texts, with DataFrame functions only.

A span is (start, kind_no, end, match, before, after): code points, end exclusive, ``before`` and ``after`` the text up to
the neighbouring matches, at most ``CONTEXT`` characters of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 48
SPAN = "struct<start:int,kind_no:int,end:int,match:string,before:string,after:string>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def matches_of(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches. ``only_if``, a cheap test that each text with a match passes, saves the search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if only_if is None else F.when(only_if, found).otherwise(F.expr("cast(array() as array<string>)"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, where higher-order functions would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_RUN = 256


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For every element of a list what ``step``, an associative one, makes of those before it, the first being ``start``.

    Elements are taken in runs, and then the runs likewise, as a list is copied whenever something is added to it.
    """
    empty = F.filter(F.array(start), lambda x: F.lit(False))
    nothing = F.struct(start.alias("state"), empty.alias("found"))

    def next_(state: Column, value: Column) -> Column:
        return F.struct(step(state["state"], value).alias("state"), F.array_append(state["found"], state["state"]).alias("found"))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: p["state"])
        before = F.aggregate(totals, nothing, next_, lambda state: state["found"])
        pairs = F.arrays_zip(parts.alias("part"), before.alias("before"))
        return F.flatten(F.transform(pairs, lambda p: F.transform(p["part"]["found"], lambda x: step(p["before"], x))))

    def in_runs(values: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(values), F.lit(_RUN))
        parts = F.transform(firsts, lambda at: F.aggregate(F.slice(values, at, F.lit(_RUN)), nothing, next_))
        return bound(parts, joined)

    return bound(values, lambda v: F.when(F.size(v) > 0, in_runs(v)).otherwise(empty))


def spans_of(text: Column, pattern: str, matches: Column, kind_no: int) -> Column:
    """Spans of ``matches``, which are the pattern's. What lies between them comes from a split at the same matches."""
    gaps = F.split(text, pattern, -1)

    def placed(matches: Column, gaps: Column) -> Column:
        pairs = F.arrays_zip(matches.alias("match"), F.slice(gaps, 1, F.size(matches)).alias("gap"))
        lengths = F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["match"]))
        items = F.arrays_zip(
            matches.alias("match"),
            F.slice(gaps, 1, F.size(matches)).alias("gap"),
            F.slice(gaps, 2, F.size(matches)).alias("next"),
            running(lengths, F.lit(0), lambda sum_, n: sum_ + n).alias("at"),
        )

        def span(item: Column) -> Column:
            start = item["at"] + F.char_length(item["gap"])
            return F.struct(
                start.alias("start"),
                F.lit(kind_no).alias("kind_no"),
                (start + F.char_length(item["match"])).alias("end"),
                item["match"].alias("match"),
                F.right(item["gap"], F.lit(CONTEXT)).alias("before"),
                F.left(item["next"], F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(items, span)

    found = bound(matches, lambda m: bound(gaps, lambda g: placed(m, g)))
    return F.when(F.size(matches) > 0, found).otherwise(no_spans())


def outside(spans: Column, covered: Column) -> Column:
    """Those spans that overlap none of ``covered``, in order.

    One pass over both, in order: a span overlaps if any of those that start before its end reach beyond its start.
    """
    # At the same place a span's end comes first, as whatever starts there does not overlap it.
    ends = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("opens"), F.lit(-1).alias("reach"), s.alias("span")))
    opens = F.transform(
        covered,
        lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("opens"), c["end"].alias("reach"), F.get(spans, F.lit(-1)).alias("span")),
    )

    def passed(events: Column) -> Column:
        reached = running(F.transform(events, lambda e: e["reach"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        pairs = F.arrays_zip(events.alias("event"), reached.alias("reached"))
        free = F.filter(pairs, lambda p: (p["event"]["opens"] == 0) & (p["reached"] <= p["event"]["span"]["start"]))
        return F.sort_array(F.transform(free, lambda p: p["event"]["span"]))

    met = (F.size(spans) > 0) & (F.size(covered) > 0)
    return F.when(met, bound(F.sort_array(F.concat(ends, opens)), passed)).otherwise(spans)


def in_order(*spans: Column) -> Column:
    """One list of them all by start, then kind."""
    return F.sort_array(F.concat(*spans))


def written(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    names = F.lit(list(kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind_no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == kind_no)).cast("bigint")


_PIECE = 64


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span, and each run of overlapping spans, replaced by ``mask``. The spans are in order."""
    # Whatever stands between spans is cut from short pieces, as a cut far inside a text walks all the way there.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.ceil(end / _PIECE).cast("int") - first)
        return F.when(end > start, F.substring(F.array_join(some, ""), start - first * _PIECE + 1, end - start)).otherwise("")

    def joined(pieces: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        reached = running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        pairs = F.arrays_zip(spans.alias("span"), reached.alias("reached"))
        opened = F.filter(pairs, lambda p: p["span"]["start"] >= p["reached"])
        between = F.transform(opened, lambda p: cut(pieces, p["reached"], p["span"]["start"]))
        length = F.lit(_PIECE) * (F.size(pieces) - 1) + F.char_length(F.element_at(pieces, -1))
        return F.array_join(F.concat(between, F.array(cut(pieces, F.array_max(ends), length))), mask)

    return F.when(F.size(spans) > 0, bound(pieces, joined)).otherwise(text)
