"""Secrets in texts: known forms, and strings whose sliding-window entropy is that of random characters.

Only DataFrame functions run. A candidate is a run of 20 or more characters of the base64 alphabet with both a letter and a
digit that no known form covers. Its class is hex, base32, letters of one case with digits, or base64 by its characters. A window
slides over it; per step one character's count goes up and one down, and the sum of c * log2(c) follows from these two counts
alone. A candidate counts if some window reaches its class's entropy and no allow-list entry describes it; so it does if
this holds for a piece of it between separators. The least entropy of a class is two deviations below the mean of random windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, log2, sqrt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.spans import in_order, masked, matches_of, outside, spans_of

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_base32", "entropy_alnum")
BASE_KINDS = KINDS[:3]
ASSIGN, ACCESS, HEX, ENTROPY_HEX, ENTROPY_BASE64, ENTROPY_BASE32, ENTROPY_ALNUM = range(7)
_VALUE = "A-Za-z0-9+/_.=-"
ASSIGN_PATTERN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([{_VALUE}]++)"""
ACCESS_PATTERN = "AKIA[A-Z0-9]++"
# Runs shorter than the least length would be dropped, so they are not matched at all.
HEX_PATTERN = "(?<![0-9a-f])[0-9a-f]{32,}+"
_RUN = "A-Za-z0-9+/_=-"
_LEAST = 20
CANDIDATE_PATTERN = rf"(?<![{_RUN}])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[{_RUN}]{{20,}}+"


@dataclass(frozen=True)
class CharacterClass:
    """Alphabet, window and least entropy in bits of one class of candidates."""

    alphabet: str
    window: int
    bits: float


def least_bits(symbols: int, window: int) -> float:
    """Mean less two deviations of the entropy of ``window`` random characters out of so many symbols."""
    cost = [c * log2(c) if c > 1 else 0.0 for c in range(window + 1)]
    share, rest = 1 / symbols, 1 - 2 / symbols
    one = [comb(window, c) * share**c * (1 - share) ** (window - c) for c in range(window + 1)]
    mean = symbols * sum(p * x for p, x in zip(one, cost))
    square = symbols * sum(p * x * x for p, x in zip(one, cost)) + symbols * (symbols - 1) * sum(
        comb(window, a) * comb(window - a, b) * share ** (a + b) * rest ** (window - a - b) * cost[a] * cost[b]
        for a in range(2, window - 1)
        for b in range(2, window - a + 1)
    )
    return log2(window) - mean / window - 2 * sqrt(square - mean**2) / window


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX_CLASS = CharacterClass("0123456789abcdef", 20, 3.0)
BASE32_CLASS = CharacterClass(f"{_LOWER}234567", 20, least_bits(32, 20))
ALNUM_CLASS = CharacterClass(f"{_LOWER}{_DIGITS}", 20, least_bits(36, 20))
# Keys of 62 symbols, without punctuation, are as likely as those of 64.
BASE64_CLASS = CharacterClass(f"{_LOWER.upper()}{_LOWER}{_DIGITS}+/_=-", 20, least_bits(62, 20))
# A segment of a path: words and numbers, letters and digits mixed in short ones of lower case only.
_PART = "(?>(?:[0-9]*+[A-Za-z]*+[0-9]*+|[a-z0-9]{1,8}+)(?![A-Za-z0-9]))"
_SEGMENT = f"(?=[A-Za-z0-9_=-]{{1,24}}(?:/|$)){_PART}(?:[-_=]{_PART})*+"
# What looks random but is public by its form: UUIDs, paths, hyphened and underscored words, runs of one alphabet, a word with
# a number, integrity digests.
ALLOWED = (
    "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "(?i)sha(1|256|384|512)[-=_].*",
    f"/?{_SEGMENT}(?:/{_SEGMENT}){{2,}}+/?",
    "([A-Za-z]*|[0-9]*)([-_+=/]+([A-Za-z]*|[0-9]*))+",
    "[a-z]+[0-9]{1,4}",
)
# A window that holds one of these is not of random characters.
PLACEHOLDER = "(?i)example|placeholder|changeme|x{6}|0123456789|1234567890|abcdefgh"


def _bits(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, of: CharacterClass, besides: str | None = None) -> Column:
    """Largest entropy in bits of any window of the text; of the whole text if that is shorter. Case counts as it stands.

    Windows that hold a match of ``besides`` do not count.

    Characters outside the alphabet are left out of the counts, as if each were one of its own. The text is turned into symbol numbers
    once; a step reads the number that comes and the one that goes.
    """
    window = of.window
    characters = F.split(text, "")
    numbers = F.transform(characters, lambda c: F.instr(F.lit(of.alphabet), c))
    # The number that goes is that of the window's length earlier, none for the first.
    late = F.concat(F.array_repeat(F.lit(0), window), numbers)
    steps = F.filter(
        F.arrays_zip(characters.alias("character"), numbers.alias("coming"), late.alias("going")), lambda s: s["character"].isNotNull()
    )

    def step(state: Column, item: Column) -> Column:
        coming, going, at = item["coming"], item["going"], state["at"] + 1
        same = coming == going
        before_in = F.coalesce(F.get(state["counts"], coming - 1), F.lit(0))
        before_out = F.coalesce(F.get(state["counts"], going - 1), F.lit(0))
        change = (
            F.when(same, F.lit(0.0))
            .otherwise(
                F.when(coming > 0, _bits(before_in + 1) - _bits(before_in)).otherwise(F.lit(0.0))
                - F.when(going > 0, _bits(before_out) - _bits(before_out - 1)).otherwise(F.lit(0.0))
            )
        )
        counts = F.when(same, state["counts"]).otherwise(
            F.transform(state["counts"], lambda c, k: c + F.when(k == coming - 1, 1).when(k == going - 1, -1).otherwise(0))
        )
        return F.struct(
            counts.alias("counts"),
            (state["total"] + change).alias("total"),
            F.greatest(state["best"], judged(state)).alias("best"),
            at.alias("at"),
            F.right(F.concat(state["seen"], item["character"]), F.lit(window)).alias("seen"),
        )

    def judged(state: Column, whole: bool = False) -> Column:
        """Entropy of the window seen so far if it is full, or the whole text."""
        size = F.least(state["at"], F.lit(window)).cast("double")
        entropy = F.log2(size) - state["total"] / size
        counts_here = (F.lit(whole) & (state["at"] > 0) | (state["at"] >= window)) & (entropy > state["best"])
        if besides is not None:
            counts_here = counts_here & ~state["seen"].rlike(besides)
        return F.when(counts_here, entropy).otherwise(F.lit(0.0))

    start = F.struct(
        F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("best"),
        F.lit(0).alias("at"),
        F.lit("").alias("seen"),
    )
    # A window is judged by the step after it, the last one at the end; a text shorter than a window is judged whole there.
    return F.aggregate(steps, start, step, lambda state: F.greatest(state["best"], judged(state, whole=True)))


def _kind_of(text: Column, allowed: Sequence[str]) -> Column:
    """Kind number of a text that counts, else null."""
    lower = F.lower(text)
    found = (
        F.when(text.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.when(window_entropy(lower, HEX_CLASS, PLACEHOLDER) >= HEX_CLASS.bits, F.lit(ENTROPY_HEX)))
        .when(
            text.rlike("^([0-9a-z]+|[0-9A-Z]+)$"),
            F.transform(
                F.array(window_entropy(lower, ALNUM_CLASS, PLACEHOLDER)),
                lambda bits: F.when(text.rlike("[0189]"), F.when(bits >= ALNUM_CLASS.bits, F.lit(ENTROPY_ALNUM))).otherwise(
                    F.when(bits >= BASE32_CLASS.bits, F.lit(ENTROPY_BASE32))
                ),
            )[0],
        )
        .otherwise(F.when(window_entropy(text, BASE64_CLASS, PLACEHOLDER) >= BASE64_CLASS.bits, F.lit(ENTROPY_BASE64)))
    )
    return F.when(~_is_public(text, allowed), found)


def _is_public(text: Column, allowed: Sequence[str]) -> Column:
    public = F.lit(False)
    for pattern in allowed:
        public = public | text.rlike(f"^({pattern})$")
    return public


def _is_secret(span: Column, allowed: Sequence[str]) -> Column:
    """Kind number of a candidate that counts, itself or by a piece between separators, else null."""
    text = span["match"]
    pieces = F.filter(
        F.split(text, "[-_+/=]+"),
        lambda p: (F.char_length(p) >= _LEAST) & (p != text) & p.rlike("[0-9]") & p.rlike("[A-Za-z]"),
    )
    kinds = F.filter(F.transform(pieces, lambda p: _kind_of(p, allowed)), lambda kind: kind.isNotNull())
    return F.when(~_is_public(text, allowed), F.coalesce(_kind_of(text, allowed), F.get(kinds, F.lit(0))))


def find_secrets(
    docs: DataFrame, text_column: str = "text", keep: Sequence[str] = (), allowed: Sequence[str] = ALLOWED
) -> DataFrame:
    """The columns ``keep`` of every row, and ``secret_text``, ``secret_base`` and ``secret_spans``.

    The two lists hold spans in order, of the known forms and of all kinds. A null text is empty and has no span. Rows are
    independent, so repeated rows and null ids get the same spans as any other; other columns do not matter. A very long text, a very
    long run and a text with very many matches take time in proportion to their length. An empty table gives no row.
    """
    text = F.col("secret_text")
    rows = docs.select(*keep, F.coalesce(F.col(text_column), F.lit("")).alias("secret_text"))
    patterns = {ASSIGN: ASSIGN_PATTERN, ACCESS: ACCESS_PATTERN, HEX: HEX_PATTERN, ENTROPY_HEX: CANDIDATE_PATTERN}
    rows = rows.withColumns(
        {
            f"_match_{kind}": matches_of(text, pattern, text.contains("AKIA") if kind == ACCESS else None)
            for kind, pattern in patterns.items()
        }
    )
    rows = rows.withColumns(
        {f"_span_{kind}": spans_of(text, pattern, F.col(f"_match_{kind}"), kind) for kind, pattern in patterns.items()}
    )
    long_enough = {
        ASSIGN: lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN_PATTERN, 1)) >= 8,
        ACCESS: lambda s: F.char_length(s["match"]) >= 16,
    }
    base = [
        F.filter(F.col(f"_span_{kind}"), long_enough[kind]) if kind in long_enough else F.col(f"_span_{kind}")
        for kind in (ASSIGN, ACCESS, HEX)
    ]
    rows = rows.withColumn("secret_base", in_order(*base))
    others = outside(F.col(f"_span_{ENTROPY_HEX}"), F.col("secret_base"))
    judged = F.transform(others, lambda s: s.withField("kind_no", _is_secret(s, allowed)))
    added = F.filter(judged, lambda s: s["kind_no"].isNotNull())
    rows = rows.withColumn(
        "secret_spans",
        F.when(F.size(f"_span_{ENTROPY_HEX}") > 0, in_order(F.col("secret_base"), added)).otherwise(F.col("secret_base")),
    )
    return rows.select(*keep, "secret_text", "secret_base", "secret_spans")


def mask_secrets(docs: DataFrame, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret in the text replaced; a text without one, null included, stays."""
    # Under numbers, so that no column of the table can clash with those added here.
    numbered = docs.toDF(*[str(i) for i in range(len(docs.columns))])
    at = str(docs.columns.index(text_column))
    found = find_secrets(numbered, at, numbered.columns)
    clean = masked(F.col("secret_text"), F.col("secret_spans"), mask)
    clean = F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(at))
    return found.withColumn(at, clean).select(*numbered.columns).toDF(*docs.columns)
