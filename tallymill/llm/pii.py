"""Personal data in texts by weak supervision, with DataFrame functions only.

Candidates are all matches of the base forms, valid or not, and of looser forms. Five labelers vote on each: form, checksum,
gazetteer, context and shape. Expectation-maximisation over the counts of vote patterns (at most 3 ** 5 per kind, so it
runs on the driver) estimates how reliable each labeler is and how likely each pattern is personal data. With these
probabilities as labels a naive Bayes classifier over the span's shape, length and neighbouring words is trained, by one
grouped sum. Valid base spans always stay; other candidates become spans where the classifier says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept
from tallymill.llm.spans import in_order, matches_of, outside, spans_of

KINDS = ("email", "ip", "card", "phone", "person")
BASE_KINDS = KINDS[:4]
EMAIL, IP, CARD, PHONE, PERSON = range(5)
LEAST_PROBABILITY = 0.9

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
# A match can only begin where a run of its characters begins, or right after the match before (\G). Saying so keeps the
# search linear in very long runs; the possessive quantifiers give nothing back that could still match.
EMAIL_PATTERN = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"
IP_PATTERN = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_PATTERN = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL_PATTERN = (
    rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[{_LABEL}]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[{_LABEL}]++)++"
)
LOOSE_PHONE_PATTERN = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
PERSON_PATTERN = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?+"

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|biz|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|jp|in|br|mx|pl|se|no|dk|fi|ie|pt"
FIRST_NAMES = (
    "Anna|Ben|Carlos|Claire|David|Elena|Emma|Eva|Hans|Ines|Jack|Jan|Jean|John|Juan|Julia|Karl|Laura|Lena|Louis|Lucas"
    "|Luis|Marc|Maria|Marie|Mary|Michael|Olivia|Paul|Peter|Pierre|Robert|Sarah|Sofia|Sophie|Thomas|Tom|William"
)
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
DIAL_CODES = r"^\+(1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    EMAIL: r"(e-?mail|contact|write|address|courriel|correo)[^a-z]*$",
    IP: r"(\bip|host|server|from|client|address|adresse)[^a-z]*$",
    CARD: r"(card|visa|master|credit|karte|carte|tarjeta)[^a-z]*$",
    PHONE: r"(phone|tel|call|mobile|fax|telefon|numéro|teléfono)[^a-z]*$",
    PERSON: r"(name|dear|from|by|contact|sincerely)[^a-z]*$",
}
AGAINST = r"(version|release|order|invoice|isbn|serial|section|figure|no\.|\bv)[^a-z]*$"
LABELERS = 5
PATTERNS = 3**LABELERS
# Features of a span and the buckets of each.
FEATURES = {"shape": 64, "length": 16, "before": 64, "after": 16}
_OFFSETS = [sum(list(FEATURES.values())[:i]) for i in range(len(FEATURES))]
_BUCKETS = sum(FEATURES.values())


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits end in a valid check digit."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    valid = F.aggregate(places, F.lit(0), add) % 10 == 0
    return F.when(F.char_length(digits).between(12, 19), valid).otherwise(False)


def is_valid(span: Column) -> Column:
    """Whether a match of a base form passes that form's test; a failed match is dropped from the base."""
    text, kind = span["match"], span["kind_no"]
    count = F.char_length(digits_of(text))
    parts = F.split(text, r"\.")
    small = F.forall(parts, lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == EMAIL, F.lit(True))
        .when(kind == IP, small)
        .when(kind == CARD, passes_luhn(digits_of(text)))
        .otherwise(count.between(9, 15))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.coalesce(no, F.lit(False)), 0).otherwise(1)


def _votes(span: Column, form: Column) -> Column:
    """The five votes as one number in base 3: 0 against, 1 abstains, 2 for. ``form`` is the first vote."""
    text, kind, before = span["match"], span["kind_no"], F.lower(span["before"])
    digits = digits_of(text)
    count = F.char_length(digits)
    top = F.regexp_replace(F.substring_index(F.substring_index(text, ".", -1), " ", -1), "[^A-Za-z0-9-]", "")
    no = F.lit(False)
    checksum = (
        F.when(kind == CARD, _vote(passes_luhn(digits), ~passes_luhn(digits)))
        .when(kind == IP, _vote(~text.rlike("(^|[.])(0[0-9]|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])"), text.rlike("^(0|127|255)[.]")))
        .when(kind == EMAIL, _vote(top.rlike("^[A-Za-z]{2,}$"), ~top.rlike("^[A-Za-z]{2,}$")))
        .otherwise(1)
    )
    gazetteer = (
        F.when(kind == EMAIL, _vote(top.rlike(f"(?i)^({TOP_DOMAINS})$"), no))
        .when(kind == CARD, _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)))
        .when(kind == PHONE, _vote(text.rlike(DIAL_CODES), text.rlike("^[+]0")))
        .when(kind == PERSON, _vote(text.rlike(rf"\b({FIRST_NAMES})\b"), no))
        .otherwise(1)
    )
    cue = F.lit(False)
    for at, pattern in CUES.items():
        cue = cue | ((kind == at) & before.rlike(pattern))
    context = _vote(cue, before.rlike(AGAINST))
    shape = (
        F.when(kind == CARD, _vote(count.between(13, 16), count > 16))
        .when(kind == PHONE, _vote(count.between(10, 13), count < 9))
        .when(kind == EMAIL, _vote(F.char_length(text) <= 64, F.char_length(text) > 128))
        .when(kind == IP, _vote(~span["after"].rlike("^[.][0-9]") & ~before.rlike("[0-9.]$"), span["after"].rlike("^[.][0-9]")))
        .otherwise(_vote(text.rlike("[.] [A-Z][a-z]+ [A-Z]"), no))
    )
    number = form
    for vote in (checksum, gazetteer, context, shape):
        number = number * 3 + vote
    return number


def _features(span: Column) -> Column:
    """One bucket per feature, as places in a list of all buckets."""
    shape = F.regexp_replace(F.regexp_replace(span["match"], "[0-9]+", "0"), "[A-Za-z]+", "a")
    word = F.regexp_extract(F.lower(span["before"]), r"(\p{L}+)[^\p{L}]*$", 1)
    follows = F.regexp_replace(F.regexp_replace(F.left(span["after"], F.lit(2)), r"\p{L}", "a"), "[0-9]", "0")
    buckets = [
        F.pmod(F.hash(shape), F.lit(FEATURES["shape"])),
        F.least(F.char_length(span["match"]) / 4, F.lit(FEATURES["length"] - 1)).cast("int"),
        F.pmod(F.hash(word), F.lit(FEATURES["before"])),
        F.pmod(F.hash(follows), F.lit(FEATURES["after"])),
    ]
    return F.array(*[bucket + F.lit(offset) for bucket, offset in zip(buckets, _OFFSETS)])


def candidates(docs: DataFrame, text_column: str, keep: list[str]) -> DataFrame:
    """``keep`` and a list ``candidates`` of (start, kind_no, end, base, votes, features) per row, in order."""
    text = F.col("pii_text")
    patterns = [
        (EMAIL, EMAIL_PATTERN, text.contains("@")),
        (IP, IP_PATTERN, None),
        (CARD, CARD_PATTERN, None),
        (PHONE, PHONE_PATTERN, text.contains("+")),
        (EMAIL, LOOSE_EMAIL_PATTERN, text.contains("(at)") | text.contains("[at]")),
        (PHONE, LOOSE_PHONE_PATTERN, None),
        (PERSON, PERSON_PATTERN, None),
    ]
    rows = docs.select(*keep, F.coalesce(F.col(text_column), F.lit("")).alias("pii_text"))
    rows = rows.withColumns({f"_match_{i}": matches_of(text, p, test) for i, (_, p, test) in enumerate(patterns)})
    rows = rows.withColumns(
        {f"_span_{i}": spans_of(text, p, F.col(f"_match_{i}"), kind) for i, (kind, p, _) in enumerate(patterns)}
    )
    rows = rows.select(
        *keep, in_order(*[F.col(f"_span_{i}") for i in range(4)]).alias("formed"),
        in_order(*[F.col(f"_span_{i}") for i in range(4, 7)]).alias("loose"),
    )
    rows = rows.withColumn("tried", F.transform("formed", lambda s: F.struct(s.alias("span"), is_valid(s).alias("valid"))))

    def tried(valid: bool) -> Column:
        return F.transform(F.filter("tried", lambda t: t["valid"] == valid), lambda t: t["span"])

    rows = rows.withColumn("base", tried(True))
    rows = rows.withColumns(
        {
            "failed": outside(tried(False), F.col("base")),
            "loose": outside(F.col("loose"), F.col("base")),
        }
    )

    def judged(spans: str, base: bool, form: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["kind_no"].alias("kind_no"),
                s["end"].alias("end"),
                F.lit(base).alias("base"),
                _votes(s, F.when(s["kind_no"] == CARD, 2).otherwise(form)).alias("votes"),
                _features(s).alias("features"),
            ),
        )

    return rows.select(
        *keep, F.sort_array(F.concat(judged("base", True, 2), judged("failed", False, 0), judged("loose", False, 1))).alias("candidates")
    )


def estimate(counts: dict[int, int], rounds: int = 50, trust: float = 0.8, weight: float = 4.0) -> list[float]:
    """Probability of each vote pattern to be personal data, by expectation-maximisation over the pattern counts.

    Each labeler has its own chances of the three votes, given that the candidate is or is not personal data. They start,
    and are held with ``weight`` observations, at a labeler that is right with chance ``trust`` when it votes.
    """
    votes = [[p // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)] for p in range(PATTERNS)]
    total = sum(counts.values())
    abstains = [
        (sum(n for p, n in counts.items() if votes[p][j] == 1) + 1.0) / (total + 2.0) for j in range(LABELERS)
    ]
    prior = [
        [[(1 - a) * (1 - right), a, (1 - a) * right] for right in (1 - trust, trust)] for a in abstains
    ]
    chances, share = prior, 0.5

    def posterior(p: int) -> float:
        odds = math.log(share / (1 - share))
        for j in range(LABELERS):
            odds += math.log(chances[j][1][votes[p][j]] / chances[j][0][votes[p][j]])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    for _ in range(rounds):
        held = {p: posterior(p) for p in counts}
        yes = sum(n * held[p] for p, n in counts.items())
        share = (yes + 1.0) / (total + 2.0)
        chances = []
        for j in range(LABELERS):
            sums = [[weight * x for x in prior[j][y]] for y in (0, 1)]
            for p, n in counts.items():
                sums[1][votes[p][j]] += n * held[p]
                sums[0][votes[p][j]] += n * (1 - held[p])
            chances.append([[x / sum(row) for x in row] for row in sums])
    return [posterior(p) for p in range(PATTERNS)]


@dataclass(frozen=True)
class SpanModel:
    """Probabilities per kind and vote pattern, and the classifier's prior and weight per kind and bucket."""

    posteriors: list[float]
    prior: list[float]
    weights: list[float]

    def probability(self, span: Column) -> Column:
        weights, base = F.lit(self.weights), span["kind_no"] * _BUCKETS
        odds = F.aggregate(
            span["features"], F.get(F.lit(self.prior), span["kind_no"]), lambda t, f: t + F.get(weights, base + f)
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def train(found: DataFrame) -> SpanModel:
    """Model of a table with ``candidates``. Only counts per vote pattern and sums per bucket reach the driver."""
    spans = found.select(F.inline("candidates"))
    counts: list[dict[int, int]] = [{} for _ in KINDS]
    for row in spans.groupBy("kind_no", "votes").count().collect():
        counts[row["kind_no"]][row["votes"]] = row["count"]
    posteriors = [p for kind in counts for p in estimate(kind)]
    yes = F.get(F.lit(posteriors), F.col("kind_no") * PATTERNS + F.col("votes"))
    sums = (
        spans.select("kind_no", yes.alias("yes"), F.explode("features").alias("bucket"))
        .groupBy("kind_no", "bucket")
        .agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
        .collect()
    )
    held = {(r["kind_no"], r["bucket"]): (r["yes"], r["no"]) for r in sums}
    prior, weights = [], []
    for kind in range(len(KINDS)):
        totals = [sum(held.get((kind, b), (0, 0))[y] for b in range(_OFFSETS[1])) for y in (0, 1)]
        prior.append(math.log((totals[0] + 1) / (totals[1] + 1)))
        for size, offset in zip(FEATURES.values(), _OFFSETS):
            for bucket in range(offset, offset + size):
                a, b = held.get((kind, bucket), (0.0, 0.0))
                weights.append(math.log((a + 0.5) / (totals[0] + 0.5 * size)) - math.log((b + 0.5) / (totals[1] + 0.5 * size)))
    return SpanModel(posteriors, prior, weights)


def find_pii(
    docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = (), least: float = LEAST_PROBABILITY
) -> DataFrame:
    """``keep`` of every row, and lists ``pii_base`` and ``pii_spans`` of (start, kind_no, end, base, votes, features), in order.

    A null text is empty. Rows are independent but for the model, in which every candidate of the table counts once; repeated
    rows, null ids and very long texts are rows like others, an empty table gives none, other columns do not matter.
    """
    found = kept(candidates(docs, text_column, list(keep)), "pii-candidates")
    model = train(found)
    spans = F.filter("candidates", lambda s: s["base"] | (model.probability(s) >= least))
    return found.select(*keep, F.filter("candidates", lambda s: s["base"]).alias("pii_base"), spans.alias("pii_spans"))
