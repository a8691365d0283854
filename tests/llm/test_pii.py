import re

import pytest
from pyspark.sql import functions as F

from tallymill.llm import pii
from tallymill.llm.spans import written

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for at, (kind, pattern) in enumerate(FORMS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), at, m.end(), kind))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def found_in(spark, texts):
    schema = "doc_id long, text string, pii_text string, base string, candidates int"
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], schema)
    rows = pii.find_pii(docs, "text", ("doc_id",))
    rows = rows.select("doc_id", written(F.col("pii_base"), pii.KINDS), written(F.col("pii_spans"), pii.KINDS))
    return {r[0]: (r[1], r[2]) for r in rows.collect()}


TEXTS = [
    "",
    None,
    "nothing at all",
    "a.b%c+d@mail-1.example.com, x@y z@w.v.. @a.b q@r.s%t@u.v a@b@c.d",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 192.168.0.1x 9.9.9.9.9",
    "4539 1488 0343 6467 4539148803436467 4539-1488-0343-6468 0000000000000 12 34567890123 4",
    "+1 (509) 555-6973 +1-2 +49.30.1234567 ++33 1 23 45 67 89) +1 234 567 890 123 456 +5()5",
    "é😀 me@example.org 😀 10.0.0.1 é +1 (826) 555-4081",
    "a" * 60_000 + "@" + "b." * 30_000 + "c",
    "1" * 50_000 + " " + "1.1.1.1 " * 300 + "+1" * 20_000 + " " + "1 2 3 4 5 6 " * 500,
    "x@" + "a.b" * 5_000 + " " + ("u@v.w " * 300),
    "write to jane (at) example (dot) com or call (509) 555-6973, Dr. Anna Weber",
    "4111111111111111@a.b 4111111111111111 4111111111111112",
]


def test_base_spans_are_those_of_the_patterns(spark):
    found = found_in(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        assert found[i][0] == base_spans(text or ""), (i, (text or "")[:80])
        assert not found[i][0] or set(found[i][0].split(",")) <= set(found[i][1].split(","))


def test_sample_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = found_in(spark, [r["text"] for r in docs])
    assert [found[i][0] for i in range(len(docs))] == [base_spans(r["text"]) for r in docs]
    clean = [i for i, r in enumerate(docs) if not re.search("[0-9]{3}|@", r["text"])]
    assert clean and all(found[i] == ("", "") for i in clean)


def test_labelers_and_classifier_add_spans(spark):
    people = [f"Please contact Dr. Anna Weber{i % 3} today" for i in range(30)]
    obfuscated = [f"email: user{i} (at) example (dot) com thanks" for i in range(30)]
    versions = [f"release version 4.{i}.300.{900 + i} of it" for i in range(30)]
    found = found_in(spark, people + obfuscated + versions + ["see a.b@c.com and 10.1.2.3"] * 30)
    assert all(found[i][1].startswith("person:15:") for i in range(30))
    assert all(found[i][1].startswith("email:7:") for i in range(30, 60))
    assert all(found[i] == ("", "") for i in range(60, 90))


def test_estimate_finds_the_reliable_labelers():
    def pattern(*votes):
        return sum(v * 3 ** (pii.LABELERS - 1 - j) for j, v in enumerate(votes))

    # The fourth labeler votes at random, the others agree.
    counts = {pattern(2, 2, 2, 0, 2): 50, pattern(2, 2, 2, 2, 2): 50, pattern(0, 0, 0, 2, 0): 40, pattern(0, 0, 0, 0, 0): 40}
    chance = pii.estimate(counts)
    assert chance[pattern(2, 2, 2, 0, 2)] > 0.95 and chance[pattern(0, 0, 0, 2, 0)] < 0.05
    assert abs(chance[pattern(2, 1, 1, 0, 1)] - chance[pattern(2, 1, 1, 2, 1)]) < 0.1
    assert len(pii.estimate({})) == pii.PATTERNS


@pytest.mark.parametrize("rows", [[], [(None, "a@b.c")] * 3 + [(None, None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(docs, "text", ("doc_id",)).select(written(F.col("pii_spans"), pii.KINDS)).collect()
    assert sorted(r[0] for r in found) == sorted("email:0:5" if t else "" for _, t in rows)
