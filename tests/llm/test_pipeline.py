import re

import pytest
from test_jaccard import shingles
from test_secrets import base_spans

import corpus_pipeline
from tallymill.llm.common import kept
from tallymill.llm.near_duplicates import one_of_each

pytest.importorskip("public_tokenizers")


def test_stages_on_sample_documents(spark, small):
    from test_packing import check

    docs, after = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, small)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        after[name], docs = {r["doc_id"]: r for r in made.collect()}, kept(made, name)
    names = list(after)
    assert names == ["quality", "near_duplicates", "decontamination", "secrets"]
    before = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert 0.6 * len(before) < len(after["quality"]) < len(before)

    sets = {i: shingles(r["text"]) for i, r in after["quality"].items()}
    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    stay = after["near_duplicates"]
    assert not any(like(sets[a], sets[b]) for a in stay for b in stay if a < b and sets[a] and sets[b])
    assert all(any(b != a and like(sets[a], sets[b]) for b in sets) for a in set(sets) - set(stay))

    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    leaked = {i for i, r in stay.items() if any(flat(x) in flat(r["text"]) for x in items)}
    assert set(stay) - set(after["decontamination"]) >= leaked
    assert len(after["decontamination"]) >= 0.9 * len(stay)

    for i, row in after["secrets"].items():
        assert base_spans(row["text"]) == [] and row["n_chars"] == len(row["text"])
        if not base_spans(before[i]["text"]):
            assert "[SECRET]" in row["text"] or row["text"] == before[i]["text"]
    assert set(after["secrets"]) == set(after["decontamination"])
    check(corpus_pipeline.STAGES[-1][1](spark, docs, small), {i: r["text"] for i, r in after["secrets"].items()})


def test_odd_documents(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, accepted string"
    text = "some quite usual words that follow each other here"
    rows = [(1, None), (1, None), (2, ""), (None, text), (3, text), (None, "other words that nobody else has in use"), (4, text + " x")]
    rows += [(5, "long words " * 40_000), (3, text), (6, "token=abcdefgh12 and more words for it")]
    docs = spark.createDataFrame([(i, t, None, None, None, 7, "a") for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), small).collect() == []
        assert stage(spark, docs, small).columns == docs.columns
    one = one_of_each(docs).collect()
    assert sorted(repr((r["doc_id"], (r["text"] or "")[:5])) for r in one) == sorted(
        repr(x) for x in [(1, ""), (2, ""), (3, "some "), (None, "other"), (5, "long "), (6, "token")]
    )
    masked = {r["doc_id"]: r for r in corpus_pipeline.STAGES[3][1](spark, docs, small).collect()}
    assert masked[6]["text"] == "[SECRET] and more words for it" and masked[6]["n_chars"] == len(masked[6]["text"])
    assert corpus_pipeline.STAGES[4][1](spark, docs.where("false"), small).collect() == []
