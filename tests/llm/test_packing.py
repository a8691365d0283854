from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest

from tallymill.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def check(found, texts):
    """Every document whole, every sequence gapless and at most full. Returns sequence lengths."""
    rows = found.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist()
        assert ids == ids_of(texts[doc_id]) and {r["doc_tokens"] for r in parts} == {len(ids)}
        assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist()
    lengths = []
    for places in by_sequence.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0, *[p[1] for p in places]])[:-1].tolist()
        lengths.append(sum(p[1] for p in places))
    assert max(lengths, default=0) <= packing.CAPACITY
    return lengths


def test_sample_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lengths = check(packing.pack_documents(docs.repartition(40), PATH), texts)
    padded = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in lengths)
    assert padded < 0.02 * sum(lengths)


def test_odd_texts(spark):
    texts = ["", None, " ", "a", "\n", "a  b", " lead", "trail ", "x\n y", "don't  stop 12 34,5", "été naïve × ÷ ǅ", "日本語 テキスト"]
    texts += ["<|endoftext|> a <|endoftext|>", "a\x1cb \x85c", "² Ⅷ ½ _a_ __ 1_2", "a​b ﻿", "😀 x😀y", "word " * 30_000, "ab" * 20_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int")
    check(packing.pack_documents(docs.repartition(5), PATH), dict(enumerate(texts)))


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 50 + [(7, None)] * 3, "doc_id bigint, text string")
    found = packing.pack_documents(docs, PATH).collect()
    assert sum(r["length"] for r in found) == 50 * len(ids_of("one two three")) + 3
    assert packing.pack_documents(docs.where("false"), PATH).collect() == []


def test_several_levels(spark):
    texts = {i: "some words here " * (i * 7 % 90) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check(packing.pack_documents(docs.repartition(9), PATH, tasks_per_group=2), texts)


def test_cuts_add_up():
    for length in range(1, packing.CAPACITY):
        cuts = packing.cut_rest(length)
        assert sum(c for c, _ in cuts) == length
        assert all(1 <= c * k <= packing.CAPACITY for c, k in cuts)


def test_no_copy_of_the_vocabulary_in_the_repository():
    root = Path(packing.__file__).parents[2]
    assert not list(root.rglob("byte_bpe*")) and not list(root.rglob("*.tiktoken"))


def test_ids_of_plain_words_beside_others_are_the_librarys():
    import random

    encode = packing.encoder(PATH)
    rng = random.Random(4)
    pieces = ["the", "naïve", "日本", "a\nb", "\n", "", " ", "\t", "12", "don't", "😀", "x\x1c", "\x85", "ﬁ", "_", "...", "é\n\n", "\u2003", "word"]
    for _ in range(3000):
        text = " ".join(rng.choices(pieces, k=rng.randrange(1, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)[:-1], repr(text)
