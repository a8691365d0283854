import re

import numpy as np
import pytest

from tallymill.llm import decontamination as d

ITEMS = [
    (1, "Alice buys 3 apples for 2 dollars each and sells every one of the 3 apples at the market"),
    (2, "The quick brown fox jumps over the lazy dog while seven other animals watch from afar"),
    (3, "short item of few words"),
    (4, "too short"),
    (5, None),
    (6, ""),
    (7, "A train leaves Paris at 90 kmh and needs 4 hours to reach the city of Lyon on time"),
]


def leaks(spark, texts, items=ITEMS, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, leaks string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    kept = d.decontaminate(docs, benchmark, **options)
    assert kept.columns == docs.columns
    pairs = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in found.collect())
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {p[0] for p in pairs}
    return pairs


def test_verbatim_reparameterised_and_clean(spark):
    texts = [
        "So it goes. " + ITEMS[0][1] + " was asked",
        "Bob buys 5 apples for 9 euros each and sells every one of the 5 apples at the market",
        "Bob buys 5 apples for 9 euros each and sells every one of the 6 apples at the market",
        "nothing in common with any of them, but 3 apples and 2 dollars at the market",
        "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE\nnine other animals",
        "here is a short item of few words indeed",
        "too short",
        "A train leaves Berlin at 120 kmh and needs 6.5 hours to reach the city of Hamburg on time",
        None,
        "",
        "word " * 50_000 + ITEMS[1][1] + " word" * 50_000,
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",
    ]
    assert leaks(spark, texts) == [
        (0, 1, "verbatim"),
        (1, 1, "reparameterised"),
        (4, 2, "reparameterised"),
        (5, 3, "verbatim"),
        (7, 7, "reparameterised"),
        (10, 2, "verbatim"),
    ]
    assert leaks(spark, texts, salts=3) == leaks(spark, texts)


def test_odd_tables(spark):
    assert leaks(spark, []) == [] and leaks(spark, ["a b c d e f g h i"], []) == []
    same = [(None, ITEMS[1][1]), (9, ITEMS[1][1]), (9, ITEMS[1][1])]
    docs = spark.createDataFrame([(None, ITEMS[1][1])] * 2, "doc_id long, text string")
    found = d.find_leaks(docs, spark.createDataFrame(same, "item_id long, text string")).collect()
    assert sorted(repr((r["doc_id"], r["item_id"])) for r in found) == ["(None, 9)"] * 4 + ["(None, None)"] * 2


def brute(text, item, width):
    """Whether some window of the item's words stands in the text, both without digits and capitals."""
    import re

    words, theirs = (re.findall(r"[^\W\d]+|\d+", t.lower()) for t in (text, item))
    windows = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
    return any(tuple(words[i : i + width]) in windows for i in range(len(words) - width + 1))


def test_sample_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, benchmark).collect()}
    items = benchmark.collect()
    wanted = {(r["doc_id"], b["item_id"]) for r in docs.collect() for b in items if brute(r["text"], b["text"], d.WINDOW)}
    assert wanted and found >= wanted
    assert len(found) <= len(wanted) + 1


@pytest.mark.parametrize("text", ["a\tb  c\n\nd", " x ", "a" * 1000 + " b", "5kg of 3.5 l, two m"])
def test_pieces_kept_or_not_give_the_same_template(text):
    one, two = d.Canonical(), d.Canonical()
    two.template("z " + text + " " + text)
    assert all((a == b).all() for a, b in zip(one.template(text), two.template(text)))


SPARSE = [
    (1, "Solve 3x + 4y = 12 and 5x - 2y = 7"),
    (2, "What is 12 + 30 * 4 - 7?"),
    (3, "Mix 3 kg 250 g 2 l 4 ml 6 oz 7 kg of flour 3 kg 9 kg and 2 kg 4 kg of rice"),
    (4, "define entropy briefly"),
    (5, "小明有三个苹果和两个梨他一共有几个水果"),
    (6, "แมวตัวหนึ่งนอนอยู่บนโต๊ะในบ้าน"),
    (7, "12 + 30 * 4 - 7 + 19"),
]


def test_items_with_few_words_are_searched(spark):
    texts = [f"He was told: {text} and so on" for _, text in SPARSE]
    found = leaks(spark, texts, SPARSE)
    assert {(i, i + 1, "verbatim") for i in range(len(SPARSE))} <= set(found)
    assert {(i, item) for i, item, _ in found if item != i + 1} == set()


def test_sparse_items_with_other_values(spark):
    texts = [
        "Solve 8x + 9y = 31 and 6x - 5y = 2",
        "Now what is 11 + 20 * 6 - 9?",
        "Mix 5 kg 100 g 8 l 1 ml 9 oz 6 kg of flour 5 kg 7 kg and 8 kg 1 kg of rice",
        "11 + 20 * 6 - 9 + 18 and 1 2 3 4 5 6 7 8 9",
        "define energy briefly",
        "小红吃了饭",
    ]
    assert leaks(spark, texts, SPARSE) == [(0, 1, "reparameterised"), (1, 2, "reparameterised"), (2, 3, "reparameterised")]


def test_one_conflict_leaves_the_rest_of_an_alignment(spark):
    story = "he put 2 apples and 2 pears into the old basket that stood beside the kitchen door of the farm before"
    other = " going to 7 markets with 4 friends who had 6 horses and sold 9 sheep to 5 traders near the 8 bridges of the town"
    items = [(1, story), (2, story + other)]
    changed = " going to 3 markets with 6 friends who had 8 horses and sold 1 sheep to 2 traders near the 4 bridges of the town"
    texts = [
        story.replace("2 apples", "3 apples").replace("2 pears", "5 pears"),
        story.replace("2 apples", "3 apples"),
        (story + changed).replace("2 apples", "3 apples").replace("2 pears", "5 pears"),
    ]
    found = leaks(spark, texts, items)
    assert [x[:2] for x in found] == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    every = "we saw {} men feed {} birds and {} cats eat {} fish then {} dogs run after {} boys who had {} bags of {} nuts from {} trees near {} lakes"
    item, copy = every.format(1, 2, 3, 4, 5, 6, 2, 8, 9, 7), every.format(21, 22, 23, 24, 25, 26, 27, 28, 29, 30)
    assert leaks(spark, [copy], [(1, item)]) == [(0, 1, "reparameterised")]


def test_stretches():
    values = {2: ("a", 1), 9: ("a", 2), 16: ("a", 2), 30: ("a", 3), 31: ("a", 4)}
    windows = [(i, i + 8) for i in [*range(15), 25, 26, 40]]
    assert d.stretches(windows, values.get) == [(0, 9), (3, 22), (40, 48)]
    assert d.stretches(windows[3:15], values.get) is None


PROMPT = "Answer the following question with one word and explain each step of it"


def test_a_shared_prompt_alone_is_no_leak(spark):
    own = [f"{a} {b} of the {c} near {d}" for a in LISTS[0] for b in LISTS[1] for c in LISTS[2] for d in LISTS[3]]
    items = [(i, f"{PROMPT} {text}") for i, text in enumerate(own)]
    assert len(items) == 400
    texts = [f"He wrote: {PROMPT} and left", f"{PROMPT} {own[17]}", f"so {own[399]} it was"]
    found = leaks(spark, texts, items)
    assert {x[:2] for x in found} >= {(1, 17)} and not [x for x in found if x[0] == 0]
    assert {item for doc, item, _ in found if doc == 1} == {i for i, t in enumerate(own) if shares_more(own[17], t)}


STORY = (
    "The old keeper of the lighthouse went down to the harbour every morning to see whether the boats had come home and then walked"
    " slowly back along the narrow path between the gardens where the women of the village were hanging their washing in the wind"
)


def test_a_passage_is_a_leak_of_all_items_that_share_it(spark):
    asked = ["rope", "lamp", "stove", "clock", "chair", "bottle", "mirror", "carpet", "ladder", "kettle", "basket", "candle"]
    texts = [f"He read: {STORY} and slept", STORY[:190], STORY[:120], "they walked along another path in the wind"]
    for n in (5, 12):
        items = [(i, f"{STORY} so what became of this {word} after everyone else had gone away") for i, word in enumerate(asked[:n])]
        found = {x[:2] for x in leaks(spark, texts, items)}
        assert {x for x in found if x[0] != 2} == {(doc, item) for doc in (0, 1) for item in range(n)}


def test_passages_hold_no_sign():
    text = " ".join(STORY.split()[:40])
    hashes = d.Tokens(text).windows(False, d.WINDOW)
    assert [len(found) for _, _, found in d.passages(text, d.WINDOW, np.empty(0, dtype=np.uint64))] == [9]
    assert [len(found) for _, _, found in d.passages(text, d.WINDOW, hashes[:3])] == [6]
    assert d.passages(text, d.WINDOW, hashes[16:17]) == []
    assert d.passages(" ".join(STORY.split()[:31]), d.WINDOW, hashes[:0]) == []
    tally = " ".join(str(i) for i in range(40))
    assert [(literal, len(found)) for literal, _, found in d.passages(tally, d.WINDOW, hashes[:0])] == [(True, 9)]


LISTS = [
    ["why did", "when will", "how can", "where does"],
    ["seventeen old farmers", "clever young foxes", "quiet grey horses", "many small boats", "broken glass windows"],
    ["village", "harbour", "mountain", "forest"],
    ["rivers rise", "lights fade", "roads end", "winds turn", "birds sing"],
]


def shares_more(one, two):
    """Whether both items hold a window that fewer than nine items share."""
    from collections import Counter

    def windows(text):
        words = re.findall(r"[^\W\d]+", f"{PROMPT} {text}".lower())
        words = ["#" if w in d.NUMBER_WORDS else w for w in words]
        return {tuple(words[i : i + d.WINDOW]) for i in range(len(words) - d.WINDOW + 1)}

    every = [f"{a} {b} of the {c} near {e}" for a in LISTS[0] for b in LISTS[1] for c in LISTS[2] for e in LISTS[3]]
    counts = Counter(w for t in every for w in windows(t))
    return any(counts[w] <= d.SHARED for w in windows(one) & windows(two))


def test_items_of_one_template_are_still_found(spark):
    items = [(i, f"Tom buys {i + 2} apples for {i + 30} dollars and sells every one of them at the market") for i in range(60)]
    found = leaks(spark, ["Eva buys 500 apples for 999 dollars and sells every one of them at the market"], items)
    assert found == [(0, i, "reparameterised") for i in range(60)]


def slow_leak(text, item):
    """Plain search of every diagonal: tokens matched by windows whose slots agree, where no value stands for two."""
    ours, theirs = d._CANONICAL.template(item), d._CANONICAL.template(text)
    own, told = d._texts(item), d._texts(text)
    best = 0
    for shift in range(-len(own), len(told)):
        starts = [
            p for p in range(len(own) - d.WINDOW + 1)
            if 0 <= p + shift <= len(told) - d.WINDOW
            and sum(ours[0][p : p + d.WINDOW] == d._WORD) >= d.LEAST_WORDS
            and all(ours[1][p + i] == theirs[1][p + shift + i] for i in range(d.WINDOW))
        ]
        places = sorted({p + i for p in starts for i in range(d.WINDOW)})
        values = {}
        for at in places:
            if ours[0][at] != d._WORD:
                values.setdefault((ours[0][at], own[at]), set()).add(told[at + shift])
        if all(len(v) == 1 for v in values.values()):
            best = max(best, len(places))
    return best


def test_slots_equal_a_plain_search(spark):
    import random

    rng = random.Random(9)
    names, plain = ["Alice", "Bob", "Peter", "Maria"], ["old", "red", "boat", "sees", "gives", "the", "and", "under", "house", "tree"]

    def made(slots):
        return " ".join(rng.choice(names) if rng.random() < slots else str(rng.randrange(2, 9)) if rng.random() < slots else rng.choice(plain) for _ in range(24))

    items = [(i, "x" + "yz"[i % 2] * (i + 1) + " " + made(0.15)) for i in range(12)]
    texts = []
    for _, item in items:
        swap = dict(zip(names, rng.sample(names, 4))) | {str(n): str(rng.randrange(10, 99)) for n in range(2, 9)}
        texts.append("so " + " ".join(swap.get(w, w) for w in item.split()) + " it is")
    texts += [made(0.15) for _ in range(10)]
    found = {x[:2] for x in leaks(spark, texts, items)}
    wanted = {(i, n) for i, t in enumerate(texts) for n, item in items if slow_leak(t, item)}
    assert found == wanted and len(wanted) >= 8


def test_rows_go_alike_by_broadcast_and_by_bitmap(spark, monkeypatch):
    from tallymill.llm import common

    rows = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(200)] + [(None, None, "n")], "key long, check long, t string")
    gone = spark.createDataFrame([(i, 1) for i in range(100)], "key long, check long")
    wanted = sorted(f"t{i}" for i in range(200) if not (i < 100 and i % 3 == 1)) + ["n"]
    for most in (1000, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(r["t"] for r in common.without(rows, gone, "key", "check").collect()) == sorted(wanted)
