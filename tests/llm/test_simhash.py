import random
import re

import numpy as np
import pytest
import xxhash

from tallymill.llm import simhash


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def parts_of(prints):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            top[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    parts, least = parts_of(prints), {}
    for (doc_id, _), part in zip(rows, parts):
        least[part] = min((x for x in (doc_id, least.get(part)) if x is not None), default=None)
    return sorted(repr((r[0], f"{p:016x}", least[part])) for r, p, part in zip(rows, prints, parts))


def found(spark, rows, limits=simhash.Limits()):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, node int, fingerprint string")
    return sorted(repr(tuple(r)) for r in simhash.near_duplicates(docs.repartition(4), limits=limits).collect())


def made_rows(seed, n):
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 2, 3, 4, 30, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 2, 10])):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 3])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
            texts.append(rng.choice([" ", "\n", "\t  "]).join(words).upper())
    rng.shuffle(texts)
    return list(enumerate(texts[:n]))


def test_components_equal_brute_force(spark):
    rows = made_rows(3, 500)
    wanted = brute(rows)
    assert len({r.split()[-1] for r in wanted}) < 490
    assert found(spark, rows) == wanted


def test_sample_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a b c d"), (8, "é a b c d")]
    rows += [(9, "a\xa0b c"), (None, "one"), (None, None), (None, "alone here"), (11, long), (10, long + " y"), (6, "one two")]
    rows += [(20 + i, "the same six words in all") for i in range(30)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def planted(seed, n):
    """Random fingerprints, chains and dense balls around some of them."""
    rng = random.Random(seed)
    prints = {0, 2**64 - 1}
    while len(prints) < n:
        own = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 80])):
            prints.add(own)
            other = own
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                other ^= 1 << bit
            prints.add(other)
            own = other if rng.random() < 0.1 else own
    return sorted(prints)


@pytest.mark.parametrize("limits", [simhash.Limits(), simhash.Limits(8, 5), simhash.Limits(20, 7)])
def test_links_lose_no_part(spark, limits):
    prints = planted(5, 1500)
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "node long")
    rows = simhash.links(nodes.repartition(3), limits).collect()
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in rows]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    place, top = {x: i for i, x in enumerate(prints)}, list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(place[a])] = find(place[b])
    wanted, have = parts_of(prints), [find(i) for i in range(len(prints))]
    assert len(set(wanted)) == len(set(have)) == len(set(zip(wanted, have)))


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_linked_prints_share_a_key_and_others_rarely(blocks):
    rng = random.Random(blocks)
    masks = simhash.block_masks(blocks)
    a = [rng.getrandbits(64) for _ in range(2000)]
    b = [x ^ sum(1 << bit for bit in rng.sample(range(64), 3)) for x in a]
    tables = [simhash.distances(np.array(x, dtype=np.uint64), masks) for x in (a, b)]
    one, two = map(simhash.keys_of, tables)
    assert (one == two).any(axis=1).all()
    assert (one == np.roll(two, 1, axis=0)).sum() < 10
    whole = [t.sum(axis=1).astype(int) for t in tables]
    assert np.abs(whole[0] - whole[1]).max() <= 3


def test_a_group_gives_fewer_links_than_rows():
    rng = random.Random(2)
    own = rng.getrandbits(64)
    prints = {own ^ sum(1 << bit for bit in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(3000)}
    values = np.array(sorted(prints), dtype=np.uint64)
    far = simhash.distances(values, simhash.block_masks(4)).sum(axis=1).astype(np.int8)
    assert len(list(simhash.links_of_run(values, far))) == len(values) - 1
