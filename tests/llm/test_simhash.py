import random
from itertools import combinations

import pytest
import xxhash
from helpers import docs, prose, union_find

from epitide.llm.simhash import bit_majority, drop_near_duplicates, index_slots, links, signed, simhash_groups


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rng, n):
    base = prose(rng, 80).split()
    out = []
    for _ in range(n):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


def expected(texts, ids):
    prints = {i: plain(t) for i, t in zip(ids, texts)}
    close = [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    return prints, union_find(ids, close)


def test_fingerprints():
    rng = random.Random(5)
    for text in [None, "", " \t\n", "one", "Two WORDS", "Éa b c d", "a b c d", prose(rng, 400), "x y " * 70_000]:
        assert bit_majority(text, 3) & (1 << 64) - 1 == plain(text)


def test_groups_against_all_pairs(spark):
    rng = random.Random(6)
    texts = near(rng, 150) + near(rng, 60) + [prose(rng, 40) for _ in range(100)] + ["same text here"] * 30 + ["", None, " "]
    ids = rng.sample(range(10_000), len(texts))
    prints, groups = expected(texts, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs(spark, texts, ids)).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in ids}


@pytest.mark.parametrize("pairs_up_to", [0, 3, 10_000])
def test_large_postings_lose_no_link(spark, pairs_up_to):
    """Pairs, masks, or both: the same connected fingerprints."""
    rng = random.Random(7)
    prints = set()
    for _ in range(3):
        center = rng.getrandbits(64)
        for _ in range(60):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 3, 4]))))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = [(r.a, r.b) for r in links(table, 2, pairs_up_to).collect()]
    full = (1 << 64) - 1
    assert all((a & full ^ b & full).bit_count() <= 2 for a, b in found)
    nodes = [signed(p) for p in prints]
    close = [(a, b) for a, b in combinations(nodes, 2) if (a & full ^ b & full).bit_count() <= 2]
    assert union_find(nodes, found) == union_find(nodes, close)


def test_every_pair_of_positions_is_covered():
    for distance in (1, 2, 3):
        slots = index_slots(distance)
        for c in combinations(range(8), distance):
            assert any(set(c) <= set(s) for s in slots)


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    texts = near(rng, 40) + [prose(rng, 30) for _ in range(20)] + ["copy of this text"] * 10
    ids = rng.sample(range(1000), len(texts))
    _, groups = expected(texts, ids)
    table = docs(spark, texts, ids)
    out = drop_near_duplicates(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))


def test_edge_rows(spark):
    table = docs(spark, ["a b c d", "a b c d", "a b c d", "x y z", "x y z", None, ""], [3, 3, None, None, None, 9, 8])
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(table).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (None, None), (None, None), (9, 8), (8, 8)], key=str)
    kept = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(table).collect())
    assert kept == [("3", "a b c d"), ("8", ""), ("None", "x y z")]
    assert simhash_groups(docs(spark, [])).count() == 0 and drop_near_duplicates(docs(spark, [])).count() == 0
