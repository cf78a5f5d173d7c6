import random
from collections import defaultdict

import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from epitide.llm import shards
from epitide.llm.shards import gaps, histogram, keyed, shard_documents, splitters


def check(rows, texts, shards, most):
    assert len(rows) == len(texts)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert all(abs(size[s] - mean) <= most for s in range(shards)), (dict(size), mean)


def test_equal_bytes(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.choice([3, 20, 60])) for _ in range(3000)]
    rows = shard_documents(docs(spark, texts), 16).collect()
    check(rows, texts, 16, 2 * max(map(len, texts)))
    assert {r.doc_id: r.size for r in rows} == {i: len(t) + 1 for i, t in enumerate(texts)}


def test_hot_copies_repeats_nulls_and_one_giant(spark):
    texts = ["same text"] * 900 + [None, "", "ü" * 40] + [f"t{i}" for i in range(600)] + ["x" * 3000]
    ids = [5] * 400 + list(range(400, 900)) + [None, None, 1] + list(range(1000, 1601))
    rows = shard_documents(docs(spark, texts, ids), 4).collect()
    check(rows, texts, 4, 3100)
    assert sorted(r.size for r in rows if r.doc_id is None) == [1, 1]
    assert next(r.size for r in rows if r.doc_id == 1) == 81


def test_small_groups_stay_whole(spark):
    rng = random.Random(4)
    texts = [t for _ in range(400) for t in [prose(rng, 30)] * rng.choice([1, 2, 3])]
    rows = shard_documents(docs(spark, texts), 4).collect()
    check(rows, texts, 4, sum(len(t) + 1 for t in texts) // 4 // 40)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_small_tables(spark):
    assert shard_documents(docs(spark, []), 16).count() == 0
    one = shard_documents(docs(spark, ["a"]), 16).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_counts_are_exact(spark):
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h"))
    table = keyed(rows, F.col("h"), F.col("id"), F.lit(3))
    keys = sorted(bytes(r["_key"]) for r in table.select("_key").collect())
    size, count = histogram(table, [keys[10], keys[500]])
    assert list(count) == [10, 500] and list(size) == [30, 1500]
    bounds, below = splitters(table, 10, 0.0)
    assert below == [100 * i for i in range(1, 10)] and bounds == sorted(bounds)


def test_kept_columns(spark):
    out = shard_documents(docs(spark, ["a", "b"]), 2, text="text", body=F.col("text"))
    assert out.columns == ["doc_id", "size", "body", "shard", "slot"]


@pytest.mark.parametrize("hot", [0, 2000])
def test_few_rounds(spark, monkeypatch, hot):
    """A handful of counting rounds, whether the keys are even or a third of all rows is one text."""
    rounds = []
    monkeypatch.setattr(shards, "gaps", lambda table, probes: rounds.append(len(probes)) or gaps(table, probes))
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([3, 20, 60])) for _ in range(4000)] + ["the same text " * 8] * hot
    rows = shard_documents(docs(spark, texts), 16).collect()
    check(rows, texts, 16, 600)
    assert len(rounds) <= 8, rounds


def test_shards_equal_a_plain_sort(spark):
    """Shards and slots follow one order of all documents: by the hash of the text, then the id."""
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([2, 30])) for _ in range(500)] + ["same"] * 200
    table = docs(spark, texts)
    hashes = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    rows = shard_documents(table, 8).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(hashes, key=lambda i: (hashes[i], i))
    below, size = 0, sum(len(t) + 1 for t in texts)
    for s in range(8):
        below += sum(r.size for r in rows if r.shard == s)
        assert abs(below - size * (s + 1) / 8) <= size / 8 * 0.02 + max(map(len, texts))
