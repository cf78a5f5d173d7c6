import random

import numpy as np
import pytest
from helpers import docs, prose

from epitide.llm.fm_index import FMIndex, WaveletTree
from epitide.llm.repeats import names, repeated_passages


def expected(rows, window):
    big = 1 << 63
    texts = [((i if i is not None else big), (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            least[g] = min(least.get(g, big), i)
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((len(w), sorted(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def compare(spark, rows, window, **options):
    ids = [i for i, _ in rows]
    assert len(set(ids)) == len(ids)
    got = {}
    for r in repeated_passages(docs(spark, [t for _, t in rows], ids), window, **options).collect():
        gone = [j for s in r.spans for j in range(s["start"], s["stop"])]
        assert r.n_removed == len(gone) and (r.kept is None) == (not gone)
        got[r.doc_id] = (r.n_words, gone, r.kept)
    for (i, t), (n, gone, kept) in zip(rows, expected(rows, window)):
        assert got[i][:2] == (n, gone), (i, t)
        if gone:
            assert got[i][2] == kept
    return sum(len(g) for _, g, _ in got.values())


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [prose(rng, k, 300).split() for k in (6, 9, 14, 40, 90)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                s = rng.choice(shared)
                a = rng.randrange(len(s))
                parts += s[a:a + rng.randrange(1, len(s) + 1)]
            else:
                parts += prose(rng, rng.randrange(1, 25), 300).split()
        texts.append("  ".join(parts))
    texts += [texts[3]] * 5 + [texts[9] + " tail"] * 2 + ["so " * 60, "so " * 30 + "end", None, "", "\t\n", "few words"]
    texts += [" ".join(shared[4]) + f" u{i} v{i} w{i}" for i in range(30)]
    ids = rng.sample(range(10_000), len(texts) - 1) + [None]
    rows = list(zip(ids, texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shard_words": 150}), (3, {"name_words": 60}), (4, {"name_words": 0})])
def test_against_all_windows(spark, seed, options):
    assert compare(spark, corpus(seed), 8, gram=3, **options) > 500


def test_window_of_fifty(spark):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 40)} {passage if i % 3 else passage[:200]} {prose(rng, 500)}") for i in range(40)]
    assert compare(spark, rows, 50) > 1000


def test_edge_rows(spark):
    text = "a b c d e f g h i j"
    out = repeated_passages(docs(spark, [text, text, text, text + " k", None], [4, 4, None, None, None]), 5, gram=2).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out)
    assert got == [("4", 10, 0), ("4", 10, 0), ("None", 0, 0), ("None", 10, 10), ("None", 11, 10)]
    assert repeated_passages(docs(spark, []), 50).count() == 0
    assert repeated_passages(docs(spark, ["one"]), 50).collect()[0].n_removed == 0


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 1000)
    tree = WaveletTree(values, 37)
    for at in (0, 1, 63, 64, 65, 500, 1000):
        symbols = np.arange(37)
        assert tree.rank(symbols, np.full(37, at)).tolist() == [int((values[:at] == s).sum()) for s in symbols]


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 50])
def test_index_groups_equal_windows(depth):
    rng = np.random.default_rng(depth)
    parts, owner, first, count = [], [], [], []
    base = rng.integers(1, 5, 400)
    at = 0
    for k in range(12):
        a = rng.integers(0, 200)
        p = np.concatenate([base[a:a + 120], rng.integers(1, 5, 30)])
        parts.append(np.concatenate([p, [0]]))
        owner.append(np.full(len(p) + 1, 100 - k))
        first.append(at)
        count.append(len(p) - depth + 1)
        at += len(p) + 1
    text = np.concatenate(parts)
    index = FMIndex(text, np.concatenate(owner), depth)
    place, group = index.statistics(np.array(first), np.array(count))
    assert sorted(place) == [p for f, c in zip(first, count) for p in range(f, f + c)]
    least, owners = {}, np.concatenate(owner)
    for p in place:
        w = tuple(text[p:p + depth])
        least[w] = min(least.get(w, 1000), owners[p])
    for p, g in zip(place, group):
        assert index.least[g] == least[tuple(text[p:p + depth])]


def test_names_are_smallest_hashes_of_each_window():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    one = names(h, 8, 8)
    for window, gram in ((8, 3), (50, 8), (9, 9), (10, 1)):
        grams = names(h, gram, gram)
        got = names(h, window, gram)
        assert got.tolist() == [min(grams[p:p + window - gram + 1]) for p in range(200 - window + 1)]
    assert len(one) == 193 and len(names(h[:5], 8, 3)) == 0
