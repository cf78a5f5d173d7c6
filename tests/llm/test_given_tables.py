"""Registered queries that SQL does not express, against plain Python over the whole given tables."""

import hashlib
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import xxhash
from test_repeats import expected as repeated
from test_simhash import expected as fingerprints

from epitide.llm import toxicity as tox
from epitide.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def documents(spark, folder=FOLDER):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_shards_are_cuts_of_the_sorted_documents(spark):
    rows = documents(spark)
    got = by_id(QUERIES["op1_histogram_sort"](spark, FOLDER).collect())

    def order(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42) if row[1] is not None else 42
        return h - (1 << 64) if h >> 63 else h, row[0]

    places = [(got[i].shard, got[i].slot) for i, _ in sorted(rows, key=order)]
    assert places == [(s, n) for s, g in groupby(p[0] for p in places) for n, _ in enumerate(g)]
    bytes_of, largest = defaultdict(int), 0
    for i, t in rows:
        size = len((t or "").encode()) + 1
        assert (got[i].size, got[i].text_crc32) == (size, zlib.crc32((t or "").encode()))
        bytes_of[got[i].shard] += size
        largest = max(largest, size)
    mean = sum(bytes_of.values()) / 16
    assert set(bytes_of) <= set(range(16)) and all(abs(bytes_of[s] - mean) <= 0.022 * mean + largest for s in range(16))


def test_repeated_words_of_all_windows(spark):
    rows = documents(spark)
    got = by_id(QUERIES["op2_sparse_suffixes"](spark, FOLDER).collect())
    want = repeated(rows, 50)
    assert any(gone for _, gone, _ in want)
    for (i, _), (n, gone, _) in zip(rows, want):
        assert (got[i].n_words, got[i].n_repeated) == (n, len(gone)), i
        assert (got[i].earlier_doc_id is not None) == bool(gone) and (not gone or got[i].earlier_doc_id < i), i


def test_fingerprints_and_components_of_all_pairs(spark):
    rows = documents(spark)
    got = by_id(QUERIES["op6_simhash"](spark, FOLDER).collect())
    prints, groups = fingerprints([t for _, t in rows], [i for i, _ in rows])
    assert len(set(groups.values())) < len(rows)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", groups[i]) for i, _ in rows}


def test_ids_and_texts_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(QUERIES["op9_bpe"](spark, FOLDER).collect())
    for i, t in documents(spark):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), i


# toxicity: the network word by word ------------------------------------------------------------


def row_of(values):
    return (values * 0x9E3779B97F4A7C15 & MASK) >> 49


def word_input(weights, word):
    """The word's own row, and the scaled sum of the rows of its byte sequences."""
    raw = f"^{word}$".encode()
    total = sum((b + 1) * pow(0x100000001B3, i + 1, 1 << 64) for i, b in enumerate(raw)) & MASK
    grams = [raw[a:a + n] for a in range(len(raw)) for n in tox.GRAMS if a + n <= len(raw)]
    chars = np.zeros(tox.CHAR_DIM)
    for g in grams:
        chars += weights["chars"][row_of(sum((b + 1) * pow(0x100000001B3, len(g) - 1 - i, 1 << 64) for i, b in enumerate(g)) & MASK)]
    return np.concatenate([weights["words"][row_of(total)], chars / max(1, len(grams)) ** 0.5])


def logistic(x):
    return 1 / (1 + np.exp(-x))


def states(x, u):
    """States after each word; ``x`` holds the inputs of the update, reset and new-state gates."""
    s, h, out = tox.STATE, np.zeros(tox.STATE), []
    for a in x:
        b = h @ u
        z, r = logistic(a[:s] + b[:s]), logistic(a[s:2 * s] + b[s:2 * s])
        h = (1 - z) * h + z * np.tanh(a[2 * s:] + r * b[2 * s:])
        out.append(h)
    return np.array(out)


def window_score(weights, words):
    x = np.array([word_input(weights, w) for w in words]) @ weights["input"] + weights["bias"]
    side = 3 * tox.STATE
    both = np.concatenate([states(x[:, :side], weights["ahead"]), states(x[::-1, side:], weights["back"])[::-1]], axis=1)
    weight = np.exp(both @ weights["attend"])
    return logistic(weight / weight.sum() @ both @ weights["out"] + weights["out_bias"][0])


def text_score(weights, text):
    words = [w.strip(tox.EDGES) for w in (text or "").lower().split()]
    starts = [a for a in range(0, len(words), tox.STRIDE) if a == 0 or a + tox.WINDOW - tox.STRIDE < len(words)]
    return max((window_score(weights, words[a:a + tox.WINDOW]) for a in starts), default=0.0)


def test_scores_of_a_plain_network(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    weights = {k: v.astype(float) for k, v in tox.train(docs, labels).value.items()}
    got = by_id(QUERIES["op3_toxicity"](spark, FOLDER).collect())
    for i, t in documents(spark):
        r = got[i]
        assert abs(r.score - text_score(weights, t)) < 1e-3, i
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_labels_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [(r.score, r.predicted, label[r.doc_id]) for r in QUERIES["op3_toxicity"](spark, folder).collect()
            if r.held_out and r.doc_id in label]
    toxic, clean = ([s for s, _, y in rows if y == v] for v in (1, 0))
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    found = sum(p for _, p, y in rows if y == 1)
    assert above / (len(toxic) * len(clean)) >= 0.9
    assert found >= 0.8 * len(toxic) and found >= 0.85 * sum(p for _, p, _ in rows)
