import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs

from epitide.llm import toxicity as tox

BAD = [f"vile{s}" for s in ("ra", "to", "mi", "ne", "ka", "lu", "so", "pi")]


def text_of(rng, toxic, words=None):
    out = ["".join(rng.choice(["an", "to", "re", "li", "mo", "es"]) for _ in range(rng.randrange(1, 4)))
           for _ in range(words or rng.randrange(20, 150))]
    if toxic:
        for _ in range(max(1, len(out) // 40)):
            out.insert(rng.randrange(len(out)), rng.choice(BAD))
    return " ".join(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, text_of(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def labels(spark, rows):
    return spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def net():
    rows = corpus(400)
    return tox.fit(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]))


def test_held_out_accuracy(spark):
    rows = corpus(900)
    table = docs(spark, [t for _, t, _ in rows])
    model = tox.train(table, labels(spark, rows))
    got = {r.doc_id: r.score for r in tox.toxicity(table, model).collect()}
    unseen = [(got[i], y) for i, _, y in rows if held_out(i)]
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(s >= 0.7) == bool(y) for s, y in unseen]) > 0.97
    kept = {r.doc_id for r in tox.drop_toxic(table, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.7}
    assert tox.drop_toxic(table, model).columns == table.columns


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(300)
    table = docs(spark, [t for _, t, _ in rows])
    turned = [(i, t, 1 - y if held_out(i) else y) for i, t, y in rows]
    a, b = (tox.train(table, labels(spark, r), rounds=2).value for r in (rows, turned))
    assert all((a[k] == b[k]).all() for k in a)


def test_gradients_against_differences(net):
    rng = np.random.default_rng(2)
    words, ids, counts = tox.vocabulary(pa.array([text_of(random.Random(3), True, 50), "short one"]))
    text, first, size = tox.windows(counts)
    grid, label = tox.laid_out(ids, first, size, len(words)), np.array([1, 0, 1, 0])[:len(text)]
    f = tox.features(words)
    one = tox.Network({k: v.astype(np.float64) for k, v in net.weights.items()})
    seen = np.ones((len(words), tox.WORD_DIM + tox.CHAR_DIM))
    got = one.gradients(f, grid, label, seen)

    def loss():
        p = one.score(one.gates(one.inputs(f)).astype(np.float64), grid).astype(np.float64)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name in ("out", "attend", "ahead", "back", "input", "bias"):
        w = one.weights[name].reshape(-1)
        g = np.asarray(got[name]).reshape(-1)
        for i in rng.choice(len(w), 4, replace=False):
            keep, step = w[i], 3e-3
            w[i] = keep + step
            up = loss()
            w[i] = keep - step
            down = loss()
            w[i] = keep
            assert abs((up - down) / (2 * step) - g[i]) < 2e-3 + 0.05 * abs(g[i]), name


def test_a_text_scores_as_its_worst_window(net):
    rng = random.Random(4)
    clean = text_of(rng, False, 3000)
    words = clean.split()
    words[1501] = BAD[0]
    dirty = " ".join(words)
    a, b, c = tox.score_texts(net, pa.array([clean, dirty, " ".join(words[1480:1520])]))
    assert a < 0.5 < 0.7 <= b and c >= 0.7


def test_scores_do_not_depend_on_the_batch(net, monkeypatch):
    texts = [t for _, t, _ in corpus(60, 5)] + ["", " \n", "x", None]
    whole = tox.score_texts(net, pa.array(texts, pa.string()))
    alone = [tox.score_texts(net, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, alone, atol=1e-5)
    assert whole[-1] == whole[-3] - whole[-3] == 0 and whole[-4] == 0
    monkeypatch.setattr(tox, "DOCS_AT_ONCE", 7)
    monkeypatch.setattr(tox, "WINDOWS_AT_ONCE", 5)
    assert np.allclose(tox.score_texts(net, pa.array(texts, pa.string())), whole, atol=1e-5)


def test_windows_cover_every_word():
    for n in (1, 15, 16, 17, 31, 32, 33, 48, 49, 64, 1000):
        text, first, size = tox.windows(np.array([n, 0, n]))
        for t in (0, 2):
            mine = text == t
            at = {w - (0 if t == 0 else n) for f, s in zip(first[mine], size[mine]) for w in range(f, f + s)}
            assert at == set(range(n)) and (size[mine] <= tox.WINDOW).all()
        assert (text != 1).all()


def test_features_of_words():
    f = tox.features(pa.array(["ab", "", "é", "ab"]))
    assert np.diff(f.starts).tolist() == [2 + 1 + 0, 0, 2 + 1 + 0, 3]
    g = [f.gram[a:b].tolist() for a, b in zip(f.starts, f.starts[1:])]
    assert g[0] == g[3] != g[2] and f.word[0] == f.word[3] != f.word[1]
    assert len(tox.features(pa.array([], pa.string())).gram) == 0


def test_edge_tables(spark):
    rows = corpus(40)
    table = docs(spark, [t for _, t, _ in rows] + [None, "", "twice", "twice"], [*range(40), 50, None, 60, 60])
    none = tox.train(table, labels(spark, []))
    assert {r.score for r in tox.toxicity(table, none).collect()} == {0.0}
    one = tox.train(table, labels(spark, [r for r in rows if r[2] == 0]))
    assert one.value is None
    both = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None), (777, 1, 1)],
                                 "doc_id long, quality int, toxic int")
    model = tox.train(table, both, rounds=1)
    got = tox.toxicity(table, model).collect()
    assert len(got) == 44 and all(r.score == 0 for r in got if r.doc_id in (50, None))
    assert tox.toxicity(docs(spark, []), model).count() == 0
    assert tox.train(docs(spark, []), both).value is None
