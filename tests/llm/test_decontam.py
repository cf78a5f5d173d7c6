import random
import re

import pytest
from helpers import docs, prose

from epitide.llm.decontam import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(range(len(texts)) if ids is None else ids, texts)],
                                 "item_id long, text string, doc_id string")


def expected(texts, tests, window):
    grams = {}
    for i, t in enumerate(tests):
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in grams:
                    hit |= set(range(p, p + n))
                    named |= grams[tuple(w[p:p + n])]
        out.append((len(w), len(hit), sorted(named), bool(hit)))
    return out


def compare(spark, texts, tests, window):
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(
        docs(spark, texts), items(spark, tests), window).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts, tests, window)
    return got


@pytest.mark.parametrize("shortest", [1, 2, 7, 10, 15])
def test_against_plain_search(spark, shortest):
    rng = random.Random(shortest)
    tests = [prose(rng, n, 60) for n in (12, 15, 30, 40, shortest)] + ["", "!!! ...", None]
    texts = [None, "", "?!", "É è ß ÀB3c"]
    for _ in range(60):
        t = rng.choice(tests[:5]).split()
        a = rng.randrange(len(t))
        b = rng.randrange(a, len(t)) + 1
        texts.append(f"{prose(rng, rng.randrange(30), 60)}, {'; '.join(t[a:b]).upper()} {prose(rng, rng.randrange(30), 60)}")
    texts += [texts[20]] * 30 + [" ".join(tests[2].split() * 3), tests[1] + " " + tests[2]]
    got = compare(spark, texts, tests, 10)
    assert any(x[3] for x in got.values()) and not all(x[3] for x in got.values())


def test_other_alphabets_and_capitals(spark):
    tests = ["Ünder DIE brücke İst ein Weg über dem Fluß 日本 语"]
    compare(spark, [tests[0], tests[0].lower(), tests[0].replace(" ", " -- "), tests[0].replace("ü", "Ü")], tests, 10)


def test_shuffled_join_gives_the_same(spark):
    rng = random.Random(1)
    tests = [prose(rng, 30, 50) for _ in range(4)]
    texts = [prose(rng, 20, 50) + " " + " ".join(tests[i % 4].split()[5:18]) for i in range(20)] + ["clean"]
    from epitide.llm.decontam import window_hits
    table, bench = docs(spark, texts), items(spark, tests)
    few = sorted((r.key, r["items"], r.hits) for r in window_hits(table, bench).collect())
    assert few == sorted((r.key, r["items"], r.hits) for r in window_hits(table, bench, most=0).collect())


def test_edge_rows(spark):
    tests = items(spark, ["a b c d e f g h i j k", "a b c d e f g h i j k"], [None, 2])
    table = docs(spark, ["x a b c d e f g h i j y", "x a b c d e f g h i j y", "clean", None], [1, 1, None, 4])
    got = sorted(((r.doc_id, r.n_hit, r["items"]) for r in contamination(table, tests).collect()), key=str)
    assert got == sorted([(1, 10, ["2"]), (1, 10, ["2"]), (None, 0, []), (4, 0, [])], key=str)
    assert sorted(str(r.doc_id) for r in drop_contaminated(table, tests).collect()) == ["4", "None"]
    assert drop_contaminated(table, tests).columns == table.columns
    none = items(spark, [])
    assert not any(r.contaminated for r in contamination(table, none).collect())
    assert drop_contaminated(table, none).count() == 4
    assert contamination(docs(spark, []), tests).count() == 0 and contamination(docs(spark, []), none).count() == 0


def test_a_template_of_many_items_that_a_text_repeats(spark):
    """1,000 items share their words, a text repeats them 1,000 times: the windows meet the items once, not at every place."""
    words = " ".join(f"t{i}" for i in range(10))
    items = spark.createDataFrame([(i, words, "x") for i in range(1000)], "item_id long, text string, doc_id string")
    table = docs(spark, [f"{words} " * 1000, "other words"]).selectExpr("*", "5 AS _key")
    hot = next(r for r in contamination(table, items, 10).collect() if r.doc_id == 0)
    assert hot.n_hit == hot.n_words == 10_000 and len(hot["items"]) == 1000 and len(hot.hits) == 1000
    kept = drop_contaminated(table, items, 10)
    assert kept.columns == table.columns and [(r.text, r["_key"]) for r in kept.collect()] == [("other words", 5)]
