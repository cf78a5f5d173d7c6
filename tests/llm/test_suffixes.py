import random

import pytest
from helpers import docs, prose
from test_repeats import expected

from epitide.llm.suffixes import suffix_repeats


def run(spark, rows, length, gram):
    out = suffix_repeats(docs(spark, [t for _, t in rows], [i for i, _ in rows]), length, gram).collect()
    return {r.doc_id: (r.n_words, [j for s in r.spans for j in range(s.start, s.stop)], r.n_repeated, r.earlier_doc_id) for r in out}


@pytest.mark.parametrize("length, gram", [(10, 3), (50, 8)])
def test_planted_passages(spark, length, gram):
    """Every word of a passage that an earlier document has, and no other."""
    rng = random.Random(length)
    passages = [prose(rng, length + k, 5000) for k in (0, 1, 7, 40, 200)]
    rows = [(i, f"{prose(rng, 60, 5000)} {passages[i % 5]} {prose(rng, 60, 5000)}") for i in range(60)]
    rows += [(100 + i, prose(rng, 150, 5000)) for i in range(20)] + [(200, rows[3][1]), (201, "short " * 3), (202, None), (203, "")]
    rng.shuffle(rows)
    got = run(spark, rows, length, gram)
    for (i, _), (n, gone, _) in zip(rows, expected(rows, length)):
        assert got[i][:2] == (n, gone) and got[i][2] == len(gone), i
        assert (got[i][3] is not None) == bool(gone) and (not gone or got[i][3] < i)


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = suffix_repeats(docs(spark, [text, text, text, None], [4, 4, None, None]), 10, 3).collect()
    assert sorted((str(r.doc_id), r.n_repeated, r.earlier_doc_id) for r in out) == [("4", 0, None), ("4", 0, None), ("None", 0, None), ("None", 30, 4)]
    assert suffix_repeats(docs(spark, []), 50).count() == 0


def compared(spark, rows, length, gram):
    """Spans of all windows, and the smallest id that has one of them."""
    got = run(spark, rows, length, gram)
    for (i, text), (n, gone, _) in zip(rows, expected(rows, length)):
        assert got[i][:3] == (n, gone, len(gone)), i
        words, least = text.split(), []
        for p in range(len(words) - length + 1):
            window = f" {' '.join(words[p:p + length])} "
            least += [j for j, t in rows if j < i and window in f" {t} "]
        assert got[i][3] == min(least, default=None), i


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hundreds_of_holders_over_many_ranges(spark, many_ranges):
    """One passage in 300 texts with other words around it, cut into 40 ranges: all but the smallest id are repeats."""
    rng = random.Random(5)
    passage = prose(rng, 12, 5000)
    rows = [(i, f"{prose(rng, 15, 5000)} {passage} {prose(rng, 15, 5000)}") for i in range(300)]
    rng.shuffle(rows)
    compared(spark, rows, 10, 3)


def test_pieces_hold_each_window_once(spark, many_ranges, monkeypatch):
    """Near copies cut into many small pieces: few windows meet across pieces, however many texts hold them."""
    from epitide.llm import suffixes
    monkeypatch.setattr(suffixes.neighbours, "__defaults__", (50,))
    rng = random.Random(6)
    words = prose(rng, 60, 5000).split()
    rows = []
    for i in range(150):
        words_here = list(words)
        words_here[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words_here)))
    rng.shuffle(rows)
    compared(spark, rows, 10, 3)


def test_rows_by_texts_where_words_recur(spark, many_ranges, monkeypatch):
    """Two words in turn, a hundred times in each of 40 texts: rows go by texts and ranges, not by the 4,000 places of a text."""
    from epitide.llm import suffixes
    counts, whole = [], suffixes.sorted_matches

    def counted(*given):
        out = suffixes.cut(whole(*given), "counted")
        counts.append((given[0].count(), out.count()))
        return out

    monkeypatch.setattr(suffixes, "sorted_matches", counted)
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 12, 5000)} {'tick tock ' * 100}{prose(rng, 12, 5000)}") for i in range(40)]
    rng.shuffle(rows)
    compared(spark, rows, 10, 3)
    (places, repeats), = counts
    assert places > 3_000 and repeats < 400, counts


@pytest.mark.parametrize("at_once", [30, 1 << 17])
def test_windows_of_a_text_are_joined(at_once):
    """Windows of many suffixes of a text are one row, or one for each gap, also where rows of an id come twice."""
    import pyarrow as pa

    from epitide.llm.suffixes import marked, neighbours
    rows = [(k, i, p, "a b a b a ", "b" if p else "") for k, i in (("k1", 1), ("k2", 2)) for p in (0, 2, 4, 6, 20, 22) for _ in range(2)]
    rows = [("y", 9, 0, "_ _ _ _ _ ", ""), *rows, ("z", 9, 0, "c c c c c ", "")]
    batch = pa.RecordBatch.from_pydict(dict(zip(("key", "id", "pos", "right", "left"), map(list, zip(*rows)))))
    found = [r for b in neighbours(5, 3, at_once)([batch]) for r in b.to_pylist()]
    opened = [r for r in found if r["windows"] is not None]
    got = {(r["key"], r["start"], r["stop"], r["earlier"]) for r in found if r["piece"] is None}
    assert len(got) + len(opened) <= 2 * 2 * (2 if at_once == 30 else 1)
    least = {}
    for r in found:
        if r["window"] is not None:
            least[r["window"]] = min(r["earlier"], least.get(r["window"], 9))
    stream = [{**r, "earlier": least[r["window"]]} if r["window"] is not None else r for r in found if r["piece"] is not None]
    stream.sort(key=lambda r: (r["piece"], r["window"] is None))
    names = ("piece", "window", "key", "start", "earlier", "windows")
    again = pa.RecordBatch.from_pydict({c: [r[c] for r in stream] for c in names}, schema=pa.schema([
        ("piece", pa.int64()), ("window", pa.binary()), ("key", pa.string()), ("start", pa.int64()), ("earlier", pa.int64()), ("windows", pa.binary())]))
    got |= {tuple(r.values()) for b in marked(5)([again]) for r in b.to_pylist()}
    words = {(k, e, j) for k, start, stop, e in got for j in range(start, stop)}
    assert words == {("k2", 1, j) for j in (*range(11), *range(19, 27))}


def around(left, right, length, number):
    """Words that agree with the common ones in ``left`` words before a marker and ``right`` words from it on."""
    before = [f"l{j}" if j < left else f"x{number}l{j}" for j in range(length)][::-1]
    after = [f"r{j}" if j < right else f"x{number}r{j}" for j in range(length)]
    return " ".join([*before, *after])


def test_holders_with_others_between_them(spark):
    """Holders of one passage that agree to the left and to the right in different measure, with others sorted between."""
    rng = random.Random(9)
    for _ in range(3):
        rows = [(i, around(rng.randrange(11), rng.randrange(3, 11), 10, rng.randrange(40))) for i in range(60)]
        compared(spark, rows, 10, 3)


@pytest.mark.parametrize("at_once", [2, 1 << 17])
def test_groups_inside_a_range(at_once):
    """Held in memory or left open, every equal window of a group is found; a group between two others is not left open."""
    import pyarrow as pa

    from epitide.llm.suffixes import neighbours
    rows = [("z", 9, 0, "a a a a ", ""), ("k1", 1, 3, "b b b c ", "p q"), ("k2", 7, 3, "b b b d ", "o q"), ("k3", 3, 3, "b b b e ", "p q"),
            ("y", 9, 0, "c c c c ", "")]
    batch = pa.RecordBatch.from_pydict(dict(zip(("key", "id", "pos", "right", "left"), map(list, zip(*rows)))))
    found = [r for b in neighbours(5, 3, at_once)([batch]) for r in b.to_pylist()]
    repeats = {(r["key"], r["start"], r["stop"], r["earlier"]) for r in found if r["piece"] is None}
    opened = {r["key"] for r in found if r["windows"] is not None}
    if at_once == 2:
        assert not repeats and opened == {"k1", "k2", "k3"}
    else:
        assert repeats == {("k3", 1, 6, 1)} and not opened
