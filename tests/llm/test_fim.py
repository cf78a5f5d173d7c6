import hashlib
import random

import pyarrow as pa
import pytest
from helpers import docs

from epitide.llm import fim


def plain(doc_id, text):
    """One document at a time, with slices of code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


ALPHABET = ["a", "é", "ß", "語", "🙂", " ", "\n", "<", "P", "S", "M", ">", "\x00", "́"]


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 40))) for _ in range(400)]
    return out + ["", None, "<P>", "x<S>y", "<M", "<<P", "a", "🙂", "same text", "same text", "語" * 70_000]


def test_against_plain_python(spark):
    rows = texts()
    table = docs(spark, rows, [*range(3, len(rows) + 1), None, -7])
    got = fim.restore(fim.fill_in_middle(table)).collect()
    ids = [r.doc_id for r in table.select("doc_id").collect()]
    assert [r.doc_id for r in got] == ids
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r, i, t in zip(got, ids, rows):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, t)
        assert r.restored == (t or "")


@pytest.mark.parametrize("window, at_once", [(7, 50), (1 << 20, 8 << 20)])
def test_windows_and_slices_do_not_show(monkeypatch, window, at_once):
    monkeypatch.setattr(fim, "WINDOW", window)
    monkeypatch.setattr(fim, "BYTES_AT_ONCE", at_once)
    rows = [t or "" for t in texts()[:300]]
    whole = pa.array(rows)
    assert [b - a for a, b in fim.slices(whole)] and sum(b - a for a, b in fim.slices(whole)) == len(rows)
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(len(rows))]
    for a, b in fim.slices(whole):
        h = [fim.np.array([int(d[8 * k:8 * k + 8], 16) for d in digests[a:b]]) for k in range(4)]
        out, n, form, low, middle = fim.transform(whole.slice(a, b - a), h, 90, 20)
        assert out.to_pylist() == [plain(i, t)[4] for i, t in zip(range(a, b), rows[a:b])]
        assert fim.inverse(out.cast(pa.string()), form).to_pylist() == rows[a:b]


def test_rates(spark):
    table = docs(spark, [f"text number {i}" for i in range(300)])
    assert {r.form for r in fim.fill_in_middle(table, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(table, rate=100, spm=100).collect()} == {"spm"}
    assert [r.output for r in fim.fill_in_middle(table, seed="2").collect()] != [r.output for r in fim.fill_in_middle(table).collect()]


def test_edge_rows(spark):
    assert fim.restore(fim.fill_in_middle(docs(spark, []))).count() == 0
    row = spark.createDataFrame([(None, None, 1)], "output string, form string, n int")
    assert fim.restore(row).collect()[0].asDict() == {"output": None, "form": None, "n": 1, "restored": ""}
    named = docs(spark, ["some text"]).withColumnsRenamed({"doc_id": "key2"}).withColumnsRenamed({"key2": "id"})
    assert fim.fill_in_middle(named, doc_id="id").columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_no_shuffle(spark):
    plan = fim.restore(fim.fill_in_middle(docs(spark, ["a"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
