"""The registered queries and the pipeline over a small folder of tables."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from helpers import prose

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from epitide.llm.registry import QUERIES, SQL
from epitide.llm.toxicity import toxicity, train

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    2: ["doc_id", "n_words", "n_repeated", "spans", "earlier_doc_id"],
    3: ["doc_id", "held_out", "score", "predicted"],
    4: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    5: ["page_id", "url", "text", "n_chars"],
    6: ["doc_id", "fingerprint", "component_id"],
    7: ["vec_id", "n_links", "component_id", "kept"],
    8: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    9: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    10: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    11: ["query_id", "rank", "vec_id", "score"],
    12: ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    13: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(60)] + [None, "", "same words here"] * 3
    tests = [prose(rng, 14) for _ in range(5)]
    texts += [f"{prose(rng, 30)} {tests[i % 5]} {prose(rng, 10)}" for i in range(10)]
    texts += [f"{prose(rng, 20)} password=s3cretvalue{i} {prose(rng, 20)}" for i in range(5)]
    texts += [f"{prose(rng, 30)} nasty{i % 3}word {prose(rng, 20)}" for i in range(30)]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("nasty" in (t or ""))) for i, t in enumerate(texts)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(tests)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, tests


def test_columns_and_rows(spark):
    for name, fn in QUERIES.items():
        out = fn(spark, FOLDER)
        assert out.columns == COLUMNS[int(re.match(r"op(\d+)_", name)[1])], name
        if name.startswith(("op11_", "op12_")):
            continue
        source = {5: "pages", 7: "embeddings"}.get(int(re.match(r"op(\d+)_", name)[1]), "documents")
        assert out.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count(), name


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_checks(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], SQL[name]).startswith("ok")


def test_all_are_registered():
    assert set(QUERIES) < set(queries()) and "pipeline" in queries() and set(SQL) <= set(oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_nearest_on_the_given_tables(spark, sf):
    """Recall against brute force over the whole table, and exact scores of what is found."""
    d = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = QUERIES["op11_vantage_points"](spark, d).collect()
    asked = np.flatnonzero(ids % 50 == 0)
    cosines = x[asked] @ x.T
    cosines[np.arange(len(asked)), asked] = -2
    want = {(ids[q], ids[j]) for q, c in zip(asked, cosines) for j in np.argsort(-c)[:5]}
    assert len(got) == len(want) == 5 * len(asked)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    place = {i: n for n, i in enumerate(ids)}
    for r in got:
        assert abs(r.score - x[place[r.query_id]] @ x[place[r.vec_id]]) < 1e-12
    assert sorted((r.query_id, r["rank"]) for r in got) == [(i, n) for i in sorted(ids[asked]) for n in range(1, 6)]


def test_sizes_and_checksums(spark, folder):
    import zlib
    d, rows, _ = folder
    got = {r.doc_id: r for r in QUERIES["op1_histogram_sort"](spark, d).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_pipeline_against_plain_steps(spark, folder):
    """What each stage decides, worked out again from its input with plain Python."""
    from test_decontam import expected as contaminated
    from test_secret_scan import plain as secret
    from test_simhash import plain as simhash
    from helpers import union_find
    from tokenizers import Tokenizer

    import public_tokenizers
    d, rows, tests = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity(docs, model).collect()}
    left = [(i, t) for i, t, *_ in rows if scores[i] < 0.7]
    assert 0 < len(rows) - len(left) <= 31
    prints = {i: simhash(t) for i, t in left}
    key = lambda i: 1 << 60 if i is None else i
    ids = [key(i) for i, _ in left]
    close = [(key(a), key(b)) for a in prints for b in prints if key(a) < key(b) and (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = union_find(ids, close)
    left = [(i, t) for i, t in left if groups[key(i)] == key(i)]
    hit = contaminated([t for _, t in left], tests, 10)
    left = [x for x, h in zip(left, hit) if not h[3]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left:
        out, at = "", 0
        for s in filter(None, secret(t)[1].split(",")):
            a, b = map(int, s.split(":")[1:])
            out, at = out + t[at:a] + "[SECRET]", b
        text = out + (t or "")[at:]
        want[i] = (text, np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
    got = {r.doc_id: (r.decoded, bytes(r.ids)) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want
    assert any("[SECRET]" in t for t, _ in want.values())


def test_stages_keep_the_columns_of_documents(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "bpe"]
    inner = ["_fp", "_one", "_score", "_key", "_base", "_spans", "_hot", "_more0", "fp", "key", "base", "spans"]
    named = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in inner])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        out = stage(spark, named, d)
        assert out.columns == named.columns and out.count() > 50, name
        wrong = " OR ".join(f"NOT {n} <=> concat('{n}', doc_id)" for n in inner)
        assert out.where(wrong).count() == 0, name
        assert stage(spark, docs.limit(0), d).count() == 0


def test_no_temporary_name_is_left_in_results(spark):
    digest = QUERIES["op10_fm_index"](spark, FOLDER).where("n_words = 0").first()
    assert digest is None or digest.kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert os.path.isdir(FOLDER)
