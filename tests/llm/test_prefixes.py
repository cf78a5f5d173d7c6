import hashlib
import random
import zlib

import pytest
from epitide.llm import prefixes as px

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k0 string, _part int, no int, n_convs int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3, 4, 5) for r in rows], SCHEMA)


def expected(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            x = x or ""
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x[:64], hashlib.md5(x.encode()).hexdigest(), x))
    turns = {c: [(v[2], v[5]) for v in sorted(vs)] for c, vs in own.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = turns.get(first, [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(node))))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out[(min(cs), len(node))] = (
            min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])),
            sum(n not in children for n in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def talk(rng, c, words):
    return [(c, i, "user" if i % 2 == 0 else "assistant", rng.choice(words)) for i in range(rng.randrange(0, 14))]


def test_against_a_dictionary(spark):
    rng = random.Random(3)
    rows = [r for c in range(-12, 180) if rng.random() < 0.9 for r in talk(rng, c, ["a", "é語", "b" * 70, "c"])]
    rows += [(500 + c, t, "user", x) for c in range(40) for t, x in enumerate(["hello", "there", "friend"])]
    rows += [(5000 + 7 * c, t, "user", "x") for c in range(300) for t in range(9)]
    rng.shuffle(rows)
    assert found(px.conversation_trie(table(spark, rows)).digests()) == expected(rows)


def test_edge_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "b", "late"), (1, 2, "user", None), (1, 2, "user", None),
            (2, 0, "user", ""), (10, 5, "user", "ä" * 5000), (10, 5, "user", "ä" * 5001), (11, 0, "", "x"), (12, 1, "x", "")]
    assert found(px.conversation_trie(table(spark, rows)).digests()) == expected(rows)
    assert px.conversation_trie(table(spark, [])).digests().count() == 0
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert found(px.conversation_trie(table(spark, [(turnless, 0, "user", "gone")])).digests()) == {
        (turnless, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}


def test_one_long_conversation_over_ranges(spark):
    rng = random.Random(4)
    rows = [(0, i, "user", rng.choice("abc")) for i in range(3000)] + [(c, i, "user", "a") for c in range(1, 40) for i in range(10)]
    trie = px.conversation_trie(table(spark, rows))
    got = found(trie.digests())
    assert (0, 3000) in got and got[(0, 3000)][2:5] == (0, 1, 0)
    small = [r for r in rows if r[0] or r[1] < 60]
    assert found(px.conversation_trie(table(spark, small)).digests()) == expected(small)


def test_end_lists_and_last_turns(spark):
    rows = [(c, t, "user", x) for c in (3000, 3100, 2 * 10 ** 12, -45, -2) for t, x in enumerate("abcdefghij")]
    turns = px.numbered_turns(table(spark, rows), texts=True)
    rebuilt, convs = px.rebuilt_turns(turns)
    trie = px.prefix_trie(rebuilt, convs)
    pieces = sorted((r.piece, r.ids) for r in trie.ends.where("depth = 10").collect())
    assert [i for _, ids in pieces for i in ids] == sorted(ids for _, p in pieces for ids in p) and len(pieces) >= 2
    last = {(r.conv_id, r.depth): (r.role, r.text) for r in px.last_turns(trie.nodes, rebuilt, turns).collect()}
    assert last[(-45, 10)] == ("user", "j") and last[(-45, 1)] == ("user", "a")
    assert len(last) == trie.nodes.where("depth > 0").count()


@pytest.mark.parametrize("ids", [[1], list(range(2500)), [-1500, -3, 0, 10 ** 15]])
def test_list_digests(spark, ids):
    rows = [(0, 1, 2, 3, 4, i - i % 1000, i) for i in ids]
    ends = spark.createDataFrame(rows, "depth long, k0 long, k1 long, k2 long, k3 long, piece long, i long").groupBy(
        *px.NODE, "piece").agg({"i": "collect_list"}).toDF(*px.NODE, "piece", "ids").selectExpr(*px.NODE, "piece", "sort_array(ids) AS ids")
    assert px.list_digests(ends).first().sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
