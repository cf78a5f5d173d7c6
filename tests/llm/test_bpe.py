import numpy as np
import public_tokenizers
import pytest
from helpers import docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epitide.llm.bpe import Vocabulary, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return Vocabulary.of(file.read())


TEXTS = ["", " ", "Hello  world\n\n\t x", "don't we'll I'm they'RE it''s", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
         "<|endoftext", "日本語 テキスト ñandú ß é", "😀👩‍👩‍👧 ​ x 　y", "\x00\x01\x1c\x1d\x85 z", "1234567 ½ ²x",
         "a" * 5000, " " * 5000 + "x", "\n" * 999, "ab" * 3000, "ſtrange Kelvin", "word " * 20_000]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aetsn 's\n\t.,01é<|>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_any_text_like_the_library(library, own, text):
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=20))
def test_any_ids_decode_like_the_library(library, own, ids):
    assert own.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_cut(own):
    for token in list(own.tokens)[:5000]:
        assert own.cuts(token) == [token]
    assert own.cuts("qzxjqzx".encode()) != ["qzxjqzx".encode()]


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr("epitide.llm.bpe.KNOWN_AT_MOST", 3)
    monkeypatch.setattr("epitide.llm.bpe.WORDS_AT_ONCE", 5)
    text = "one two three four five six seven eight nine ten " * 30
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    table = docs(spark, [*TEXTS, None, "twice", "twice"], [*range(len(TEXTS)), None, 7, 7])
    out = encode_documents(table, PATH).collect()
    assert len(out) == len(TEXTS) + 3
    for r, t in zip(sorted(out, key=lambda r: r.decoded), sorted([*TEXTS, "", "twice", "twice"])):
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.decoded == t and np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.n_tokens == len(ids)
    assert encode_documents(docs(spark, []), PATH).count() == 0


def test_long_words_equal_the_library_and_take_no_square_of_time():
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from epitide.llm import bpe
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary, library = bpe.Vocabulary.of(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    rng = random.Random(8)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("a", "ab", "thequickbrown", "éßöab", "etaoinshrdlu")
             for n in (3, 127, 129, 500, 4000)]
    for word in words:
        assert np.frombuffer(vocabulary.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    assert all(vocabulary.merged_long(w.encode()) == b"".join(map(vocabulary.merged, [w.encode()[:128]])) for w in ["the" * 40, "ab", "a"])
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    start = time.time()
    ids = vocabulary.encode(long)
    assert time.time() - start < 30
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(long, add_special_tokens=False).ids
    assert long not in vocabulary.words and vocabulary.decode(ids) == long


def test_slices_by_bytes(monkeypatch):
    import pyarrow as pa

    from epitide.llm import bpe
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 4, None, "b" * 40, "", "c" * 5, "d" * 5, "e"]})
    assert [part.column("text").to_pylist() for part in bpe.small(batch)] == [["aaaa", None], ["b" * 40, "", "ccccc", "ddddd"][:1], ["", "ccccc", "ddddd"], ["e"]]
