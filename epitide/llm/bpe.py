"""Byte-level BPE with forced boundaries: certain cuts first, then the fragments on their own."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern of byte-level vocabularies, with the letters, which are most frequent, first.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words encoded at a time, so that a very long text needs little more memory than its ids.
WORDS_AT_ONCE = 1 << 16
#: Known words of a Python worker, and known fragments, are forgotten when there are more than this.
KNOWN_AT_MOST, FRAGMENTS_AT_MOST = 400_000, 100_000
#: Longer words and fragments are not kept.
KNOWN_BYTES = 256
#: Longer fragments are merged with a heap.
SCANNED_BYTES = 128
#: Texts of an Arrow batch whose ids and decoded text leave the worker together, and their bytes (or one longer text).
TEXTS_AT_ONCE, BYTES_AT_ONCE = 250, 16 << 20


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in vocabulary files: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary; what a worker has encoded once it looks up afterwards."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int]):
        self.tokens, self.added = tokens, added
        self.rank = {(tokens[a], tokens[b]): i for i, (a, b) in enumerate(merges)}
        self.result = [tokens[a + b] for a, b in merges]
        none: dict[int, int] = {}
        self.after = [none] * (max(tokens.values()) + 1)
        for (a, b), i in self.rank.items():
            if self.after[a] is none:
                self.after[a] = {}
            self.after[a][b] = i
        self.single = [tokens[bytes([b])] for b in range(256)]
        self.inside = {pair for t in tokens for pair in zip(t, t[1:])}
        self.bytes_of: list[bytes] = [b""] * (max([*tokens.values(), *added.values()]) + 1)
        for t, i in tokens.items():
            self.bytes_of[i] = t
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") \
            if added else None
        self.words: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}
        self.pattern = regex.compile(PATTERN)

    @classmethod
    def of(cls, file: str) -> Vocabulary:
        """From the content of a file of the tokenizers library with a byte-level BPE model."""
        content = json.loads(file)
        model, letters = content["model"], byte_letters()
        if model["type"] != "BPE" or content["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls({raw(t): i for t, i in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges],
                   {t["content"]: t["id"] for t in content["added_tokens"]})

    def cuts(self, word: bytes) -> list[bytes]:
        """``word`` cut between bytes that are neighbours in no token: no merge ever spans such a cut."""
        inside = self.inside
        at = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])] if at else [word]

    def merged(self, fragment: bytes) -> bytes:
        """Ids of one fragment: the pair of lowest rank is merged wherever it occurs, until none is left.

        The ranks of the neighbours of a short fragment are scanned for each merge; a long one keeps them in order, see
        :meth:`merged_long`. The leftmost pair goes first, and a merge only makes pairs of later ranks.
        """
        if len(fragment) > SCANNED_BYTES:
            return self.merged_long(fragment)
        ids, after, never = [self.single[b] for b in fragment], self.after, len(self.result)
        ranks = [after[a].get(b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i] = new = self.result[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = after[new].get(ids[i + 1], never)
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(new, never)
        return b"".join([self.packed[i] for i in ids])

    def merged_long(self, fragment: bytes) -> bytes:
        """The same ids in n log n: a heap of (rank, place) over a linked list of the ids.

        The leftmost pair of the lowest rank is merged first, and the pairs that it makes join the heap. As a merge
        only makes pairs of later ranks, equal pairs are all merged from left to right before them.
        """
        ids, n = [self.single[b] for b in fragment], len(fragment)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = self.result[r], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (s := rank((ids[i], ids[k]))) is not None:
                    heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := rank((ids[h], ids[i]))) is not None:
                heappush(heap, (s, h))
        return b"".join([self.packed[i] for i in ids if i >= 0])

    def word(self, word: str) -> bytes:
        fragments, known = self.cuts(word.encode("utf-8", "surrogatepass")), self.fragments
        out = []
        for fragment in fragments:
            ids = known.get(fragment)
            if ids is None:
                ids = self.merged(fragment)
                if len(fragment) <= KNOWN_BYTES and len(fragments) > 1:  # a whole word is kept as such
                    known[fragment] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(word) <= KNOWN_BYTES:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.packed[self.added[part]])
                continue
            found = (m.group() for m in self.pattern.finditer(part)) if len(part) > 8 * WORDS_AT_ONCE else iter(
                self.pattern.findall(part))
            while chunk := list(islice(found, WORDS_AT_ONCE)):
                if len(self.words) > KNOWN_AT_MOST:
                    self.words.clear()
                if len(self.fragments) > FRAGMENTS_AT_MOST:
                    self.fragments.clear()
                known, new = self.words.get, self.word
                out.append(b"".join([known(w) or new(w) for w in chunk]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of token ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec(docs: DataFrame, path: str):
    """The vocabulary file at ``path``, read by the driver and broadcast; no executor needs the file."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast({"file": file.read()})


def loaded(vocabulary) -> Vocabulary:
    """The vocabulary of a broadcast file; built once in a worker, with all that it has encoded since."""
    shared = vocabulary.value
    if "built" not in shared:
        shared["built"] = Vocabulary.of(shared["file"])
    return shared["built"]


def encoder(vocabulary):
    """Column function: text to ids (binary, 4 bytes each). NULL is the empty text."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        v = loaded(vocabulary)
        return pa.array([v.encode(t.as_py() or "") for t in texts], pa.binary())

    return encode


def decoder(vocabulary):
    """Column function: ids (binary) to text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        v = loaded(vocabulary)
        return pa.array([v.decode(x.as_py() or b"") for x in ids], pa.string())

    return decode


def small(batch: pa.RecordBatch):
    """Slices of a batch of at most ``TEXTS_AT_ONCE`` texts and ``BYTES_AT_ONCE`` bytes, one text at least."""
    size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = (size[at - 1] if at else 0) + BYTES_AT_ONCE
        stop = min(at + TEXTS_AT_ONCE, max(at + 1, int(np.searchsorted(size, most, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def round_trip(vocabulary):
    """For ``mapInArrow``: rows of doc_id and text to doc_id, n_tokens, ids and decoded, a few texts at a time."""

    def run(batches):
        v = loaded(vocabulary)
        for batch in batches:
            for part in small(batch):
                ids = [v.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([v.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded for every document.

    Equal to the tokenizers library without added special tokens: strings of special tokens in a
    text are their ids. NULL and empty texts have no tokens. The work is inside the row, so no
    row is moved; a long word costs n log n, a text of any length goes alone; repeated rows, NULL ids and empty tables stay as they are, other columns are not
    read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(round_trip(codec(docs, path)), f"doc_id {kind}, n_tokens long, ids binary, decoded string")
