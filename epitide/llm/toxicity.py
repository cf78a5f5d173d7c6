"""Toxicity by a bidirectional gated recurrent network over words and their characters, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import free

#: Words of a window, and how far the next one starts: every word lies in two windows.
WINDOW, STRIDE = 32, 16
#: Width of the word and of the character input, and of the state in each direction.
WORD_DIM, CHAR_DIM, STATE = 8, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
#: Lengths of the byte sequences of a word that make its character input.
GRAMS = (3, 4, 5)
#: Bounds of the sample that the model is fitted on: documents of each class, and characters of one.
SAMPLE, SAMPLE_CHARS = 1000, 20_000
ROUNDS, BATCH, RATE = 8, 256, 0.02
#: A toxic text that scores less may be labelled wrongly.
DOUBTED = 0.3
#: Chances that the fit hides a word's own input, and its characters.
HIDDEN = np.array([0.3, 0.0])
#: A round takes at least so many steps, so that a small sample is gone through several times.
STEPS = 24
#: One window in so many is a word of a clean window repeated, so that junk does not look toxic.
REPEATED = 8
#: Documents and windows scored at a time.
DOCS_AT_ONCE, WINDOWS_AT_ONCE, WORDS_AT_ONCE, BYTES_AT_ONCE = 1000, 2048, 1 << 14, 1 << 23
EDGES = ".,;:!?|\"'()[]{}<>*_~`"


# words and windows -----------------------------------------------------------------------------


def vocabulary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the word number of each word of all texts, and the words of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    words = pc.utf8_trim(coded.dictionary, EDGES)
    empty = np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):  # a blank text splits into one empty word
        keep = ~np.isin(ids, empty)
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        counts, ids = np.bincount(owner, minlength=len(counts)), ids[keep]
    return words, ids, counts


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window its text, first word and number of words: overlapping, to the end of every text."""
    number = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    number[counts == 0] = 0
    text = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = np.repeat(np.cumsum(counts) - counts, number) + nth * STRIDE
    return text, first, np.minimum(WINDOW, np.repeat(counts, number) - nth * STRIDE)


def laid_out(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Word numbers, one column for each window; ``pad`` behind the end of a text."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    return np.where(np.arange(WINDOW)[:, None] < size[None, :], ids[np.minimum(at, max(len(ids) - 1, 0))], pad)


@dataclass
class Features:
    """Rows of the two input tables for each word: one of the word itself, and from ``starts`` on in ``gram``
    one for each of its byte sequences."""

    word: np.ndarray
    gram: np.ndarray
    starts: np.ndarray
    weight: np.ndarray

    def subset(self, words: np.ndarray) -> Features:
        """Features of some words, in the given order."""
        size = np.diff(self.starts)[words]
        starts = np.concatenate([[0], np.cumsum(size)])
        gram = self.gram[np.repeat(self.starts[words] - starts[:-1], size) + np.arange(starts[-1])]
        return Features(self.word[words], gram, starts, self.weight[words])


def features(words: pa.Array) -> Features:
    marked = pc.binary_join_element_wise("^", words, "$", "").cast(pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset:marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    left = np.repeat(offsets[1:], length) - np.arange(len(data))
    rows = np.zeros((len(data), len(GRAMS)), dtype=np.int32)
    rolling = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling *= np.uint64(0x100000001B3)
        rolling += np.uint64(1)
        rolling[:max(len(data) - n + 1, 0)] += data[n - 1:]
        if n in GRAMS:
            rows[:, GRAMS.index(n)] = (rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
    fits = left[:, None] >= np.array(GRAMS)[None, :]
    starts = np.concatenate([[0], np.cumsum(fits.sum(axis=1))])[offsets]
    powers = np.cumprod(np.full(int(length.max(initial=1)), 0x100000001B3, dtype=np.uint64))
    total = np.zeros(len(words), dtype=np.uint64)
    if len(words):
        data += np.uint64(1)
        data *= powers[np.arange(len(data)) - np.repeat(offsets[:-1], length)]
        total = np.add.reduceat(data, offsets[:-1])
    word = ((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int32)
    weight = 1 / np.sqrt(np.maximum(1, np.diff(starts)))
    return Features(word, rows[fits], starts, weight.astype(np.float32))


# network ---------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights: input tables, input and state weights of both directions, attention, output."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        width = WORD_DIM + CHAR_DIM
        return cls({
            "words": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "chars": normal(CHAR_ROWS, CHAR_DIM, scale=0.1),
            "input": normal(width, 6 * STATE, scale=width ** -0.5), "bias": np.zeros(6 * STATE, np.float32),
            "ahead": normal(STATE, 3 * STATE, scale=STATE ** -0.5), "back": normal(STATE, 3 * STATE, scale=STATE ** -0.5),
            "attend": normal(2 * STATE, scale=0.3), "out": normal(2 * STATE, scale=0.3), "out_bias": np.zeros(1, np.float32),
        })

    def inputs(self, f: Features) -> np.ndarray:
        w, size = self.weights, np.diff(f.starts)
        chars = np.zeros((len(f.word), CHAR_DIM), np.float32)
        for a in range(0, len(size), WORDS_AT_ONCE):
            full = a + np.flatnonzero(size[a:a + WORDS_AT_ONCE])
            if len(full):
                low, high = f.starts[a], f.starts[min(a + WORDS_AT_ONCE, len(size))]
                chars[full] = np.add.reduceat(w["chars"][f.gram[low:high]], f.starts[full] - low, axis=0)
        return np.concatenate([w["words"][f.word], chars * f.weight[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input part of all gates for each word, and a last row for padding, which leaves a state as it is."""
        g = np.zeros((len(x) + 1, 6 * STATE), np.float32)
        np.matmul(x, self.weights["input"], out=g[:-1])
        g[:-1] += self.weights["bias"]
        g[-1, :STATE] = g[-1, 3 * STATE:4 * STATE] = -30
        return g

    def run(self, g: np.ndarray, ids: np.ndarray, keep: list | None = None) -> tuple:
        """States of all words of the windows ``ids``, attention over them, and a score for each window."""
        w, n, s = self.weights, ids.shape[1], STATE
        states = np.empty((WINDOW, n, 2 * s), np.float32)
        for side, u in enumerate((w["ahead"], w["back"])):
            h = np.zeros((n, s), np.float32)
            part = np.ascontiguousarray(g[:, 3 * s * side:3 * s * (side + 1)])
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                x, hu = part[ids[t]], h @ u
                zr = sigmoid(x[:, :2 * s] + hu[:, :2 * s])
                z, r = zr[:, :s], zr[:, s:]
                new = np.tanh(x[:, 2 * s:] + r * hu[:, 2 * s:])
                if keep is not None:
                    keep.append((side, t, h, z, r, new, hu[:, 2 * s:]))
                h = h + z * (new - h)
                states[t, :, s * side:s * (side + 1)] = h
        logits = states @ w["attend"]
        logits[ids == len(g) - 1] = -1e9
        logits -= logits.max(axis=0)
        a = np.exp(logits)
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, states)
        return states, a, pooled, sigmoid(pooled @ w["out"] + w["out_bias"][0])

    def score(self, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.run(g, ids)[3]

    def gradients(self, f: Features, ids: np.ndarray, label: np.ndarray, seen: np.ndarray) -> dict:
        """Of the log loss of the windows ``ids``; input tables as (rows, gradients of the rows).

        ``seen``: 1 or 0 for each input of each word, so that no single input is relied on.
        """
        w, s, n = self.weights, STATE, ids.shape[1]
        x = self.inputs(f) * seen
        g, keep = self.gates(x), []
        states, a, pooled, p = self.run(g, ids, keep)
        dlogit = ((p - label) / n).astype(np.float32)
        dpool = dlogit[:, None] * w["out"]
        da = np.einsum("nk,tnk->tn", dpool, states)
        datt = a * (da - (a * da).sum(axis=0))
        dstates = a[:, :, None] * dpool + datt[:, :, None] * w["attend"]
        out = {"out": pooled.T @ dlogit, "out_bias": dlogit.sum(keepdims=True), "attend": np.einsum("tn,tnk->k", datt, states),
               "ahead": np.zeros_like(w["ahead"]), "back": np.zeros_like(w["back"])}
        dg = np.zeros_like(g)
        dh = np.zeros((n, s), np.float32)
        for i in range(len(keep) - 1, -1, -1):
            side, t, h, z, r, new, hn = keep[i]
            name = ("ahead", "back")[side]
            if t == (WINDOW - 1, 0)[side]:
                dh = np.zeros((n, s), np.float32)
            dh = dh + dstates[t, :, s * side:s * (side + 1)]
            dnew = dh * z * (1 - new * new)
            dz = dh * (new - h) * z * (1 - z)
            dr = dnew * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dnew * r], axis=1)
            np.add.at(dg[:, 3 * s * side:3 * s * (side + 1)], ids[t], np.concatenate([dz, dr, dnew], axis=1))
            out[name] += h.T @ dhu
            dh = dh * (1 - z) + dhu @ w[name].T
        dg = dg[:-1]
        out["input"], out["bias"] = x.T @ dg, dg.sum(axis=0)
        dx = dg @ w["input"].T * seen
        out["words"] = (f.word, dx[:, :WORD_DIM])
        out["chars"] = (f.gram, np.repeat(dx[:, WORD_DIM:] * f.weight[:, None], np.diff(f.starts), axis=0))
        return out


class Adaptive:
    """Steps by the accumulated squares of each weight's gradients."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate = weights, rate
        self.squares = {k: np.full_like(v, 1e-8) for k, v in weights.items()}
        self.mean = {k: np.zeros_like(v) for k, v in weights.items() if k not in ("words", "chars")}
        self.steps = 0

    def step(self, gradients: dict) -> None:
        self.steps += 1
        for name, g in gradients.items():
            w, q = self.weights[name], self.squares[name]
            if name in self.mean:
                m = self.mean[name]
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                w -= 0.5 * self.rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(q / (1 - 0.99 ** self.steps)) + 1e-6)
            else:
                rows, inverse = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), w.shape[1]), np.float32)
                np.add.at(total, inverse, g[1].astype(np.float32))
                q[rows] += total * total
                w[rows] -= 4 * self.rate * total / np.sqrt(q[rows] + 1e-12)


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Network:
    """A network fitted so that the highest window score of a text tells its label.

    Labels belong to texts, so windows are chosen in rounds: at first all windows count as their text
    is labelled; from then on the windows of the toxic texts that score highest, and of the other
    texts those that score highest and one by chance. Once most toxic texts are found, those that
    score below DOUBTED sit out the round: wrong labels should not be learned by heart.
    """
    rng, net = np.random.default_rng(seed), Network.fresh(seed)
    words, ids, counts = vocabulary(texts)
    text, first, size = windows(counts)
    f = features(words)
    adaptive = Adaptive(net.weights, RATE)
    toxic = labels[text] == 1
    for turn in range(rounds):
        g = net.gates(net.inputs(f))
        scores = np.concatenate([net.score(g, laid_out(ids, first[a:a + WINDOWS_AT_ONCE], size[a:a + WINDOWS_AT_ONCE], len(words)))
                                 for a in range(0, len(text), WINDOWS_AT_ONCE)]) if turn else rng.random(len(text))
        order = np.lexsort((-scores, text))
        nth = np.empty(len(text), dtype=np.int64)
        starts = np.searchsorted(text[order], np.arange(len(counts)))
        nth[order] = np.arange(len(text)) - starts[text[order]]
        lucky = rng.random(len(text)) < 1 / np.maximum(1, np.bincount(text, minlength=len(counts)))[text]
        top = 4 if turn == 0 else 2 if turn < rounds // 2 else 1
        best = np.zeros(len(counts))
        np.maximum.at(best, text, scores)
        trusted = (best >= DOUBTED)[text] if turn >= 2 and (best[labels == 1] >= DOUBTED).mean() > 0.5 else True
        chosen = np.flatnonzero(np.where(toxic, (nth < top) & trusted, (nth < top) | lucky))
        batch = min(BATCH, max(32, len(chosen) // 8))
        passes = max(1, -(-STEPS * batch // len(chosen)))
        order = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for a in range(0, len(order), batch):
            part = order[a:a + batch]
            grid, label = laid_out(ids, first[part], size[part], len(words)), labels[text[part]]
            clean = grid[:, label == 0]
            if clean.size:  # one word of a clean window, over and over
                again = rng.integers(0, clean.shape[1], len(part) // REPEATED + 1)
                grid = np.concatenate([grid, np.repeat(clean[:1, again], WINDOW, axis=0)], axis=1)
                label = np.concatenate([label, np.zeros(len(again), dtype=label.dtype)])
            used = np.unique(grid[grid < len(words)])
            local = np.searchsorted(used, grid)
            local[grid == len(words)] = len(used)
            seen = np.repeat(rng.random((len(used), 2)) > HIDDEN, (WORD_DIM, CHAR_DIM), axis=1).astype(np.float32)
            adaptive.step(net.gradients(f.subset(used), local, label, seen))
    return net


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The highest score of all windows of each text; 0 for a text without words."""
    out = np.zeros(len(texts))
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    bound = np.cumsum(size)
    at = 0
    while at < len(texts):
        done = bound[at - 1] if at else 0
        stop = min(at + DOCS_AT_ONCE, max(at + 1, int(np.searchsorted(bound, done + BYTES_AT_ONCE, side="right"))))
        words, ids, counts = vocabulary(pc.fill_null(texts[at:stop], ""))
        if len(ids):
            g = net.gates(net.inputs(features(words)))
            text, first, length = windows(counts)
            for a in range(0, len(text), WINDOWS_AT_ONCE):
                b = min(a + WINDOWS_AT_ONCE, len(text))
                np.maximum.at(out, at + text[a:b], net.score(g, laid_out(ids, first[a:b], length[a:b], len(words))))
        at = stop
    return out


# Spark -----------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
          rounds: int = ROUNDS, seed: int = 1, text: str = "text", doc_id: str = "doc_id", label: str = "toxic"):
    """The weights of a network fitted on labelled documents that are not held out, broadcast.

    At most ``sample`` documents of each class are used, those with the smallest hashes of their ids,
    and none of more than ``sample_chars`` characters: the fit, one task of its own, needs the same
    memory and time on any corpus. Rows without id, text or label teach nothing. If one class is missing, the weights
    are None and every score is 0.
    """
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    short = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(
        F.col("_text").isNotNull() & (F.char_length("_text") <= sample_chars))
    with_text = marked.join(short.select("_id").distinct(), "_id", "left_semi")
    rank = F.xxhash64(F.col("_id"), F.lit(seed))
    picked = None
    for value in (0, 1):
        some = with_text.where(F.col("_label") == value).orderBy(rank, "_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    rows = short.join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))

    def fitted(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("_id")
        y = sample["_label"].to_numpy()
        weights = fit(sample["_text"].combine_chunks(), y, rounds, seed).weights if len(np.unique(y)) == 2 else {}
        return pa.table({"name": pa.array(list(weights), pa.string()),
                         "shape": pa.array([list(v.shape) for v in weights.values()], pa.list_(pa.int32())),
                         "content": pa.array([v.astype("<f4").tobytes() for v in weights.values()], pa.binary())})

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fitted, "name string, shape array<int>, content binary").collect()
    weights = {r["name"]: np.frombuffer(r["content"], dtype="<f4").reshape(r["shape"]) for r in found}
    return docs.sparkSession.sparkContext.broadcast(weights or None)


def scorer(model):
    """Column function: text to score. NULL and blank texts score 0."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights = model.value
        return pa.array(np.zeros(len(texts)) if weights is None else np.clip(score_texts(Network(weights), texts), 0, 1))

    return score


def toxicity(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of every document: the highest score of its overlapping windows.

    Only the text is an input. Repeated rows and rows without doc_id are scored like any other, an empty
    table gives an empty one, other columns are not read. A document of any length is
    scored window by window over its whole text.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))


def drop_toxic(docs: DataFrame, model, reject: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``reject`` or more, columns as they were, whatever their names."""
    score, = free(docs, "_score")
    return docs.withColumn(score, scorer(model)(F.col(text))).where(F.col(score) < reject).drop(score)
