"""Fill-in-middle texts by displacement scatter: cuts, shifts of every byte, one scatter, one gather back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts worked on at a time (a longer text goes alone), and bytes whose shifts are summed at a time.
BYTES_AT_ONCE, WINDOW = 8 << 20, 1 << 20

#: The marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = len(PREFIX)

#: Order of the parts of a text (0 prefix, 1 middle, 2 suffix) and their marks, by form.
LAID = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
FORMS = ("plain", "psm", "spm")


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:doc_id``; a NULL id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts (and the last one ends)."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)),
                                                                    pa.py_buffer(data)])


def moved(source: np.ndarray, starts: np.ndarray, shifts: np.ndarray, target: np.ndarray, gather: bool = False) -> None:
    """Copy runs of bytes that all have a shift of their own.

    Run i begins at ``starts[i]`` (ascending) and lasts to the next one; its bytes belong ``shifts[i]`` further on.
    The difference array holds the change of the shift at each start, its cumulative sum the shift of every byte;
    the sum is carried from window to window, so it never needs more than ``WINDOW`` places. ``gather`` reads
    the other way round: byte j of ``target`` comes from ``source[j + shift]``.
    """
    size, carry = len(target) if gather else len(source), 0
    steps = np.diff(shifts, prepend=0)
    for a in range(0, size, WINDOW):
        b = min(size, a + WINDOW)
        i, j = np.searchsorted(starts, (a, b))
        change = np.zeros(b - a, dtype=np.int64)
        np.add.at(change, starts[i:j] - a, steps[i:j])
        change[0] += carry
        shift = np.cumsum(change)
        carry = shift[-1]
        place = np.arange(a, b) + shift
        if gather:
            target[a:b] = source[place]
        else:
            target[place] = source[a:b]


def places(data: np.ndarray, ends: np.ndarray, mark: str) -> np.ndarray:
    """Where ``mark`` first stands in each text, -1 if nowhere."""
    out = np.full(len(ends) - 1, -1, dtype=np.int64)
    m = np.frombuffer(mark.encode(), dtype=np.uint8)
    if len(data) >= len(m):
        at = np.flatnonzero(data[:len(data) - len(m) + 1] == m[0])
        for k in range(1, len(m)):
            at = at[data[at + k] == m[k]]
        of = np.searchsorted(ends, at, side="right") - 1
        inside = at + len(m) <= ends[of + 1]
        of, first = np.unique(of[inside], return_index=True)
        out[of] = at[inside][first]
    return out


def runs(form: np.ndarray, cut: np.ndarray, ends: np.ndarray):
    """Starts of the three parts of every text, where they begin in the output, ends of the outputs, places of the marks."""
    added = np.where(form > 0, 3 * MARK, 0)
    out_ends = ends + np.concatenate([[0], np.cumsum(added)])
    part = [(ends[:-1], cut[:, 0]), (cut[:, 0], cut[:, 1]), (cut[:, 1], ends[1:])]
    begin = np.tile(out_ends[:-1, None], (1, 3))
    marks = []
    for f, name in enumerate(FORMS):
        rows = np.flatnonzero(form == f)
        at = out_ends[:-1][rows].copy()
        if name == "plain":
            for p in range(3):
                begin[rows, p] = at
                at = at + part[p][1][rows] - part[p][0][rows]
            continue
        for p, mark in LAID[name]:
            marks.append((at.copy(), mark))
            begin[rows, p] = at + MARK
            at = at + MARK + part[p][1][rows] - part[p][0][rows]
    starts = np.stack([a for a, _ in part], axis=1)
    return starts, begin, out_ends, marks


def chosen(starts: np.ndarray, shifts: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without the empty ones, whose start is also that of the next."""
    full = (stop > starts).ravel()
    return starts.ravel()[full], shifts.ravel()[full]


def transform(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int):
    """Outputs of a slice of texts: output texts, n, form, prefix_chars, middle_chars."""
    data, ends = flat(texts)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, ends)
    n = np.diff(first)
    low, high = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
    heads = np.append(heads, len(data))
    form = np.where(h[2] % 100 >= rate, 0, np.where(h[3] % 100 < spm, 2, 1))
    form[n == 0] = 0
    for mark in (PREFIX, SUFFIX, MIDDLE):
        form[places(data, ends, mark) >= 0] = 0
    cut = np.stack([heads[first[:-1] + low], heads[first[:-1] + high]], axis=1)
    starts, begin, out_ends, marks = runs(form, cut, ends)
    out = np.empty(out_ends[-1], dtype=np.uint8)
    stop = np.stack([cut[:, 0], cut[:, 1], ends[1:]], axis=1)
    moved(data, *chosen(starts, begin - starts, stop), out)
    for at, mark in marks:
        for k, byte in enumerate(mark.encode()):
            out[at + k] = byte
    return strings(out, out_ends), n, form, low, high - low


def inverse(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts behind the outputs, from the outputs and their forms alone."""
    data, ends = flat(outputs)
    size = np.diff(ends) - np.where(form > 0, 3 * MARK, 0)
    text_ends = np.concatenate([[0], np.cumsum(size)])
    p, s, m = (places(data, ends, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    stop = {"psm": (s, m, ends[1:]), "spm": (m, p, ends[1:])}
    begin, length = np.zeros((len(size), 3), np.int64), np.zeros((len(size), 3), np.int64)
    for f, name in enumerate(FORMS):
        rows = np.flatnonzero(form == f)
        if name == "plain":
            begin[rows, 0], length[rows, 0] = ends[:-1][rows], size[rows]
            continue
        prefix_end, suffix_end, middle_end = (x[rows] for x in stop[name])
        for k, (at, end) in enumerate(((p, prefix_end), (m, middle_end), (s, suffix_end))):
            begin[rows, k] = at[rows] + MARK
            length[rows, k] = end - begin[rows, k]
    starts = text_ends[:-1, None] + np.cumsum(length, axis=1) - length
    out = np.empty(text_ends[-1], dtype=np.uint8)
    moved(data, *chosen(starts, begin - starts, starts + length), out, gather=True)
    return strings(out, text_ends)


def slices(texts: pa.Array):
    """Ranges of rows of at most ``BYTES_AT_ONCE`` bytes, one row at least."""
    size = np.cumsum(np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + BYTES_AT_ONCE, side="right")))
        yield at, stop
        at = stop


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    The text is cut at two places, each drawn evenly over its n + 1 places between code points, from the SHA-256 of
    ``seed`` and doc_id: every run gives the same cuts, wherever a row lies. ``rate`` in 100 texts are reordered,
    ``spm`` in 100 of these suffix first. Texts that are empty, or hold a mark, stay as they are (form ``plain``,
    prefix_chars and middle_chars NULL).

    A NULL text counts as empty; a NULL doc_id draws from the seed alone. Repeated rows are rows of their own; an
    empty table gives an empty table; other columns are not read. Rows stay in their partition, nothing is shuffled;
    a worker holds a slice of 8 MB of texts and its outputs (or one longer text).
    """
    numbers = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col(doc_id), seed))]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                h = [part.column(f"h{i}").to_numpy() for i in range(4)]
                out, n, form, prefix, middle = transform(part.column("text"), h, rate, spm)
                plain = pa.array(form == 0)
                empty = pa.scalar(None, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(np.array(FORMS)[form]),
                     pa.compute.if_else(plain, empty, pa.array(prefix, pa.int64())),
                     pa.compute.if_else(plain, empty, pa.array(middle, pa.int64())), out.cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *numbers)
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(formatted: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """The rows of ``formatted`` with the text that each output was made from, worked out from output and form alone.

    Every other column stays. A NULL output gives the empty text; a NULL form counts as ``plain``; an empty table
    gives an empty table. A column named ``restored`` is replaced.
    """
    rows = formatted.drop(restored)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{restored}` string"
    names = rows.columns

    def run(batches):
        for batch in batches:
            filled = pa.compute.fill_null(batch.column(names.index(output)), "")
            forms = pa.compute.fill_null(pa.compute.index_in(batch.column(names.index(form)), value_set=pa.array(FORMS)), 0)
            for a, b in slices(filled):
                text = inverse(filled.slice(a, b - a), forms.slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text.cast(pa.string())], [*names, restored])

    return rows.mapInArrow(run, schema)
