"""Suffix-array dedup: suffixes at minimiser positions, sorted, windows compared among those that begin alike."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import text_key
from epitide.llm.repeats import GRAM, NO_ID, names, scan, slices
from epitide.session import cut

#: A repeat of a text (``piece`` NULL), or of a piece of a group that goes on elsewhere: a window with its smallest
#: (``earlier``) and largest (``stop``) id, or a text (id in ``earlier``) with the digests of its windows from ``start`` on.
FOUND = "key string, start long, stop long, earlier long, piece long, window binary, windows binary"
FOUND_ARROW = pa.schema([("key", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("earlier", pa.int64()),
                         ("piece", pa.int64()), ("window", pa.binary()), ("windows", pa.binary())])
REPEATS = "key string, start long, stop long, earlier long"
REPEATS_ARROW = pa.schema([(c, FOUND_ARROW.field(c).type) for c in ("key", "start", "stop", "earlier")])
#: A group of suffixes with more windows than this is cut into pieces, which are compared with each other.
WINDOWS_AT_ONCE = 1 << 17
#: Windows of a text that one row holds at most, and bytes and rows of a batch.
WINDOWS_A_ROW, BATCH_BYTES, BATCH_ROWS = 512, 1 << 23, 10_000
#: Pieces that a task may number.
PIECES = 1 << 32
DIGEST = 16
SPANS = "array<struct<start:bigint,stop:bigint>>"


def sparse_suffixes(length: int, gram: int):
    """For ``mapInArrow``: the wanted minimiser positions of a text, with the words around them.

    Every wanted window belongs to the first position in it. ``left`` and ``right`` are the words before
    and from the position that its windows reach, so that each window of the text is in one suffix; ``right`` ends with a
    space, so that suffixes with equal first words stand together in the order of bytes.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = {c: [] for c in ("key", "id", "pos", "right", "left")}
                for key, number, text, wanted in zip(*(part.column(c).to_pylist() for c in ("key", "id", "text", "runs"))):
                    words = (text or "").encode().split()
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
                    grams = names(hashes, gram, gram).view(np.int64)
                    for r in wanted:
                        first, stop = r["first"], r["first"] + r["count"]
                        low = first
                        for p in (first + np.flatnonzero(grams[first:stop + length - gram] == r["name"])).tolist():
                            high = min(p, stop - 1)
                            if low > high:
                                break
                            for c, v in (("key", key), ("id", number), ("pos", p), ("right", b" ".join(words[p:high + length]).decode() + " "),
                                         ("left", b" ".join(words[low:p]).decode())):
                                out[c].append(v)
                            low = p + 1
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("key", pa.string()), ("id", pa.int64()), ("pos", pa.int64()), ("right", pa.string()), ("left", pa.string())]))

    return run


def common(a: list[str], b: list[str]) -> int:
    """Number of equal words at the start of both."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def runs(key: str, number: int, found: list[tuple[int, bytes]], least: dict[bytes, int], length: int):
    """Repeats (key, start, stop, earlier) of a text: of the windows given in order, those whose smallest id is below its own, joined where they follow each other."""
    start = stop = earlier = None
    for at, digest in found:
        first = least.get(digest, number)
        if first < number:
            if stop is not None and at == stop - length + 1:
                stop, earlier = at + length, min(earlier, first)
                continue
            if stop is not None:
                yield key, start, stop, earlier
            start, stop, earlier = at, at + length, first
    if stop is not None:
        yield key, start, stop, earlier


def neighbours(length: int, gram: int, at_once: int = WINDOWS_AT_ONCE):
    """For ``mapInArrow`` over one range of the sorted suffixes: windows that a smaller id has as well.

    Neighbours that agree in ``gram`` words form a group; equal windows are in one group. A window that
    reaches further to the right than either neighbour agrees is unique. Of the others the smallest
    id of each is taken by a 128-bit digest of its words, whatever stands between its holders. Groups that may go on in another
    range, the first and the last, and groups of more than ``at_once`` windows are given in pieces of about
    that size: each different window once, with its ids reduced to two, and the windows of each text. :func:`sorted_matches`
    compares the windows of the pieces.

    A text whose words recur has many suffixes in one group: their windows are joined before anything is given, so
    that rows go by the texts of a group and not by its suffixes.
    """

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "id", "pos", "right", "left")))

    def groups(batches):
        """Of each suffix: whether it begins a group, and the words in which the nearer of its neighbours agrees."""
        held, before, begins = None, None, True
        for row in rows(batches):
            words = row[3].split(" ")[:-1]
            if held is not None:
                agree = common(held[1], words)
                yield held[0], begins, length if before is None else max(before, agree)
                before, begins = agree, agree < gram
            held = row, words
        if held is not None:
            yield held[0], begins, length

    def windows(row, agree):
        """Start and digest of the windows of a suffix with at most ``agree`` words from its position on."""
        key, number, pos, right, left = row
        whole = (f"{left} {right}" if left else right).encode()
        offset = [0, *accumulate(len(w) + 1 for w in whole[:-1].split(b" "))]
        n = left.count(" ") + 1 if left else 0
        return [(pos - n + i, xxhash.xxh3_128_digest(whole[offset[i]:offset[i + length] - 1]))
                for i in range(min(len(offset) - length, n + agree - length + 1))]

    def repeats(group):
        least = {}
        for (_, number), found in group.items():
            for digest in found.values():
                if number < least.get(digest, NO_ID + 1):
                    least[digest] = number
        for (key, number), found in group.items():
            for r in runs(key, number, sorted(found.items()), least, length):
                yield *r, None, None, None

    def stretches(found):
        """Start and digests of windows that follow each other."""
        start, digests = None, []
        for at, digest in sorted(found.items()):
            if digests and (at != start + len(digests) or len(digests) == WINDOWS_A_ROW):
                yield start, b"".join(digests)
                digests = []
            if not digests:
                start = at
            digests.append(digest)
        yield start, b"".join(digests)

    def left_open(group, piece):
        ends = {}
        for (key, number), found in group.items():
            for digest in found.values():
                low, high = ends.get(digest, (number, number))
                ends[digest] = min(low, number), max(high, number)
            for start, digests in stretches(found):
                yield key, start, None, number, piece, None, digests
        for digest, (low, high) in ends.items():
            yield None, None, high, low, piece, digest, None

    def found(batches):
        task = TaskContext.get()
        piece = (task.partitionId() if task else 0) * PIECES
        group, size, is_open, first = {}, 0, True, True
        for row, begins, agree in groups(batches):
            if begins and not first:
                yield from left_open(group, piece) if is_open else repeats(group)
                group, size, is_open, piece = {}, 0, False, piece + 1
            first = False
            mine = windows(row, agree)
            if mine:
                group.setdefault(row[:2], {}).update(mine)
                size += len(mine)
            if size > at_once:
                yield from left_open(group, piece)
                group, size, is_open, piece = {}, 0, True, piece + 1
        yield from left_open(group, piece)

    def run(batches):
        out, size = {c: [] for c in FOUND_ARROW.names}, 0
        for row in found(batches):
            for c, v in zip(out, row):
                out[c].append(v)
            size += len(row[-1] or b"")
            if len(out["key"]) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict(out, schema=FOUND_ARROW)
                out, size = {c: [] for c in FOUND_ARROW.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=FOUND_ARROW)

    return run


def marked(length: int):
    """For ``mapInArrow`` over rows sorted by piece, the windows that several ids have (with the smallest) ahead of the texts: repeats.

    Texts stream by; only the windows of one piece are held.
    """

    def run(batches):
        piece, first = None, {}
        for batch in batches:
            out = []
            for at, window, key, start, number, digests in zip(
                    *(batch.column(c).to_pylist() for c in ("piece", "window", "key", "start", "earlier", "windows"))):
                if at != piece:
                    piece, first = at, {}
                if window is not None:
                    first[window] = number
                elif first:
                    found = [(start + i // DIGEST, digests[i:i + DIGEST]) for i in range(0, len(digests), DIGEST)]
                    out.extend(runs(key, number, found, first, length))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(REPEATS_ARROW.names, map(list, zip(*out)))), schema=REPEATS_ARROW)

    return run


def sorted_matches(suffixes: DataFrame, length: int, gram: int) -> DataFrame:
    """key, start, stop, earlier: repeats in the global order of the suffixes, cut into ranges.

    Ranges follow the suffixes themselves, so a minimiser with a third of all suffixes is cut like any other. Of
    groups that one range may not hold alone, a piece has each different window once, however many suffixes
    hold it: these meet in an aggregate, and the smallest ids go back to the pieces, which mark the windows of their own texts. A
    piece has no more than about ``WINDOWS_AT_ONCE`` windows, so that what meets in one task is bounded.
    """
    order = ["right", "left", "id", "key", "pos"]
    laid = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(laid.mapInArrow(neighbours(length, gram), FOUND), "ranges")
    windows = found.where("window IS NOT NULL").select("piece", "window", "earlier", "stop")
    earliest = cut(windows.groupBy("window").agg(F.min("earlier").alias("least"), F.max("stop").alias("most"))
                   .where("least < most").select(F.col("window").alias("w"), "least"), "earliest")
    back = windows.join(earliest, F.col("window") == F.col("w")).where("least < stop").select("piece", "window", F.col("least").alias("earlier"))
    text_rows = found.where("windows IS NOT NULL").select("piece", "key", "start", "earlier", "windows")
    stream = back.unionByName(text_rows, allowMissingColumns=True).repartition("piece").sortWithinPartitions("piece", F.col("window").isNull())
    across = stream.mapInArrow(marked(length), REPEATS)
    return found.where("piece IS NULL").select("key", "start", "stop", "earlier").unionByName(across)


def suffix_repeats(docs: DataFrame, length: int = 50, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_repeated, spans, earlier_doc_id: passages of ``length`` words or more seen before.

    A text's suffixes are kept at minimiser positions only: where a sequence of ``gram`` words has the smallest
    hash of a window of ``length`` words. Equal passages of that length have a minimiser in common.
    Positions whose sequence occurs in one text only are dropped. The others are sorted by the words to
    the right; suffixes that begin alike stand together, and among them every window of ``length`` words around the
    position is compared by its whole words. So a word is in a span if and only if a window that covers it also starts in a document
    of smaller id, and ``earlier_doc_id`` is the smallest id that has one of the windows.

    Of equal texts only the smallest id is looked at; the others, if long enough, are whole repeats. NULL and
    blank texts have no words. Documents without id come last and are not repeats of each other. Repeated
    rows of one id neither. An empty table gives an empty one; other columns are not read.
    """
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    source = docs.select(F.col(doc_id).alias("doc_id"), ids.alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(
        scan(length, gram), f"doc_id {kind}, id long, key string, n_words long, whole string, "
                            "runs array<struct<name:bigint,first:int,count:int>>"), "rows")
    texts = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.first("runs").alias("runs")), "texts")
    named = texts.select("key", "least", F.explode("runs").alias("r"))
    short = F.xxhash64("key")
    twice = (named.groupBy(F.col("r.name").alias("name")).agg(F.min(short).alias("a"), F.max(short).alias("b"))
             .where("a <> b").select("name"))
    wanted = (named.select("key", "least", "r.name", "r.first", "r.count").join(twice, "name")
              .groupBy("key", "least").agg(F.collect_list(F.struct("name", "first", "count")).alias("runs")))
    suspects = source.select("key", "id", "text").join(
        wanted.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("least"))).select("key", "id", "text", "runs")
    suffixes = cut(suspects.mapInArrow(
        sparse_suffixes(length, gram), "key string, id long, pos long, right string, left string"), "suffixes")
    found = cut(sorted_matches(suffixes, length, gram).groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("parts"), F.min("earlier").alias("earlier")), "found")

    def add(done, x):
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (last["stop"] >= x["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    info = cut(texts.select("key", "least").join(found, "key", "left").select(
        "key", "least", F.aggregate(F.coalesce("parts", F.array().cast(SPANS)), F.array().cast(SPANS), add).alias("spans"), "earlier"), "info")
    joined = rows.drop("runs", "whole").join(info, "key")
    copy = (F.col("id") > F.col("least")) & (F.col("n_words") >= length)
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    spans = F.when(copy, every).otherwise(F.col("spans"))
    return joined.select(
        "doc_id", "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]).alias("n_repeated"),
        spans.alias("spans"), F.when(copy, F.least("least", "earlier")).otherwise(F.col("earlier")).alias("earlier_doc_id"))
