"""Substring dedup: passages go to shards by content, and each shard is searched by an FM-index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import text_key
from epitide.llm.fm_index import FMIndex
from epitide.session import cut

#: Words of the sequence whose smallest hash names a window's shard.
GRAM = 8
#: Words that one index should hold, and words under one name beyond which its windows are split.
SHARD_WORDS, NAME_WORDS = 1 << 19, 1 << 17
BYTES_AT_ONCE = 1 << 23
NO_ID = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()
RANGES = "array<struct<first:int,count:int>>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words (by ASCII white space), the word number of each word, the words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    empty = np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):  # a blank text splits into one empty word
        keep = ~np.isin(ids, empty)
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        counts, ids = np.bincount(owner, minlength=len(counts)), ids[keep]
    return coded.dictionary, ids, counts


def names(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the smallest hash of its sequences of ``gram`` words."""
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - gram + 1, 0), dtype=np.uint64)
        for j in range(gram):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + len(rolled)]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(29)
    width, low = window - gram + 1, rolled
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:len(low) - have], low[have:]) if len(low) > have else low[:0]
        have *= 2
    rest = width - have
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest and len(low) > rest else low if not rest else low[:0]


def runs(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one name: text, first window, windows, name; and the words of each text."""
    words, ids, counts = split_words(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))[ids]
    name = names(hashes, window, gram)
    number = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    first = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    named = name[np.repeat(np.cumsum(counts) - counts, number) + first] if len(text) else name[:0]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (named[1:] != named[:-1])
    start = np.flatnonzero(new)
    return text[start], first[start], np.diff(np.concatenate([start, [len(text)]])), named[start].view(np.int64), counts


def slices(batch: pa.RecordBatch, column: str):
    """``batch`` in parts of bounded text bytes; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + BYTES_AT_ONCE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def in_lists(owner: np.ndarray, rows: int, **columns: np.ndarray) -> pa.Array:
    """Struct lists, one for each of ``rows``, of columns that are sorted by ``owner``."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def scan(window: int, gram: int):
    """For ``mapInArrow``: words, digest of the words joined by one space, and runs of every text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, first, count, name, words = runs(part.column("text"), window, gram)
                whole = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("id"), part.column("key"), pa.array(words), pa.array(whole),
                     in_lists(text, part.num_rows, name=name, first=first.astype(np.int32), count=count.astype(np.int32))],
                    ["doc_id", "id", "key", "n_words", "whole", "runs"])

    return run


def passages(window: int):
    """For ``mapInArrow``: the words of the wanted runs, and 128 bits that stand for them."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = {c: [] for c in ("name", "piece", "id", "key", "first", "count", "words")}
                for key, number, text, wanted in zip(*(part.column(c).to_pylist() for c in ("key", "id", "text", "runs"))):
                    words = (text or "").encode().split()
                    for r in wanted:
                        piece = b" ".join(words[r["first"]:r["first"] + r["count"] + window - 1])
                        for c, v in (("name", r["name"]), ("piece", xxhash.xxh3_128_digest(piece)), ("id", number), ("key", key),
                                     ("first", r["first"]), ("count", r["count"]), ("words", piece.decode())):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("name", pa.int64()), ("piece", pa.binary()), ("id", pa.int64()), ("key", pa.string()),
                    ("first", pa.int32()), ("count", pa.int32()), ("words", pa.string())]))

    return run


def search(window: int):
    """For ``applyInArrow``: of each passage of a shard the windows that a smaller id has as well."""

    def run(table: pa.Table) -> pa.Table:
        words, ids, counts = split_words(table["words"].combine_chunks())
        owner = table["least"].to_numpy()
        rows, start = len(counts), np.cumsum(counts + 1) - counts - 1
        text = np.zeros(int(counts.sum()) + rows, dtype=np.int64)
        text[np.arange(len(ids)) + np.repeat(np.arange(rows), counts)] = ids.astype(np.int64) + 1
        index = FMIndex(text, np.repeat(owner, counts + 1), window)
        place, group = index.statistics(start, counts - window + 1)
        passage = np.searchsorted(start, place, side="right") - 1
        hit = index.least[group] < owner[passage]
        place, passage = place[hit], passage[hit]
        order = np.argsort(place)
        place, passage = place[order], passage[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (passage[1:] != passage[:-1])
        at = np.flatnonzero(new)
        found = in_lists(passage[at], rows, first=(place[at] - start[passage[at]]).astype(np.int32),
                         count=np.diff(np.concatenate([at, [len(place)]])).astype(np.int32))
        out = pa.table({"name": table["name"], "piece": table["piece"], "hits": found})
        return out.filter(pc.greater(pc.list_value_length(found), 0))

    return run


def keep(window: int):
    """For ``mapInArrow``: words of a text that no hit covers, and the covered spans."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("key", "removed", "spans", "kept")}
            for key, text, hits in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "hits"))):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                for h in hits:
                    edge[h["first"]] += 1
                    edge[h["first"] + h["count"] + window - 1] -= 1
                covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                turn = np.flatnonzero(covered[1:] != covered[:-1])
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                stay = [words[i] for i in np.flatnonzero(~covered[1:-1])]
                for c, v in (("key", key), ("removed", len(words) - len(stay)), ("spans", spans), ("kept", b" ".join(stay).decode())):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("key", pa.string()), ("removed", pa.int64()), ("kept", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
            ).select(["key", "removed", "spans", "kept"])

    return run


def joined_runs(places: Column) -> Column:
    """Sorted places as runs: (first, count) of those that follow each other."""

    def add(done, place):
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["first"].alias("first"), (last["count"] + 1).alias("count"))
        new = F.struct(place.alias("first"), F.lit(1).alias("count"))
        return F.when((F.size(done) > 0) & (last["first"] + last["count"] == place),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(places, F.array().cast(RANGES), add)


def repeated_passages(docs: DataFrame, window: int = 50, gram: int = GRAM, shard_words: int = SHARD_WORDS,
                      name_words: int = NAME_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with the words that repeat a passage of a document of smaller id.

    Result: doc_id, n_words, n_removed, spans (removed words, from ``start`` to before ``stop``), kept (the
    other words joined by one space; NULL if nothing is removed), whole_sha256 (of all words
    joined by one space). A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller id; windows are judged on the input. NULL and blank texts have no
    words. Documents without id come last and take nothing from each other; repeated rows of one id
    neither. An empty table gives an empty one; other columns are not read.

    1. Every window is named by the smallest hash of its ``gram``-word sequences; windows in a row
       mostly share a name. Equal windows have equal names, so only names that occur in two
       different texts matter. Of equal texts only the smallest id is looked at: all windows of the
       others are repeats.
    2. The passages below those names go to shards by name, equal passages once. A shard holds about
       ``shard_words`` words, so their number grows with the input and their size does not. In
       each an FM-index is built and the passages stream through it: backward search over its wavelet tree
       gives the interval of every window, and the smallest id in the interval tells whether
       it is a repeat. Every equal window is in the same shard, so a shard decides alone.
    3. A name of more than ``name_words`` words of different passages (a phrase with which a third of
       all documents begin) is split by the windows themselves: equal windows are aggregated
       map-side to their smallest id. This is exact and no task holds the name.
    """
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    source = docs.select(F.col(doc_id).alias("doc_id"), ids.alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = cut(source.mapInArrow(
        scan(window, gram), f"doc_id {kind}, id long, key string, n_words long, whole string, "
                            "runs array<struct<name:bigint,first:int,count:int>>"), "rows")
    texts = cut(rows.groupBy("key").agg(F.min("id").alias("least"), F.first("runs").alias("runs")), "texts")
    named = texts.select("key", "least", F.explode("runs").alias("r"))
    short = F.xxhash64("key")
    twice = (named.groupBy(F.col("r.name").alias("name")).agg(F.min(short).alias("a"), F.max(short).alias("b"))
             .where("a <> b").select("name"))
    wanted = (named.select("key", "least", "r.name", "r.first", "r.count").join(twice, "name")
              .groupBy("key", "least").agg(F.collect_list(F.struct("name", "first", "count")).alias("runs")))
    suspects = cut(source.select("key", "id", "text").join(
        wanted.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("least")))
        .select("key", "id", "text", "runs"), "suspects")
    pieces = cut(suspects.mapInArrow(
        passages(window), "name long, piece binary, id long, key string, first int, count int, words string"), "pieces")
    different = cut(pieces.groupBy("name", "piece").agg(
        F.min("id").alias("least"), F.first("count").alias("count"), F.first("words").alias("words")), "passages")

    sizes = different.groupBy("name").agg(F.sum(F.col("count") + (window - 1)).alias("size"))
    large = cut(sizes.where(F.col("size") > name_words).select("name"), "large")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    sharded = (different.join(large, "name", "left_anti").select("name", "piece", "least", "words")
               .withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))))
    found = sharded.groupBy("shard").applyInArrow(search(window), f"name long, piece binary, hits {RANGES}")
    windows = (different.join(large, "name").select("name", "piece", "least", "count", F.split("words", " ").alias("w"))
               .select("name", "piece", "least", F.explode(F.transform(
                   F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.struct(
                       i.alias("first"), F.md5(F.array_join(F.slice("w", i + 1, window), " ").cast("binary")).alias("is")))).alias("x"))
               .select("name", "piece", "least", "x.first", "x.is"))
    # written, so that the join meets plain tables and its common windows can be split
    earliest = cut(windows.groupBy("is").agg(F.min("least").alias("smallest")), "earliest")
    split = (windows.join(earliest, "is").where("smallest < least").groupBy("name", "piece")
             .agg(joined_runs(F.sort_array(F.collect_list("first"))).alias("hits")))
    found = cut(found.unionByName(split), "found")

    facts = cut(different.select("name", "piece", "least").join(found, ["name", "piece"], "left"), "facts")
    first = pieces.drop("words").join(facts, ["name", "piece"])
    whole = F.array(F.struct("first", "count"))
    inside = F.transform(F.coalesce("hits", F.array().cast(RANGES)), lambda h: F.struct(
        (h["first"] + F.col("first")).alias("first"), h["count"].alias("count")))
    hits = (first.select("key", F.explode(F.when(F.col("id") > F.col("least"), whole).otherwise(inside)).alias("h"))
            .groupBy("key").agg(F.collect_set("h").alias("hits")))
    removed = cut(suspects.select("key", "text").join(hits, "key").mapInArrow(
        keep(window), "key string, removed long, spans array<struct<start:bigint,stop:bigint>>, kept string"), "removed")
    removed = removed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("removed", "spans", "kept")])

    joined = rows.drop("runs").join(texts.select("key", "least"), "key")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    copy = F.col("id") > F.col("least")
    short = joined.where(F.col("n_words") < window).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), F.lit(None).cast("string").alias("kept"),
        F.col("whole").alias("whole_sha256"))
    copies = joined.where((F.col("n_words") >= window) & copy).select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), whole_text.alias("spans"), F.lit("").alias("kept"),
        F.col("whole").alias("whole_sha256"))
    others = joined.where((F.col("n_words") >= window) & ~copy).join(removed, "key", "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", none).alias("spans"),
        "kept", F.col("whole").alias("whole_sha256"))
    return short.unionByName(copies).unionByName(others)
