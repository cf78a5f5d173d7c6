"""Benchmark decontamination with a hash set of normalised test n-grams, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import free, lower_ascii, text_key
from epitide.session import cut

#: Everything that is no word after lower-casing A-Z: words are digits, a-z and all outside ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of n-grams is broadcast only if it has no more bytes than this.
BROADCAST_BYTES = 64 << 20


def normal(text: Column) -> Column:
    """The words of a text with one space between them."""
    t = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(lower_ascii(t))
    return F.trim(F.regexp_replace(lower, GAP, " "))


def count_words(line: Column) -> Column:
    """Number of words of a normalised text."""
    gaps = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(gaps + 1).cast("int")


def blocks(line: Column, n: int) -> Column:
    """Word sequences of ``n`` words laid end to end; what is left over at the end is no block."""
    return F.regexp_extract_all(line, F.lit(f"(?:[^ ]+ ){{{n - 1}}}[^ ]+"), F.lit(0))


def grams(words: str, n: Column) -> Column:
    """Word sequences of ``n`` words of the array column ``words``, one from every word on."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(F.col(words), i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def placed(words: str, n: int) -> Column:
    """The sequences of ``n`` words with their starts."""
    return F.transform(grams(words, F.lit(n)),
                       lambda g, i: F.struct(i.alias("start"), F.lit(n).alias("n"), g.alias("gram")))


def bounded(table: DataFrame, column: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, to be broadcast if its measured bytes allow it; the join is a shuffle otherwise."""
    size = table.agg(F.coalesce(F.sum(F.octet_length(column) + 32), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= most else table


def test_windows(benchmark: DataFrame, window: int, text: str, item_id: str) -> DataFrame:
    """item_id, gram, n: every window of every item; an item with fewer words is one window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), normal(F.col(text)).alias("line")).where(
        "line <> ''").select("item_id", F.split("line", " ").alias("w"))
    n = F.least(F.lit(window), F.size("w"))
    return items.select("item_id", n.alias("n"), F.explode(grams("w", n)).alias("gram")).distinct()


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                item_text: str = "text", item_id: str = "item_id", most: int = BROADCAST_BYTES) -> DataFrame:
    """For every different text: ``key``, ``n_words``, ``items`` (sorted strings), ``hits`` (start, n).

    First every text is cut into blocks of half a window, laid end to end; a window always holds a
    whole block, so a text whose blocks are all absent from the items has no hit. The blocks of
    half the shortest window are looked up in the set of all word sequences of that length
    in the items. The texts that remain are looked up window by window, copies once; the sets hold
    the word sequences themselves, so a match of hashes is verified on the words. Sets and the keys
    of the remaining texts are broadcast if their measured bytes are within ``most`` (a quarter of
    it for the keys), and joined by a shuffle otherwise; the result is the same.
    """
    tests = cut(test_windows(benchmark, window, item_text, item_id), "windows")
    sizes = sorted(r[0] for r in tests.select("n").distinct().collect())
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    lines = texts.select("key", normal(F.col("t")).alias("line"))
    lines = lines.select("key", "line", count_words(F.col("line")).alias("n_words"))
    if not sizes:
        return lines.groupBy("key").agg(F.max("n_words").cast("long").alias("n_words")).withColumns({
            "items": F.array().cast("array<string>"), "hits": F.array().cast("array<struct<start:int,n:int>>")})
    block = (sizes[0] + 1) // 2
    parts = tests.select(F.split("gram", " ").alias("w")).select(F.explode(grams("w", F.lit(block))).alias("gram"))
    parts = bounded(cut(parts.distinct(), "blocks"), "gram", most).withColumn("found", F.lit(1))
    seen = cut(
        lines.select("key", "n_words", F.explode_outer(blocks(F.col("line"), block)).alias("gram"))
        .join(parts, "gram", "left")
        .groupBy("key").agg(F.max("n_words").cast("long").alias("n_words"), F.max("found").alias("found")), "seen")
    suspects = (texts.join(bounded(seen.where("found = 1").select("key"), "key", most // 4), "key", "left_semi")
                .groupBy("key").agg(F.first("t").alias("t")).select("key", F.split(normal(F.col("t")), " ").alias("w")))
    laid = F.concat(*[placed("w", n) for n in sizes])
    grams_ = cut(tests.select("gram", "n").distinct(), "grams")
    found = cut(suspects.select("key", F.explode(laid).alias("x")).select("key", "x.start", "x.n", "x.gram")
                .join(bounded(grams_, "gram", most), ["gram", "n"]), "found")
    # a window that a text repeats meets its items once
    named = (found.select("key", "gram", "n").distinct().join(bounded(tests, "gram", most), ["gram", "n"])
             .groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    hits = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("hits")).join(named, "key")
    return cut(seen.join(hits, "key", "left").select(
        "key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,n:int>>")).alias("hits")), "hits")


def covered(hits: Column) -> Column:
    """Number of words below any hit."""
    spans = F.transform(hits, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))
    return F.size(F.array_distinct(F.flatten(spans))).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                  doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items, hits, contaminated for every document.

    ``hits`` are the starts and lengths (in words) of windows that occur in ``items``. NULL and
    empty texts have no words and are clean. An item without words is no window, so an empty
    benchmark leaves all clean. Items are named by their id as text; an item with a NULL id is
    compared but named by no one. Repeated documents give repeated rows, NULL doc_ids stay NULL;
    other columns are not read.
    """
    found = window_hits(docs, benchmark, window, text, item_text, item_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"))
    return rows.join(found, "key").select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), "items", "hits",
        (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs, columns as they were, whatever their names."""
    key, = free(docs, "_key")
    found = window_hits(docs, benchmark, window, text).where(F.size("hits") > 0).select(F.col("key").alias(key))
    return docs.join(found, text_key(F.col(text)) == F.col(key), "left_anti")
