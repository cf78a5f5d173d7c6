"""Secret scan: fixed patterns and sliding-window entropy per character class, in SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import free

BIT = 1_000_000
ASSIGNED_AT_LEAST = 6


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The patterns of the base kinds, in their order.
ASSIGN = ("(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Characters of a class, and the window whose Shannon entropy (bits a character) is too high for prose."""

    name: str
    symbols: str
    window: int
    bits: float

    @property
    def run(self) -> str:
        """Pattern of the candidates: whole runs of the class, no shorter than a window."""
        escaped = self.symbols.replace("-", "\\-")
        return f"[{escaped}]{{{self.window},}}"

    @property
    def most(self) -> int:
        """The largest sum of c log2 c over the counts of a window that is still suspicious, in millionths."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * BIT)


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hex", DIGITS + "abcdefABCDEF", 24, 3.0),
    CharClass("base64", DIGITS + LOWER + LOWER.upper() + "+/_-", 20, 3.9),
)
#: Candidates that match one of these as a whole are no secrets: words and names joined by marks, UUIDs.
ALLOWED = (
    "^[A-Za-z]?[a-z]*(?:[+/_-]+[A-Za-z]?[a-z]*)*$",
    "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Windows that hold one of these are no secrets: placeholders. Other windows of the same candidate still count.
ALLOWED_INSIDE = (
    "(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{8}|01234567|12345678|abcdefgh)",
)
SPAN = "struct<start:int,rank:int,stop:int>"


def found(text: Column, pattern: str, rank: int, group: int | None = None, at_least: int = 1) -> Column:
    """Spans (start, rank, stop) of the leftmost matches, and their strings, in order.

    Matches and the pieces between them alternate, so running lengths give code point offsets.
    ``group`` and ``at_least``: drop matches of which that group is shorter.
    """
    pieces = F.split(text, pattern, -1)
    strings = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))
    steps = F.zip_with(strings, values, lambda s, v: F.struct(s.alias("s"), F.char_length(v).alias("n")))
    steps = F.zip_with(steps, F.slice(pieces, 1, F.size(strings)), lambda x, p: F.struct(
        F.char_length(p).alias("gap"), x["s"].alias("s"), x["n"].alias("n")))
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,s:string>>")

    def step(done, x):
        start = done["at"] + x["gap"]
        stop = start + F.char_length(x["s"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["s"].alias("s")))
        return F.struct(stop.alias("at"), F.when(x["n"] >= at_least, F.concat(done["out"], one)).otherwise(
            done["out"]).alias("out"))

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda done: done["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop")))


def hot_windows(candidate: Column, of: CharClass, allowed: tuple[str, ...] = ALLOWED_INSIDE) -> Column:
    """Spans within one candidate whose windows have at least ``of.bits`` and hold nothing allowed, overlapping ones merged.

    Slides over the characters with a count for each symbol: the one that enters is counted, the one
    that leaves is taken off, and the sum of c log2 c follows by the two differences. The entropy
    of the window is log2(w) - sum / w.
    """
    w, size = of.window, len(of.symbols)
    table = F.array(*[F.lit(round(c * math.log2(c) * BIT) if c else 0) for c in range(w + 2)]).cast("array<bigint>")
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def counted(counts, symbol, by):
        return F.concat(F.slice(counts, 1, symbol - 1), F.array(F.element_at(counts, symbol) + by),
                        F.slice(counts, symbol + 1, size))

    def enter(now, i):
        symbol = F.instr(F.lit(of.symbols), F.substring(candidate, i + 1, F.lit(1)))
        c = F.element_at(now["counts"], symbol)
        return F.struct(counted(now["counts"], symbol, 1).alias("counts"),
                        (now["sum"] + F.get(table, c + 1) - F.get(table, c)).alias("sum"))

    def leave(now, i):
        symbol = F.instr(F.lit(of.symbols), F.substring(candidate, i - w + 1, F.lit(1)))
        c = F.element_at(now["counts"], symbol)
        return F.when(i >= w, F.struct(counted(now["counts"], symbol, -1).alias("counts"),
                                       (now["sum"] + F.get(table, c - 1) - F.get(table, c)).alias("sum"))).otherwise(now)

    def step(now, i):
        window = F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"))
        # each of the two differences is bound once, as the element of an array of one
        after = F.transform(F.transform(F.array(window), lambda x: leave(x, i)), lambda x: enter(x, i))
        return F.element_at(F.transform(after, lambda x: F.struct(
            x["counts"].alias("counts"), x["sum"].alias("sum"), merged(now["out"], i, x["sum"]).alias("out"))), 1)

    def merged(out, i, total):
        last = F.element_at(out, -1)
        start = i - (w - 1)
        grown = F.when(
            (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["stop"] >= start),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), (i + 1).alias("stop"))))
        ).otherwise(F.concat(out, F.array(F.struct(start.alias("start"), (i + 1).alias("stop")))))
        inside = F.substring(candidate, start + 1, F.lit(w))
        placeholder = reduce(lambda a, b: a | b, [inside.rlike(p) for p in allowed], F.lit(False))
        return F.when((i >= w - 1) & (total <= of.most), F.when(placeholder, out).otherwise(grown)).otherwise(out)

    first = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("long").alias("sum"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(candidate) - 1), first, step, lambda now: now["out"])


def entropy_spans(text: Column, of: CharClass, allowed: tuple[str, ...]) -> Column:
    """Spans of high entropy within the runs of a class; allowed candidates are passed over."""
    runs = found(text, of.run, KINDS.index("entropy"))
    for pattern in allowed:
        runs = without(runs, pattern)
    spans = F.transform(runs, lambda x: F.transform(hot_windows(x["s"], of), lambda y: F.struct(
        (x["start"] + y["start"]).alias("start"), x["rank"].alias("rank"), (x["start"] + y["stop"]).alias("stop"))))
    return F.flatten(spans)


def without(runs: Column, pattern: str) -> Column:
    return F.filter(runs, lambda x: ~x["s"].rlike(pattern))


def joined(spans: Column) -> Column:
    """kind:start:stop by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES,
         allowed: tuple[str, ...] = ALLOWED, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, stop) in order.

    ``rank`` points into KINDS; offsets count code points, ``stop`` is exclusive. Base spans are the
    leftmost matches of the fixed patterns. The entropy scan adds spans of windows whose characters are
    too evenly spread for their class, also where they overlap base spans, unless the candidate or the window is on its
    allow-list. All work is inside the row, so no row is moved, whatever its key or length. NULL
    is scanned as the empty text; other columns pass through. ``names`` are those of the two new columns; columns of
    ``docs`` with these names are replaced.
    """
    base_name, span_name = names
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(plain(found(t, ASSIGN, 0, 2, ASSIGNED_AT_LEAST)), plain(found(t, ACCESS, 1)), plain(found(t, HEX, 2)))
    more = free(docs, *[f"_more{i}" for i in range(len(classes))])
    out = docs.withColumn(base_name, F.array_sort(base))
    for name, of in zip(more, classes):
        out = out.withColumn(name, entropy_spans(t, of, allowed))
    hot = F.array_distinct(F.concat(F.array().cast(f"array<{SPAN}>"), *[F.col(name) for name in more]))
    return out.withColumn(span_name, F.array_sort(F.concat(base_name, hot))).drop(*more)


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, base, spans for every document; repeated rows, NULL ids and empty tables stay as they are."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scan(rows, "text", **options).select("doc_id", "base", "spans")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; documents without secrets are unchanged.

    Overlapping spans are replaced once, so no part of a longer secret stays. No document is dropped; a NULL text
    stays NULL; other columns stay whatever their names.
    """
    t = F.col(text)

    def step(now, x):
        start = F.greatest(now["at"], x["start"])
        piece = F.substring(t, now["at"] + 1, x["start"] - now["at"])
        return F.when(x["stop"] <= now["at"], now).otherwise(F.struct(
            x["stop"].alias("at"),
            F.when(start > x["start"], now["out"]).otherwise(F.concat(now["out"], F.array(piece, F.lit(mask)))).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    base, spans = free(docs, "_base", "_spans")
    rest = F.aggregate(F.col(spans), first, step, lambda now: F.concat(
        now["out"], F.array(F.substring(t, now["at"] + 1, F.char_length(t)))))
    clean = F.when(F.size(spans) > 0, F.array_join(rest, "")).otherwise(t)
    return scan(docs, text, names=(base, spans), **options).withColumn(text, clean).select(*docs.columns)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == KINDS.index(kind))).cast("long")
