"""Histogram sort: shards of equal bytes from exact counts below candidate boundaries."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from epitide.session import cut

#: Key bytes: 8 of the order hash, 8 of the id, 8 of the row's place in the written table.
KEY_BYTES = 24
KEY_SPACE = 1 << (8 * KEY_BYTES)
#: Probes that one round lays between the smallest and the largest key around each splitter that is still open.
PROBES = 32
#: A round never sends more probes than this; open splitters beyond it wait for the next round.
PROBES_AT_MOST = 60_000
ROUNDS_AT_MOST = 100


def sortable(number: Column) -> Column:
    """16 hex digits that sort like the signed number; NULL sorts like the smallest one."""
    flipped = F.coalesce(number, F.lit(-(1 << 63)).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.lpad(F.hex(flipped), 16, "0")


def keyed(rows: DataFrame, order: Column, tie: Column, size: Column) -> DataFrame:
    """``rows`` with ``_key`` (unique, fixed by writing the table) and ``_size``."""
    key = F.unhex(F.concat(sortable(order), sortable(tie), sortable(F.monotonically_increasing_id())))
    return cut(rows.select("*", key.alias("_key"), size.cast("long").alias("_size")), "keyed")


def gaps(table: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Exact bytes and rows between neighbouring probes, and the smallest and largest key there.

    Gap g holds the keys from probe g - 1 on and below probe g. Every partition counts its own rows; the counts are
    summed by Spark, and the driver gets one row for each gap that is not empty.
    """
    edges = np.array(probes, dtype=f"S{KEY_BYTES}")

    def count(batches):
        size = np.zeros(len(edges) + 1, dtype=np.int64)
        rows = np.zeros(len(edges) + 1, dtype=np.int64)
        low, high = {}, {}
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"S{KEY_BYTES}")
            if not len(keys):
                continue
            gap = np.searchsorted(edges, keys, side="right")
            np.add.at(size, gap, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(gap, minlength=len(rows))
            ordered = np.sort(keys)
            found, first = np.unique(np.sort(gap), return_index=True)
            for g, a, b in zip(found.tolist(), first, np.append(first[1:], len(keys)) - 1):
                least, most = (k.ljust(KEY_BYTES, b"\0") for k in (ordered[a], ordered[b]))
                low[g], high[g] = min(low.get(g, least), least), max(high.get(g, most), most)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(size[full]), pa.array(rows[full]),
             pa.array([low[g] for g in full.tolist()], pa.binary()), pa.array([high[g] for g in full.tolist()], pa.binary())],
            ["gap", "size", "rows", "low", "high"])

    got = (table.select("_key", "_size").mapInArrow(count, "gap int, size long, rows long, low binary, high binary")
           .groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
           .collect())
    size = np.zeros(len(probes) + 1, dtype=np.int64)
    rows = np.zeros(len(probes) + 1, dtype=np.int64)
    for r in got:
        size[r["gap"]], rows[r["gap"]] = r["size"], r["rows"]
    return size, rows, {r["gap"]: (int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big")) for r in got}


def histogram(table: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    size, rows, _ = gaps(table, probes)
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(table: DataFrame, parts: int, tolerance: float) -> tuple[list[bytes], list[int]]:
    """Boundaries of ``parts`` ranges of equal bytes, and the rows below each boundary.

    Each boundary starts between the ends of the key space. A round counts the exact bytes below
    a few probes in every open interval, which shrinks to the two probes around its target; the next probes lie
    between the smallest and the largest key in there, so empty stretches of the key space cost no round. An interval is
    closed as soon as one end is within ``tolerance`` of a part's bytes, or no more than one key lies between the ends.
    """
    total, count, least, most = table.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1)), F.min("_key"), F.max("_key")).first()
    if not total or parts < 2:
        return [], []
    targets = [total * i // parts for i in range(1, parts)]
    slack = int(tolerance * total / parts)
    known = {0: (0, 0), KEY_SPACE: (total, count)}
    whole = (0, KEY_SPACE, int.from_bytes(least, "big"), int.from_bytes(most, "big"))
    still = dict.fromkeys(range(len(targets)), whole)
    chosen: dict[int, int] = {}
    for _ in range(ROUNDS_AT_MOST):
        asked: set[int] = set()
        waits = set()
        for i, (low, high, first, last) in list(still.items()):
            near = min((low, high), key=lambda k: abs(known[k][0] - targets[i]))
            if abs(known[near][0] - targets[i]) <= slack or known[high][1] - known[low][1] <= 1:
                chosen[i] = near
                del still[i]
            elif len(asked) < PROBES_AT_MOST:
                asked |= {low, high, first + 1, *(first + (last - first) * j // PROBES for j in range(1, PROBES + 1))}
            else:
                waits.add(i)
        if not still:
            break
        probes = sorted(asked - {KEY_SPACE})
        size, rows, keys = gaps(table, [k.to_bytes(KEY_BYTES, "big") for k in probes])
        sums, counts = np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()
        known.update((k, (s, r)) for k, s, r in zip(probes, sums, counts))
        for i in still.keys() - waits:
            at = bisect_left(sums, targets[i])
            still[i] = (probes[max(at - 1, 0)], probes[at] if at < len(probes) else KEY_SPACE, *keys[at])
    if still:
        raise RuntimeError("splitters did not meet their tolerance")
    ends = [chosen[i] for i in range(len(targets))]
    return [min(k, KEY_SPACE - 1).to_bytes(KEY_BYTES, "big") for k in ends], [known[k][1] for k in ends]


def at_group_edges(table: DataFrame, bounds: list[bytes], below: list[int], every: int, slack: int):
    """Every ``every``-th boundary moved to the nearer edge of the group of equal order that it cuts.

    Only if that moves no more than ``slack`` bytes; the boundary of a larger group stays inside it.
    """
    picked = range(every - 1, len(bounds), every)
    edges = {}
    for i in picked:
        group = int.from_bytes(bounds[i][:8], "big")
        after = min((group + 1) << (8 * (KEY_BYTES - 8)), KEY_SPACE - 1)
        edges[i] = [bounds[i], bounds[i][:8] + bytes(KEY_BYTES - 8), after.to_bytes(KEY_BYTES, "big")]
    probes = sorted({e for es in edges.values() for e in es})
    size, rows = histogram(table, probes)
    count = {p: (int(s), int(r)) for p, s, r in zip(probes, size, rows)}
    bounds, below = list(bounds), list(below)
    for i, (own, *others) in edges.items():
        moved, edge = min((abs(count[e][0] - count[own][0]), e) for e in others)
        low, high = bounds[i - 1] if i else b"", bounds[i + 1] if i + 1 < len(bounds) else b"\xff" * KEY_BYTES
        if moved <= slack and low <= edge <= high:
            bounds[i], below[i] = edge, count[edge][1]
    return bounds, below


def histogram_sort(rows: DataFrame, order: Column, tie: Column, size: Column, shards: int = 16,
                   tolerance: float = 0.002, rows_per_range: int = 1_000_000, ranges_at_least: int = 4,
                   group_slack: float = 0.01) -> DataFrame:
    """``rows`` in the order of (``order``, ``tie``), cut into ``shards`` shards of equal ``size``.

    Adds ``_shard`` (0 to ``shards`` - 1) and ``_slot`` (0, 1, ... without gaps in each shard).
    ``order`` and ``tie`` are long columns; choose a hash of the content as ``order`` so that equal
    content lies together and the key space is evenly filled. Rows that agree in both keep the
    order in which they were read, so a repeated row never blocks a boundary. Rows of equal ``order``
    share a shard if that moves no boundary by more than ``group_slack`` of a shard. The bytes of a
    shard differ from the mean by at most twice that, plus ``tolerance`` of a range and one row. Every
    shard is a whole number of ranges, as many as ``rows_per_range`` asks for; a range is what one
    task sorts. Only boundaries and their counts reach the driver: a few for each range.

    The rows are written once with their keys; then the counting rounds read keys and sizes only,
    and one exchange moves the rows. NULLs in ``order`` or ``tie`` sort first, a NULL ``size``
    counts 0. An empty table gives an empty table. Columns named ``_key``, ``_size``, ``_shard``,
    ``_slot``, ``_range`` and ``_split`` are reserved.
    """
    table = keyed(rows, order, tie, F.coalesce(size, F.lit(0)))
    count = table.count()
    per_shard = max(ranges_at_least, -(-count // (shards * rows_per_range)))
    bounds, below = splitters(table, shards * per_shard, tolerance)
    if bounds and group_slack:
        total = table.agg(F.sum("_size")).first()[0]
        bounds, below = at_group_edges(table, bounds, below, per_shard, int(group_slack * total / shards))
    before = [0, *below]
    starts = [before[min(i - i % per_shard, len(before) - 1)] for i in range(len(before))]
    edges = np.array(bounds, dtype=f"S{KEY_BYTES}")

    def place(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("_key").to_pylist()), dtype=f"S{KEY_BYTES}")
            part = np.searchsorted(edges, keys, side="right").astype(np.int32)
            yield batch.append_column("_range", pa.array(part))

    schema = T.StructType([*table.schema.fields, T.StructField("_range", T.IntegerType())])
    placed = table.mapInArrow(place, schema)
    offset = F.create_map(*[x for i, (b, s) in enumerate(zip(before, starts)) for x in (F.lit(i), F.lit(b - s))]) \
        if len(before) <= 2000 else None
    ordered = Window.partitionBy("_range").orderBy("_key")
    placed = placed.withColumn("_slot", F.row_number().over(ordered).cast("long") - 1)
    if offset is not None:
        placed = placed.withColumn("_slot", F.col("_slot") + offset[F.col("_range")])
    else:
        offsets = table.sparkSession.createDataFrame([(i, b - s) for i, (b, s) in enumerate(zip(before, starts))],
                                                     "_range int, _split long")
        placed = placed.join(offsets, "_range").withColumn("_slot", F.col("_slot") + F.col("_split")).drop("_split")
    return placed.withColumn("_shard", F.floor(F.col("_range") / per_shard).cast("int")).drop("_key", "_size", "_range")


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, text: str = "text",
                    doc_id: str = "doc_id", **keep: Column) -> DataFrame:
    """Shard and slot of every document, by the UTF-8 bytes of its text plus 1 (a NULL text has none).

    Equal texts lie together: they share a shard unless a boundary falls into a group of more than
    1 % of a shard, as it must where a group is larger than a shard. ``keep`` adds columns, so that only what is asked
    for is written and moved; pass ``text=F.col("text")`` to shard the documents themselves.
    Result: doc_id, size, ``keep``, shard, slot. Documents without doc_id, repeated documents and
    empty tables are kept as they are; columns that are not asked for never matter.
    """
    t = F.col(text)
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"),
                       *[c.alias(n) for n, c in keep.items()], F.xxhash64(t).alias("_order"))
    out = histogram_sort(rows, F.col("_order"), F.col("doc_id"), F.col("size"), shards, tolerance)
    return out.select("doc_id", "size", *keep, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
