"""Grid sums of every key in sorted streams of Arrow batches.

A grid of points stays an array beside the rows: it is never laid out as rows, and no task holds more than
one batch of rows, one block of rows times points and one array of sums.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.operators.spread import join_keys

# what runs in Python workers goes there by value, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: grid values worked out at a time, rows times points: what a core's cache holds
BLOCK = 1 << 17

Score = Callable[[pa.RecordBatch], np.ndarray]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def segment_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Where the rows of a new key begin in a batch sorted by keys; NULL is a key."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def arrays(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel()))


def given_sums(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("sums").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def with_sums(heads: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*heads.columns, arrays(sums)], [*heads.schema.names, "sums"])


def fold(keys: Sequence[str], carried: Sequence[str], width: int, score: Score, finish=with_sums):
    """For ``mapInArrow`` over rows sorted by ``keys``: the summed scores of every key of a task.

    ``carried`` are the columns of a key's first row that ``finish`` gets beside the sums. The last
    key of a batch waits for the rest of its rows. ``finish`` gets the keys as they are done, fewer than two blocks of sums at once,
    however many keys a batch has.
    """
    keys, carried = list(keys), list(carried)
    size = max(1, BLOCK // max(1, width))

    def summed(batches):
        """First row and sums of every key, those of a block at once."""
        held, total = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = segment_starts(batch, keys)
            goes_on = held is not None and held.select(keys).to_pylist() == batch.select(keys).slice(0, 1).to_pylist()
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                first, last = np.searchsorted(starts, (a, a + part.num_rows - 1), side="right") - 1
                begins = np.maximum(starts[first:last + 1] - a, 0)
                heads, sums, terms = part.select(carried).take(pa.array(begins)), np.zeros((len(begins), width)), score(part)
                if a > starts[first] or (a == 0 and goes_on):  # row by row, wherever blocks and batches end
                    terms[0] += total
                    heads = joined([held, heads.slice(1)])
                elif held is not None:
                    yield held, total[None, :]
                for i, (begin, end) in enumerate(zip(begins, np.append(begins[1:], len(terms)))):
                    np.add.reduce(terms[begin:end], axis=0, out=sums[i])
                held, total = heads.slice(len(begins) - 1), sums[-1].copy()
                if len(begins) > 1:
                    yield heads.slice(0, len(begins) - 1), sums[:-1]
        if held is not None:
            yield held, total[None, :]

    def run(batches):
        heads, sums, n = [], [], 0
        for head, values in summed(batches):
            heads.append(head)
            sums.append(values)
            n += len(values)
            if n >= size:
                yield finish(joined(heads), np.concatenate(sums))
                heads, sums, n = [], [], 0
        if n:
            yield finish(joined(heads), np.concatenate(sums))

    return run


def kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def grid_sums(rows: DataFrame, keys: Sequence[str], width: int, score: Score, finish, schema: str, carried: Sequence[str] = ()) -> DataFrame:
    """``finish(heads, sums)`` of every key: the scores of its rows, summed point by point.

    Rows are summed where they lie: one array for each key and task is all that is shuffled, so a key with
    a third of all rows costs its task no more than one array from each other task. The arrays of
    a key then stream through one task, added as they come.
    """
    heads = [*keys, *carried]
    partial = rows.sortWithinPartitions(*keys).mapInArrow(fold(keys, heads, width, score), f"{kinds(rows, heads)}, sums array<double>")
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold(keys, heads, width, given_sums, finish), schema)


def sums_ahead(rows: DataFrame, keys: Sequence[str], width: int, score: Score) -> DataFrame:
    """For every key that goes on in a later range, the sums of its earlier ranges: keys, _part, sums.

    ``rows`` come in the ranges of :func:`epitide.operators.spread.lay_out`, where no range but the first of a key begins
    amid its rows: so there are fewer such keys than ranges, they are broadcast, and only
    their rows are scored here.
    """
    keys = list(keys)
    part = [*keys, "_part"]
    several = (rows.select(*part).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_ranges")).where("_ranges > 1").drop("_ranges"))
    spanning = join_keys(rows, several, keys, small=True)
    per_range = spanning.sortWithinPartitions(*part).mapInArrow(fold(part, part, width, score), f"{kinds(rows, part)}, sums array<double>")

    def before(batches):
        now, total, at, own = None, None, None, None
        for batch in batches:
            names = batch.select(keys).to_pylist()
            for i, (key, place, sums) in enumerate(zip(names, column(batch, "_part"), given_sums(batch) if batch.num_rows else [])):
                if key != now:
                    now, total, at, own = key, np.zeros(width), place, sums.copy()
                elif place == at:
                    own += sums
                else:
                    total, at, own = total + own, place, sums.copy()
                    yield with_sums(batch.select(part).slice(i, 1), total[None, :])

    return per_range.repartition(*keys).sortWithinPartitions(*part).mapInArrow(before, f"{kinds(rows, part)}, sums array<double>")


def running_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str], width: int, score: Score, pick, schema: str) -> DataFrame:
    """``pick(rows, scores, sums)`` of blocks of rows, with the sums of the scores along every key up to each row.

    A range is one sorted stream: the sums of the key's earlier ranges come ahead of the rows, and the sums so
    far are carried from batch to batch. A range is never held as a whole.
    """
    keys = list(keys)
    part = [*keys, "_part"]
    ahead = sums_ahead(rows, keys, width, score).withColumn("_kind", F.lit(0))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(ahead, allowMissingColumns=True)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = both.repartitionById(tasks, F.col("_part") % tasks).sortWithinPartitions("_part", *keys, "_kind", *order)

    def run(batches):
        now, total = None, np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = segment_starts(batch, part)
            names = batch.select(part).take(pa.array(starts)).to_pylist()
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[starts] = True
            fresh[0] = names[0] != now
            now = names[-1]
            ahead = column(batch, "_kind") == 0
            size, picked = max(1, BLOCK // max(1, width)), []
            for a in range(0, batch.num_rows, size):
                block = batch.slice(a, size)
                scores, first = score(block), ahead[a:a + size]
                sums = np.empty_like(scores)
                edges = np.flatnonzero(fresh[a:a + size])
                for start, end in zip(np.union1d([0], edges), np.append(edges[edges > 0], len(scores))):
                    if fresh[a + start]:
                        total = np.zeros(width)
                    if first[start]:
                        total = given_sums(block.slice(start, 1))[0]
                        start += 1
                    if start < end:
                        np.cumsum(np.concatenate([(total + scores[start])[None, :], scores[start + 1:end]]), axis=0, out=sums[start:end])
                        total = sums[end - 1].copy()
                rows = np.flatnonzero(~first)
                if len(rows):
                    picked.append(pick(block.take(pa.array(rows)), scores[rows], sums[rows]))
            if picked:
                yield from pa.Table.from_batches(picked).combine_chunks().to_batches()

    return stream.mapInArrow(run, schema)


def whole_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run, schema: str, together: bool = False) -> DataFrame:
    """``run(batch)`` of all rows of one key at a time, for keys whose rows are bounded, such as the weeks of a series.

    One shuffle, by key, and one sorted stream a task: no more than a key's rows wait for the next batch.
    ``together``: ``run(batch, starts)`` of all keys that a batch of rows completes, with the places where they begin.
    """
    keys = list(keys)
    sorted_rows = rows.sortWithinPartitions(*keys, *order)

    def stream(batches):
        waiting = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = segment_starts(batch, keys)
            if waiting and waiting[0].select(keys).slice(0, 1).to_pylist() == batch.select(keys).slice(0, 1).to_pylist():
                starts = starts[1:]
            cuts, at, done = starts.tolist(), 0, []
            if together and cuts:
                before = sum(w.num_rows for w in waiting)
                begins = np.unique([0, *(before + c for c in cuts[:-1])])
                if before + cuts[-1]:
                    yield run(joined([*waiting, batch.slice(0, cuts[-1])]), begins)
                waiting, at, cuts = [], cuts[-1], []
            for cut_at in cuts:
                if cut_at > at:
                    waiting.append(batch.slice(at, cut_at - at))
                if waiting:
                    done.append(run(joined(waiting)))
                waiting, at = [], cut_at
            waiting.append(batch.slice(at))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if waiting:
            yield run(joined(waiting), np.zeros(1, dtype=np.int64)) if together else run(joined(waiting))

    return sorted_rows.mapInArrow(stream, schema)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
