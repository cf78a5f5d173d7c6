"""The state fold of keys of any size, in ranges of rows."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitide.operators.series import state_fold
from epitide.operators.spread import join_keys, lay_out
from epitide.operators.streams import column, kinds

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def carried_states(ends: DataFrame, keys: Sequence[str], gamma: float) -> DataFrame:
    """keys, _part, _i, _r: infected and removed ahead of each range of a key but its first.

    ``ends`` has one row for each key and range: its rows, its last ``I`` and the sum of its ``I``, both from zero. A range
    of n rows is the map ``(i, r) -> (last + q^n i, r + leave (all + i (q + ... + q^n)))``; the maps are applied one
    after the other, in one sorted stream.
    """
    keys = list(keys)
    q, leave = max(1.0 - gamma, 0.0), min(gamma, 1.0)

    def run(batches):
        now, i, r = None, 0.0, 0.0
        for batch in batches:
            out = []
            names = batch.select(keys).to_pylist()
            for at, (key, n, last, total) in enumerate(zip(names, *(column(batch, c).tolist() for c in ("_rows", "_last", "_all")))):
                if key == now:
                    out.append((at, i, r))
                else:
                    now, i, r = key, 0.0, 0.0
                geometric = n if q == 1.0 else q * (1 - q**n) / (1 - q)
                r += leave * (total + i * geometric)
                i = last + q**n * i
            if out:
                rows, infected, removed = zip(*out)
                heads = batch.select([*keys, "_part"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(infected, pa.float64()), pa.array(removed, pa.float64())],
                                                 [*keys, "_part", "_i", "_r"])

    ordered = ends.repartition(*keys).sortWithinPartitions(*keys, "_part")
    return ordered.mapInArrow(run, f"{kinds(ends, [*keys, '_part'])}, _i double, _r double")


def state_fold_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float, column: str = "dS", size: int = 0
) -> DataFrame:
    """:func:`epitide.operators.series.state_fold` for keys whose rows no single task should hold.

    The rows are cut into ranges of (keys, order), as many as ``size`` rows ask for (see :func:`epitide.operators.spread.lay_out`);
    ``order`` tells apart all rows of a key. Every range is folded from (0, 0); what lies ahead of it is added by
    its closed form. Only ranges that do not begin a key get something, fewer than there are ranges: they are broadcast.
    NULL keys are keys, a NULL count adds nothing, an empty table gives an empty one.
    """
    part = [*keys, "_part"]
    q, leave = max(1.0 - gamma, 0.0), min(gamma, 1.0)
    laid = lay_out(df, keys, order, size)
    along = Window.partitionBy(*part).orderBy(*order)
    counted = laid.withColumn("_new", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    own = state_fold(counted, part, order, gamma, "_new").withColumn("_pos", F.row_number().over(along).cast("double"))
    several = laid.select(*part).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_ranges")).where("_ranges > 1").drop("_ranges")
    ends = join_keys(own, several, keys, small=True).groupBy(*part).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"), F.max_by("I", "_pos").alias("_last"), F.sum("I").alias("_all"))
    joined = join_keys(own, carried_states(ends, keys, gamma), part, "left", small=True)
    i = F.coalesce(F.col("_i"), F.lit(0.0))
    kept = F.pow(F.lit(q), F.col("_pos"))
    # I of the rows of this range before the current one that comes from ahead of the range
    passed = F.col("_pos") - 1 if q == 1.0 else F.lit(0.0) if q == 0.0 else (q - kept) / (1 - q)
    return joined.withColumns({
        "I": F.when(F.col("_i").isNull(), F.col("I")).otherwise(F.col("I") + kept * i),
        "R": F.col("R") + F.coalesce(F.col("_r"), F.lit(0.0)) + leave * i * passed,
    }).select(*df.columns, "I", "R")
