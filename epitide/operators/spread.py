"""Work inside a key that must not rest on one task.

A key may hold a large share of all rows. The steps here never give the rows of one key to
one task: per-key figures are aggregated map-side and joined back with the large keys
apart, and ordered work goes by ranges of (key, order) that cut through large keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitide.session import cut

#: at most this many keys can be large, because each holds more than its share of all rows
LARGE_KEYS_AT_MOST = 100_000

#: rows of a range, where the number of rows is known beforehand
RANGE_ROWS = 2_000_000

#: a key with fewer rows than this is never treated as large
SMALL_KEY_ROWS = 5_000_000


def attach_key_stats(
    rows: DataFrame,
    keys: Sequence[str],
    stats: Mapping[str, Column],
    small_key_rows: int = SMALL_KEY_ROWS,
) -> DataFrame:
    """Add per-key aggregates to every row, as an aggregate window would, without the window.

    The aggregates are combined map-side. A key is large when it has more than
    ``small_key_rows`` rows and more than 1/100,000 of all rows, so there are at most
    100,000 large keys and their figures are broadcast; large keys' rows stay where they
    are. All other rows meet their figures in a shuffle join of bounded groups.
    """
    per_key = cut(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[expr.alias(name) for name, expr in stats.items()]
    ), "figures")
    total = per_key.agg(F.sum("_rows").alias("_total")).scalar()
    bound = F.greatest(total / F.lit(LARGE_KEYS_AT_MOST), F.lit(float(small_key_rows)))
    large = per_key.where(F.col("_rows") > bound)
    small = per_key.where(F.col("_rows") <= bound)

    in_large = join_keys(rows, large, keys, small=True)
    in_small = join_keys(
        join_keys(rows, large, keys, "left", small=True).where(F.col("_rows").isNull()).drop("_rows", *stats), small, keys
    )
    return in_large.unionByName(in_small).drop("_rows")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys, where NULL equals NULL; each key comes out once, as ``left`` has it.

    ``small`` broadcasts ``right``, which must be bounded.
    """
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(F.broadcast(other) if small else other, on, how).drop(*[f"_right_{k}" for k in keys])


def spread_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash rows by ``keys`` over all shuffle partitions, however few bytes they are.

    For rows that a grid is about to multiply: left to itself, adaptive coalescing would go
    by their present size and put them on one task. Later steps by these keys, or by more,
    need no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lay_out(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 0) -> DataFrame:
    """Write ``rows`` in ranges of (keys, order) and add the range number ``_part``.

    Ranges follow the order columns too, so a large key is cut into many ranges of like
    size. ``order`` should tell apart all rows of a key. The table is written because the
    range bounds come from a sample: all later steps have to see one and the same division.
    There are as many ranges as shuffle partitions, or, where the number of rows is given as
    ``size``, as many as hold ``RANGE_ROWS`` rows each, if that is more.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_ROWS))
    ranged = rows.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return cut(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def running(
    laid: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    spread: bool = False,
) -> DataFrame:
    """Running sums, key totals and neighbours over a table from :func:`lay_out`.

    sums       name -> expression, summed from the key's first row to the current one
    totals     name -> expression, summed over all rows of the key
    previous   name -> column, its value one row earlier (NULL at the first)
    following  name -> column, its value one row later (NULL at the last)

    ``spread`` keeps the rows over all shuffle partitions, for a grid that follows (see
    :func:`spread_rows`; a repartition after the window would be optimised away).

    Each range is reduced to one row per key, map-side; a window over those rows (no more
    than there are ranges) gives what lies before and after; a second window runs inside
    one range only.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    previous, following = dict(previous or {}), dict(following or {})
    part_keys = [*keys, "_part"]
    place = F.struct(*order)

    per_part = laid.groupBy(*part_keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()],
        *[F.sum(e).alias(f"_tot_{n}") for n, e in totals.items()],
        *[F.max_by(F.struct(c), place).alias(f"_prev_{n}") for n, c in previous.items()],
        *[F.min_by(F.struct(c), place).alias(f"_next_{n}") for n, c in following.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    outside = per_part.select(
        *part_keys,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.sum(f"_tot_{n}").over(whole).alias(f"_tot_{n}") for n in totals],
        *[F.lag(f"_prev_{n}").over(along).alias(f"_prev_{n}") for n in previous],
        *[F.lead(f"_next_{n}").over(along).alias(f"_next_{n}") for n in following],
    )

    inside = Window.partitionBy(*part_keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_keys(spread_rows(laid, part_keys) if spread else laid, outside, part_keys)
    return joined.select(
        *laid.columns,
        *[(F.sum(e).over(upto) + F.col(f"_sum_{n}")).alias(n) for n, e in sums.items()],
        *[F.col(f"_tot_{n}").alias(n) for n in totals],
        *[
            F.coalesce(F.lag(F.struct(c)).over(inside), F.col(f"_prev_{n}"))[c].alias(n)
            for n, c in previous.items()
        ],
        *[
            F.coalesce(F.lead(F.struct(c)).over(inside), F.col(f"_next_{n}"))[c].alias(n)
            for n, c in following.items()
        ],
    )


def exact_median(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of several numeric columns per key; the mean of the middle two if even.

    A key whose values are all NULL has the median NULL; a NULL key is a key.

    Equal values are counted map-side first. The middle ranks are then found with running
    counts, so that no buffer has to hold all values of a key. The counts are written, so that the
    number of ranges can follow theirs.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    counts = cut(
        rows.select(*keys, *doubles)
        .unpivot(list(keys), list(columns), "_var", "_val")
        .where(F.col("_val").isNotNull())
        .groupBy(*keys, "_var", "_val")
        .agg(F.count(F.lit(1)).alias("_cnt")),
        "counts",
    )
    group = [*keys, "_var"]
    ranked = running(
        lay_out(counts, group, ["_val"], size=counts.count()),
        group,
        ["_val"],
        sums={"_upto": F.col("_cnt")},
        totals={"_all": F.col("_cnt")},
    )
    low, high = F.expr("(_all + 1) div 2"), F.expr("(_all + 2) div 2")
    after = F.col("_upto") - F.col("_cnt")
    is_low = (after < low) & (F.col("_upto") >= low)
    is_high = (after < high) & (F.col("_upto") >= high)
    middle = ranked.where(is_low | is_high).select(
        *group, F.when(is_low, F.col("_val")).alias("_low"), F.when(is_high, F.col("_val")).alias("_high")
    )
    medians = middle.groupBy(*keys).agg(
        *[
            (
                (
                    F.max(F.when(F.col("_var") == c, F.col("_low")))
                    + F.max(F.when(F.col("_var") == c, F.col("_high")))
                )
                / 2
            ).alias(c)
            for c in columns
        ]
    )
    return join_keys(rows.select(*keys).distinct(), medians, keys, "left") if keys else medians
