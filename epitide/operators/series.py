"""Weekly count series and their running state.

A series holds one row per calendar week: 53 at most for a season, some thousands for a
product. That bound, not the number of events, limits every window over a series here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitide.functions.calendar import FOUR_YEARS_SECONDS, season_id, season_week, season_year, whole_weeks
from epitide.functions.model import MINUS_INF
from epitide.functions.text import region_number
from epitide.operators.spread import attach_key_stats, join_keys
from epitide.session import cut

#: population bound of a product
PRODUCT_NMAX = 1e5


# --- event logs ---------------------------------------------------------------------

def event_counts(events: DataFrame, key: str = "id") -> DataFrame:
    """Events per key and time stamp (``_n``), written: the log is read once, and a hot key is summed map-side."""
    return cut(events.groupBy(key, "ts").agg(F.count(F.lit(1)).alias("_n")), "event-counts")


def since_first(events: DataFrame, key: str = "id", ts: str = "ts", **options) -> DataFrame:
    """Replace ``ts`` by the seconds since the first event of the same key."""
    other = [c for c in events.columns if c != ts]
    seen = attach_key_stats(events, [key], {"_first": F.min(ts)}, **options)
    return seen.select(*other, (F.col(ts) - F.col("_first")).alias(ts))


def weekly_counts(events: DataFrame, key: str = "id", nmax: float = PRODUCT_NMAX, **options) -> DataFrame:
    """Events per key and week since the key's first event; weeks without events give no row."""
    since = since_first(event_counts(events, key), key, **options)
    return (
        since.groupBy(key, whole_weeks(F.col("ts")).alias("week"))
        .agg(F.sum("_n").alias("dS"))
        .withColumn("Nmax", F.lit(nmax))
    )


def valid_products(
    events: DataFrame, min_reviews: int = 100, horizon: int = FOUR_YEARS_SECONDS, key: str = "id", **options
) -> DataFrame:
    """Keys with more than ``min_reviews`` events inside the horizon and a later event."""
    since = since_first(event_counts(events, key), key, **options)
    inside = F.sum(F.when(F.col("ts") < horizon, F.col("_n")))
    return (
        since.groupBy(key)
        .agg(F.coalesce(inside, F.lit(0)).alias("reviews_4y"), F.max("ts").alias("last_review_ts"))
        .where((F.col("reviews_4y") > min_reviews) & (F.col("last_review_ts") > horizon))
    )


def sample_rows(df: DataFrame, key: str, rows: int = 100, seed: int = 42) -> DataFrame:
    """A uniform sample of fixed size that is the same in every run and partitioning.

    The rows with the smallest hash of key and seed; a top-k, not a global sort.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.orderBy(draw, F.col(key)).limit(rows)


# --- surveillance tables ------------------------------------------------------------

def season_series(ili: DataFrame) -> DataFrame:
    """Surveillance weeks as season series ``region, year, week, yw, dS, Nmax``.

    ``Nmax`` is the sum of patients over the *calendar* year, taken before the years are
    shifted. Week 53 and the following week 1 fall on the same season week, so ``yw``
    (calendar year and week) is kept as the order of the rows.
    """
    calendar = Window.partitionBy("region", "year")
    counted = ili.withColumn("_nmax", F.sum("total_patients").over(calendar))
    year, week = F.col("year"), F.col("week")
    return counted.select(
        region_number("region").alias("region"),
        season_year(year, week).cast("int").alias("year"),
        season_week(week).cast("int").alias("week"),
        (year * 100 + week).cast("int").alias("yw"),
        F.col("ilitotal").cast("double").alias("dS"),
        F.col("_nmax").cast("double").alias("Nmax"),
    )


# --- running figures ----------------------------------------------------------------

def _along(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "t") -> DataFrame:
    """Number the rows of each series from 1."""
    return df.withColumn(name, F.row_number().over(_along(keys, order)))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "dS", name: str = "m") -> DataFrame:
    upto = _along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(column).over(upto))


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    upto = _along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.avg(column).over(upto))


def lag_diff(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "I", name: str = "dS") -> DataFrame:
    """Change against the row before; NULL at the first row."""
    return df.withColumn(name, F.col(column) - F.lag(column).over(_along(keys, order)))


def less_group_minimum(df: DataFrame, keys: Sequence[str], column: str = "m", name: str = "m_offset") -> DataFrame:
    return df.withColumn(name, F.col(column) - F.min(column).over(Window.partitionBy(*keys)))


def state_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float, column: str = "dS"
) -> DataFrame:
    """Add the infected ``I`` and removed ``R`` that follow from new cases and a recovery rate.

    ``I' = max(1 - gamma, 0) I + dS`` and ``R' = R + min(gamma, 1) I``, from (0, 0), by row
    position. With ``q = 1 - gamma`` the recursion is ``I_t = sum q^(t-i) dS_i``, which two
    running sums give without a fold over a collected list. ``q^-i`` would overflow in long
    series, so the positions are cut into blocks in which it stays below 2^400; the blocks
    before enter through range frames over the block number. Three are enough: beyond them
    ``q^t`` is below the smallest double.
    """
    along = _along(keys, order)
    dS = F.col(column).cast("double")
    keep, leave = max(1.0 - gamma, 0.0), min(gamma, 1.0)
    if keep == 0.0:
        infected = df.withColumn("I", dS)
    elif keep == 1.0:
        infected = running_total(df.withColumn("_ds", dS), keys, order, "_ds", "I").drop("_ds")
    else:
        length = _block_length(keep)
        placed = df.withColumn("_pos", F.row_number().over(along) - 1).withColumns(
            {"_block": F.floor(F.col("_pos") / length), "_at": F.col("_pos") % length}
        )
        in_block = (
            Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        by_block = Window.partitionBy(*keys).orderBy("_block")
        q = F.lit(keep)
        at_end = dS * F.pow(q, F.lit(length - 1) - F.col("_at"))
        # the windows over blocks reuse the sort of the window inside a block
        placed = placed.withColumn("_own", F.sum(dS * F.pow(q, -F.col("_at"))).over(in_block) * F.pow(q, F.col("_at")))
        carried = F.lit(0.0)
        for back in (1, 2, 3):
            block_sum = F.sum(at_end).over(by_block.rangeBetween(-back, -back))
            carried = carried + F.coalesce(block_sum, F.lit(0.0)) * keep ** (length * (back - 1))
        carried = carried * F.pow(q, F.col("_at") + 1)
        infected = placed.withColumn("I", F.col("_own") + carried).drop("_pos", "_block", "_at", "_own")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return infected.withColumn("R", F.lit(leave) * F.coalesce(F.sum("I").over(before), F.lit(0.0)))


def _block_length(keep: float) -> int:
    """Positions after which ``keep`` to that power is about 2^-400."""
    import math

    return max(1, int(400 / -math.log2(keep)))


def actual_trajectories(series: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float) -> DataFrame:
    """Observed counts as ``t, I, R, dS`` with ``t`` the week."""
    return state_fold(series, keys, order, gamma).select(*keys, F.col("week").alias("t"), "I", "R", "dS")


# --- prefixes -----------------------------------------------------------------------

def prefix_levels(samples: int) -> list[float]:
    """Evenly spaced levels of log progress from 0.4 to 1."""
    # the 1e-12 makes a progress that equals a level count as having reached it
    return [0.4 + 0.6 * j / (samples - 1) - 1e-12 for j in range(samples)]


def mark_prefix_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], samples: int, column: str = "dS"
) -> DataFrame:
    """Add position ``t``, running total ``m`` and ``is_point``: is this prefix to be fitted?

    One sample: the whole series only. No fewer samples than rows: every prefix. Otherwise
    the first prefix to reach each of ``samples`` levels of ``ln(m) / ln(total)``. A prefix
    is first at some level if the highest progress so far is above more levels than it was
    one row before; levels that are never reached mark nothing. Prefixes of one row carry
    no pair of steps and are left out, but for the whole series of one row.
    """
    along = _along(keys, order)
    whole = Window.partitionBy(*keys)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns(
        {
            "t": F.row_number().over(along),
            "m": F.sum(column).over(upto),
            "_n": F.count(F.lit(1)).over(whole),
        }
    )
    if samples <= 1:
        return out.withColumn("is_point", F.col("t") == F.col("_n")).drop("_n")
    total = F.sum(column).over(whole)
    progress = F.when(F.col("m") > 0, F.try_divide(F.ln(F.col("m").cast("double")), F.ln(F.col("_total").cast("double"))))
    levels = F.array(*[F.lit(level) for level in prefix_levels(samples)])
    passed = F.size(F.filter(levels, lambda level: F.coalesce(F.col("_best"), F.lit(MINUS_INF)) >= level))
    out = (
        out.withColumn("_total", total)
        .withColumn("_best", F.max(F.when(F.col("_total") > 0, progress)).over(upto))
        .withColumn("_passed", passed)
        .withColumn("_before", F.coalesce(F.lag("_passed").over(along), F.lit(0)))
    )
    thinned = F.col("_passed") > F.col("_before")
    is_point = (F.col("t") > 1) & ((F.lit(samples) >= F.col("_n")) | thinned)
    return out.withColumn("is_point", is_point).drop("_n", "_total", "_best", "_passed", "_before")


def prefix_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], samples: int = 100) -> DataFrame:
    """The prefix lengths ``t`` to fit, per series."""
    return mark_prefix_points(df, keys, order, samples).where("is_point").select(*keys, "t")


def prefix_rows(estimates: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each estimate with the observed rows up to its prefix length ``t``; NULL keys meet.

    ``observed`` has its row number, from 1, in ``step``. A series meets its estimates once, as a sorted
    array, and a prefix is a slice of it, so no rows of one series are paired. The array is bounded by the
    calendar length of the series. A NULL or negative ``t`` has no rows, a larger one than the series all.
    """
    rest = F.struct(*[c for c in observed.columns if c not in keys])
    in_order = F.sort_array(F.collect_list(F.struct(F.col("step").alias("_at"), rest.alias("_row"))))
    series = observed.where("step IS NOT NULL").groupBy(*keys).agg(in_order.alias("_series"))
    prefix = F.slice("_series", F.lit(1), F.greatest(F.col("t"), F.lit(0)).cast("int"))
    met = join_keys(estimates.where("t IS NOT NULL"), series, keys)
    return met.select(*estimates.columns, F.inline(prefix)).select(*estimates.columns, "_row.*")


# --- crossings ----------------------------------------------------------------------

def first_crossing(cond: Column, position: Column, on_missing: str | int | float = "one") -> Column:
    """Aggregate: position of the first row where ``cond`` holds.

    If it never holds the answer is 1 by default, or NULL (``"null"``), or the given
    number. If ``cond`` is NULL throughout, the answer is NULL.
    """
    first = F.min(F.when(cond, position))
    if on_missing == "null":
        return first
    default = 1 if on_missing == "one" else on_missing
    return F.when(F.count(cond) > 0, F.coalesce(first, F.lit(default)))


def last_row(df: DataFrame, keys: Sequence[str], order: Column | str = "t") -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    key = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("_last")).select(*keys, "_last.*")


def first_maximum(df: DataFrame, keys: Sequence[str], value: str, *places: str) -> DataFrame:
    """The row with the largest ``value`` of each key, the first by ``places`` among equals."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(value), *[-F.col(p) for p in places])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_top")).select(*keys, "_top.*")


def observed_peak(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Week and size of the largest weekly count of each series, the earliest among equals."""
    top = first_maximum(series.select(*keys, "week", "yw", "dS"), keys, "dS", "week", "yw")
    return top.select(*keys, F.col("week").alias("peak_t"), F.col("dS").alias("peak_dS"))


# --- keys ---------------------------------------------------------------------------

def key_grid(bounds: DataFrame, **axes: Column) -> DataFrame:
    """All combinations of the key axes, each an array expression over the one row ``bounds``."""
    grid = bounds
    for name, values in axes.items():
        grid = grid.withColumn(f"_{name}", values)
    for name in axes:
        grid = grid.withColumn(name, F.explode(f"_{name}"))
    return grid.select(*axes)


def season_ids(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested years or season numbers as distinct available season numbers, in order.

    If none of them is available, the newest available one.
    """
    asked = requested.select(season_id(F.col("year")).alias("id")).distinct()
    valid = asked.join(available.select("id").distinct(), "id", "left_semi")
    newest = available.agg(F.max("id").alias("id"))
    found = valid.agg(F.count(F.lit(1)).alias("_n")).scalar()
    return valid.unionByName(newest.where(found == 0)).orderBy("id")
