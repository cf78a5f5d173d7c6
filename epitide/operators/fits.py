"""Profile-likelihood fits on parameter grids, for all series and all prefixes at once.

The data of prefix ``t`` are the pairs (state after row i, new cases of row i + 1) for
``i < t``. With ``a = 0`` the rate is ``b I (1 - C / N)`` with ``C = I + R``, so the best
``b`` for a given ``N`` is ``sum X / sum I (1 - C / N)`` and the log likelihood is

    sum X ln I  +  sum X ln(1 - C / N)  +  X. ln b  -  X.        (X. = sum X)

Only the second sum depends on both row and grid point. All sums run along the series, so
one pass serves every prefix, and the grid is laid out inside the partitions that already
hold whole series: the fit needs a single shuffle, of the ungridded rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitide.functions.model import at_grid_end, count_term, log_grid, new_case_rate, safe_ln
from epitide.operators.search import Pairs, Stack, search, search_together
from epitide.operators.series import last_row, mark_prefix_points, state_fold
from epitide.operators.spread import join_keys, spread_rows
from epitide.operators.streams import column, kinds, whole_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: points of the grid of population sizes
SIZE_POINTS = 200


def fit_pairs(
    series: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float, samples: int
) -> DataFrame:
    """Rows ``t`` of each series with the state one row earlier (``I0, R0``) and new cases ``X``."""
    folded = state_fold(spread_rows(series, keys), keys, order, gamma)
    along = Window.partitionBy(*keys).orderBy(*order)
    paired = mark_prefix_points(folded, keys, order, samples).withColumns(
        {"I0": F.lag("I").over(along), "R0": F.lag("R").over(along), "X": F.col("dS").cast("double")}
    )
    return paired


def lagged_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State of each row with the new cases ``X`` of the next row; the last row has none."""
    along = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("X", F.lead("dS").over(along)).where(F.col("X").isNotNull())


def series_bounds(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Search bounds of the population size per series: largest ``I + R`` and ``Nmax``."""
    return states.groupBy(*keys).agg(
        F.max(F.col("I") + F.col("R")).alias("lower"), F.max("Nmax").alias("Nmax")
    )


def poisson_llh(
    pairs: DataFrame,
    keys: Sequence[str],
    a: Column,
    b: Column,
    size: Column,
    form: str = "poisson",
) -> DataFrame:
    """Log likelihood per key of pairs ``I, R, X`` at given parameters.

    ``poisson``: ``X`` new cases in a step. ``exponential``: ``X`` is a waiting time.
    """
    rate = new_case_rate(a, b, F.col("I"), F.col("R"), size)
    one = F.lit(1.0)
    term = count_term(rate, F.col("X"), one) if form == "poisson" else count_term(rate, one, F.col("X"))
    return pairs.groupBy(*keys).agg(F.sum(term).alias("llh"))


def _running_fit_sums(pairs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per row the sums over the pairs so far that do not depend on the population size."""
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i0, c0, x = F.col("I0"), F.col("C0"), F.col("X")
    spoiled = F.when((x > 0) & (i0 <= 0), 1).otherwise(0)
    return (
        pairs.withColumn("C0", i0 + F.col("R0"))
        .withColumns(
            {
                "_x": F.sum(F.when(i0.isNotNull(), x)).over(upto),
                "_i": F.sum(i0).over(upto),
                "_ic": F.sum(i0 * c0).over(upto),
                "_xlni": F.sum(F.when((x > 0) & (i0 > 0), x * F.ln(i0)).otherwise(0.0)).over(upto),
                "_cmax": F.max(c0).over(upto),
                "_spoiled": F.max(F.when(i0.isNotNull(), spoiled)).over(upto),
            }
        )
    )


def _profile(sum_ln_w: Column, size: Column) -> tuple[Column, Column]:
    """(beta, llh) at a population size from the running sums."""
    shrunk = F.col("_i") - F.col("_ic") / size
    beta = F.try_divide(F.col("_x"), shrunk)
    grown = F.when(F.col("_x") > 0, F.col("_x") * safe_ln(beta)).otherwise(0.0)
    return beta, F.col("_xlni") + sum_ln_w + grown - F.col("_x")


def _ln_w(size: Column) -> Column:
    """``X ln(1 - C / N)`` of one pair; nothing where ``X`` is zero or there is no pair."""
    return F.when(F.col("X") * F.coalesce(F.col("C0"), F.lit(0.0)) > 0, F.col("X") * safe_ln(1 - F.col("C0") / size)).otherwise(0.0)


def profile_fit_sir(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gamma: float,
    samples: int = 100,
    points: int = SIZE_POINTS,
) -> DataFrame:
    """Fit size ``N`` and rate ``beta`` of the SIR model on the prefixes of every series.

    The grid of sizes has ``points`` log-spaced values from ``C_1 + 1`` to the largest
    ``Nmax``; a prefix uses those above its own largest ``C``. Log likelihoods are compared
    to 8 digits and the smaller size wins among equals. A prefix without a finite optimum
    (new cases although nobody is infected), or without any grid point above its cases,
    has NULL estimates. :func:`refined_fit_sir` searches on between the grid points.
    """
    pairs = _running_fit_sums(fit_pairs(series, keys, order, gamma, samples), keys, order)
    whole = Window.partitionBy(*keys)
    low = F.min(F.when(F.col("t") == 1, F.col("I") + F.col("R"))).over(whole) + 1
    bounded = pairs.withColumns({"_low": low, "_high": F.max("Nmax").over(whole)})
    gridded = bounded.select(
        *keys, *order, "t", "m", "is_point", "X", "C0", "_x", "_i", "_ic", "_xlni", "_cmax", "_spoiled", "_high",
        F.explode(log_grid(F.col("_low"), F.col("_high"), points)).alias("N"),
    )
    upto = Window.partitionBy(*keys, "N").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = gridded.withColumn("_w", F.sum(_ln_w(F.col("N"))).over(upto)).where("is_point")
    beta, llh = _profile(F.col("_w"), F.col("N"))
    usable = (F.col("N") > F.col("_cmax")) & (F.col("_spoiled") == 0)
    scored = summed.select(
        *keys, "t", "m", "N", "_high", usable.alias("_ok"), beta.alias("beta"), llh.alias("llh")
    ).withColumn("_ok", F.col("_ok") & F.col("beta").isNotNull())
    rank = F.when(F.col("_ok"), F.struct(F.rint(F.col("llh") * 1e8), -F.col("N")))
    best = scored.groupBy(*keys, "t", "m").agg(
        F.max_by(F.struct("N", "beta", "llh"), rank).alias("_best"),
        F.max("_high").alias("_high"),
        F.min(F.when(F.col("_ok"), F.col("N"))).alias("_least"),
    )
    return _estimates(best.select(*keys, "t", "m", "_best.*", "_high", "_least"), keys, gamma)


def _estimates(fitted: DataFrame, keys: Sequence[str], gamma: float) -> DataFrame:
    upper, lower = at_grid_end(F.col("N"), F.col("_least"), F.col("_high"))
    return fitted.select(
        *keys,
        "t",
        "N",
        "beta",
        F.lit(gamma).alias("gamma"),
        F.lit(0.0).alias("a"),
        "llh",
        "m",
        upper.alias("is_ub_binding"),
        lower.alias("is_lb_binding"),
    )


def _fit_together(batch: pa.RecordBatch, starts: np.ndarray, kept: np.ndarray, infected: np.ndarray, cases: np.ndarray, new: np.ndarray,
                  sizes: int, mixes: int, fine: int, levels: int, above: bool = True) -> dict[str, np.ndarray]:
    """:func:`epitide.operators.search.search_together` of the series of a batch, from the pairs of their rows in ``kept``.

    One entry per series, NaN without pairs; beside the fit the bounds ``low`` and ``high``, the mean of the infected and ``norm``, the mean or 1.
    """
    ends = np.append(starts[1:], batch.num_rows)
    before = np.append(0, np.cumsum(kept))
    counts = before[ends] - before[starts]
    some = np.flatnonzero(counts)
    out = {k: np.full(len(starts), np.nan) for k in ("N", "rho", "scale", "llh", "coarse", "least", "low", "mean")}
    out["high"], out["norm"] = np.fmax.reduceat(column(batch, "Nmax").astype(np.float64), starts), np.ones(len(starts))
    if len(some):
        infected, cases, new, begins = infected[kept], cases[kept], new[kept], before[starts[some]]
        out["low"][some] = np.maximum.reduceat(cases, begins) + 1
        out["mean"][some] = np.add.reduceat(infected, begins) / counts[some]
        if mixes > 1:
            out["norm"][some] = np.where(out["mean"][some] == 0, 1.0, out["mean"][some])
        stack = Stack(infected, cases, new, begins, out["low"][some], out["high"][some], out["norm"][some])
        for k, v in search_together(stack, sizes, mixes, fine, levels, above).items():
            out[k][some] = v
    return out


def _refined(series: DataFrame, keys: Sequence[str], order: Sequence[str], gamma: float, reported: float, samples: int,
             sizes: int, mixes: int, fine: int, levels: int, whole: bool) -> DataFrame:
    """:func:`epitide.operators.search.search` of every series.

    ``whole``: only whole series, many of them at a time; sizes and mixes are measured by all pairs, not by the first.
    """
    keys = list(keys)
    pairs = fit_pairs(series, keys, order, gamma, samples)
    rows = pairs.select(*keys, *order, "t", F.col("m").cast("double").alias("m"), "is_point", "I0", "R0", "X", F.col("Nmax").cast("double").alias("Nmax"))

    def estimates(batch, points, found, norm, upper, lower) -> pa.RecordBatch:
        n, rho, scale = (found[k] for k in ("N", "rho", "scale"))
        gone = np.isnan(n)
        columns = [pa.array(column(batch, "t")[points].astype(np.int32)), pa.array(n, mask=gone), pa.array(scale * rho, mask=gone),
                   pa.array(scale * (1 - rho) / norm, mask=gone), pa.array(found["llh"], mask=gone), pa.array(column(batch, "m")[points]),
                   pa.array(upper, mask=gone), pa.array(lower, mask=gone)]
        heads = batch.select(keys).take(pa.array(points))
        return pa.RecordBatch.from_arrays([*heads.columns, *columns],
                                          [*keys, "t", "N", "a", "beta", "llh", "m", "is_ub_binding", "is_lb_binding"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, point, most = (column(batch, c) for c in ("t", "is_point", "Nmax"))
        points = np.flatnonzero(point & ((t > 1) | (mixes == 1)))
        i, r, x = (column(batch, c)[1:].astype(np.float64) for c in ("I0", "R0", "X"))
        seen, ends = Pairs(i, i + r, x), t[points] - 1
        fitted = points[ends > 0]
        found = {k: np.full(len(points), np.nan) for k in ("N", "rho", "scale", "llh", "coarse", "least")}
        norm, high = 1.0, np.nan if np.isnan(most).all() else np.nanmax(most)
        if len(fitted):
            low = (seen.cases.max() if whole else seen.cases[0]) + 1
            if mixes > 1:
                norm = i.mean() if whole else i[0]
            for k, v in search(seen, ends[ends > 0], low, high, norm or 1.0, sizes, mixes, fine, levels).items():
                found[k][ends > 0] = v
        upper, lower = found["coarse"] >= high - 1e-6, found["coarse"] <= found["least"] + 1e-6
        return estimates(batch, points, found, norm or 1.0, upper, lower)

    def run_whole(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        later = np.ones(batch.num_rows, dtype=bool)
        later[starts] = False
        i, r, x = (column(batch, c).astype(np.float64) for c in ("I0", "R0", "X"))
        found = _fit_together(batch, starts, later, i, i + r, x, sizes, mixes, fine, levels)
        points = np.append(starts[1:], batch.num_rows) - 1
        point = np.flatnonzero((points > starts) | (mixes == 1))
        found, points = {k: v[point] for k, v in found.items()}, points[point]
        upper, lower = found["coarse"] >= found["high"] - 1e-6, found["coarse"] <= found["least"] + 1e-6
        return estimates(batch, points, found, found["norm"], upper, lower)

    got = whole_groups(rows, keys, order, run_whole if whole else run,
                       f"{kinds(rows, keys)}, t int, N double, a double, beta double, llh double, m double, "
                       "is_ub_binding boolean, is_lb_binding boolean", together=whole)
    return got.select(*keys, "t", "N", "beta", F.lit(reported).alias("gamma"), "a", "llh",
                      F.col("m").cast(pairs.schema["m"].dataType).alias("m"), "is_ub_binding", "is_lb_binding")


def refined_fit_sir(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gamma: float,
    samples: int = 100,
    points: int = SIZE_POINTS,
    fine_points: int = 21,
    levels: int = 1,
) -> DataFrame:
    """:func:`profile_fit_sir`, searched on ``levels`` times between the grid neighbours of each best size.

    All prefixes whose best size lies in one cell of the grid share its running sums: no prefix is joined with
    its rows. The flags say whether the first grid's best size was at an end. A series is held as a whole, as many rows as it has weeks.
    """
    return _refined(series, keys, order, gamma, gamma, samples, points, 1, fine_points, levels, whole=False).withColumn("a", F.lit(0.0))


def refined_fit_bass(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gamma: float = 0.1,
    samples: int = 1,
    size_points: int = 40,
    mix_points: int = 21,
    fine_points: int = 15,
    levels: int = 2,
) -> DataFrame:
    """:func:`profile_fit_bass`, searched on between the neighbours of the best size and mix; ``samples`` above 1: of prefixes too.

    Two levels of 15 points bring a size to less than 1 %. Whole series have the grid of :func:`profile_fit_bass`; for
    prefixes the sizes begin above the first cases and the mixes are measured by the first state, so
    that the fit of a prefix knows nothing of later rows but ``Nmax``.
    """
    fitted = _refined(series, keys, order, gamma, 0.0, samples, size_points, mix_points, fine_points, levels, whole=samples <= 1)
    return fitted.select(*keys, "t", "N", "a", "beta", "gamma", "llh", "m", "is_ub_binding", "is_lb_binding")


def fit_known_size(
    series: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gamma: float,
    samples: int = 100,
) -> DataFrame:
    """Fit the rate on every prefix with the size of each series given in ``sizes(keys, N)``."""
    known = join_keys(series, sizes, keys)
    pairs = _running_fit_sums(fit_pairs(known, keys, order, gamma, samples), keys, order)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pairs.withColumn("_w", F.sum(_ln_w(F.col("N"))).over(upto)).where("is_point")
    beta, llh = _profile(F.col("_w"), F.col("N"))
    usable = (F.col("N") > F.col("_cmax")) & (F.col("_spoiled") == 0)
    return summed.select(
        *keys,
        "t",
        F.when(usable, F.col("N")).alias("N"),
        F.when(usable, beta).alias("beta"),
        F.lit(gamma).alias("gamma"),
        F.lit(0.0).alias("a"),
        F.when(usable & beta.isNotNull(), llh).alias("llh"),
        "m",
    )


def last_size(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The size of the longest prefix of each series that has an estimate."""
    return estimates.groupBy(*keys).agg(F.max_by("N", "t").alias("N"))


def final_estimate(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return last_row(estimates, keys, "t")


def profile_fit_bass(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    gamma: float = 0.1,
    size_points: int = 40,
    mix_points: int = 21,
) -> DataFrame:
    """Fit size, outside rate ``a`` and inside rate ``b`` of the Bass model to whole series.

    With ``a = s rho`` and ``b = s (1 - rho) / mean I`` the rate is ``s m(rho) w(N)`` where
    ``m = rho + (1 - rho) I / mean I`` and ``w = 1 - C / N``; the best scale is
    ``s = sum X / sum m w``. The likelihood splits into sums that depend on ``N`` or on
    ``rho`` alone, so a series of n rows costs n (G_N + G_rho) terms and not n G_N G_rho. The
    grids stay arrays beside the rows, of many series at a time; likelihoods are compared to 8 digits, and the
    smaller size, then the smaller mix wins among equals. NULL if no pair of grid points has a finite likelihood.
    """
    keys = list(keys)
    pairs = fit_pairs(series, keys, order, gamma, samples=1)
    rows = pairs.select(*keys, *order, "t", F.col("m").cast("double").alias("m"), "I0", "R0", "X", F.col("Nmax").cast("double").alias("Nmax"))
    figures = ["N", "rho", "scale", "llh", "_m", "_high", "_low", "_mean"]

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        i, r, x, m = (column(batch, c).astype(np.float64) for c in ("I0", "R0", "X", "m"))
        kept = ~np.isnan(i + r)
        found = _fit_together(batch, starts, kept, i, i + r, np.where(np.isnan(x), 0.0, x), size_points, mix_points, 0, 0, above=False)
        found |= {"_m": np.fmax.reduceat(m, starts), **{f"_{c}": found[c] for c in ("high", "low", "mean")}}
        some = np.flatnonzero(np.add.reduceat(kept.astype(np.int64), starts))
        heads = batch.select(keys).take(pa.array(starts[some]))
        lengths = np.diff(np.append(starts, batch.num_rows)).astype(np.int32)
        return pa.RecordBatch.from_arrays([*heads.columns, pa.array(lengths[some]), *[pa.array(found[c][some], mask=np.isnan(found[c][some])) for c in figures]],
                                          [*keys, "_n", *figures])

    best = whole_groups(rows, keys, order, run, f"{kinds(rows, keys)}, _n int, {', '.join(f'{c} double' for c in figures)}", together=True)
    upper, lower = at_grid_end(F.col("N"), F.col("_low"), F.col("_high"))
    return best.select(
        *keys,
        F.col("_n").alias("t"),
        "N",
        (F.col("scale") * F.col("rho")).alias("a"),
        F.try_divide(F.col("scale") * (1 - F.col("rho")), F.col("_mean")).alias("beta"),
        F.lit(0.0).alias("gamma"),
        "llh",
        F.col("_m").cast(pairs.schema["m"].dataType).alias("m"),
        upper.alias("is_ub_binding"),
        lower.alias("is_lb_binding"),
    )
