"""Likelihoods of event-level states with waiting times.

``states`` has one row per event of a key, numbered by ``k``, and may be as large as the
event log: a single key can hold a large share of it. Nothing here puts a key on one task.
``states`` comes in the ranges of :func:`epitide.operators.spread.lay_out`.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.functions.model import at_grid_end, at_interval_end, next_log_spaced, waiting_logpdf, waiting_rate
from epitide.operators.spread import join_keys, running
from epitide.operators.streams import column, grid_sums, kinds, running_stream
from epitide.session import cut

# what runs in Python workers goes there by value, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def next_state_pair(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each state but the last with the waiting time of the state after it (``next_wait``).

    ``n_states`` is the number of states of the key.
    """
    paired = running(states, keys, ["k"], totals={"n_states": F.lit(1)}, following={"next_wait": "wait"}, spread=True)
    return paired.where(F.col("next_wait").isNotNull())


def interarrival_llh(
    pairs: DataFrame, alpha: Column, beta: Column, gamma: Column, size: Column, name: str = "llh"
) -> DataFrame:
    """Log density of every waiting time given the state before it."""
    rate = waiting_rate(alpha, beta, gamma, size, F.col("I"), F.col("R"))
    return pairs.withColumn(name, waiting_logpdf(rate, F.col("next_wait")))


def _theta_bounds(param: str, sir: dict[str, float], low: float | None, high: float | None) -> tuple[float, float]:
    return (0.0 if low is None else low, sir[param] * 10 if high is None else high)


def _density(param: str, sir: dict[str, float], theta: np.ndarray):
    """Log densities of the rows of a batch (rows) at every value of one parameter (columns)."""

    def score(batch: pa.RecordBatch) -> np.ndarray:
        infected, removed, wait = (column(batch, c).astype(np.float64)[:, None] for c in ("I", "R", "next_wait"))
        x = sir | {param: theta[None, :]}
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = (infected * x["beta"] + x["alpha"]) * (x["N"] - infected - removed) / x["N"] + x["gamma"] * infected
            llh = np.where(rate > 0, np.log(rate) - rate * wait, -np.inf)
        return np.array(np.broadcast_to(llh, (batch.num_rows, len(theta))))

    return score


def _grid(low: float, high: float, points: int) -> np.ndarray:
    return low + np.arange(points) * ((high - low) / max(points - 1, 1))


def _chosen(batch: pa.RecordBatch, columns: Sequence[str], theta: np.ndarray, at: np.ndarray, llh: np.ndarray) -> pa.RecordBatch:
    """The best points of the rows of a batch, with their likelihoods."""
    row = np.arange(len(at))
    return pa.RecordBatch.from_arrays([*batch.select(list(columns)).columns, pa.array(theta[at]), pa.array(llh[row, at])],
                                      [*columns, "estimate", "llh"])


def grid_search_mle(
    pairs: DataFrame,
    keys: Sequence[str],
    sir: dict[str, float],
    param: str = "beta",
    points: int = 1000,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Best value of one parameter (``alpha``, ``beta``, ``gamma`` or ``N``) after every transition ``k``, on an even grid.

    The running mean of the log densities is compared to 8 digits, the smallest value wins
    among equals; ``llh`` is the density of transition ``k`` alone at the best value. Every range of a
    key is one sorted stream, see :func:`epitide.operators.streams.running_stream`.
    """
    low, high = _theta_bounds(param, sir, low, high)
    theta, columns = _grid(low, high, points), [*keys, "k"]
    rows = pairs.select(*keys, "_part", "k", "I", "R", "next_wait")

    def pick(batch, scores, sums):
        return _chosen(batch, columns, theta, np.argmax(np.rint(sums / column(batch, "k")[:, None] * 1e8), axis=1), scores)

    best = running_stream(rows, keys, ["k"], points, _density(param, dict(sir), theta), pick, _schema(rows, columns))
    upper, lower = at_grid_end(F.col("estimate"), F.lit(low), F.lit(high))
    return best.select(
        *keys, "k", "estimate", upper.alias("is_ub_binding"), lower.alias("is_lb_binding"), "llh"
    )


def _schema(rows: DataFrame, columns: Sequence[str]) -> str:
    return f"{kinds(rows, columns)}, estimate double, llh double"


def log_prefix_mle(
    pairs: DataFrame,
    keys: Sequence[str],
    sir: dict[str, float],
    param: str = "beta",
    points: int = 1000,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Best value of one parameter on log-spaced prefixes of ``10 < k < n`` states.

    A prefix of ``k`` states has ``k - 1`` transitions, the last of which marks it; the running sums
    are carried along the ranges, as in :func:`grid_search_mle`.
    """
    low, high = _theta_bounds(param, sir, low, high)
    k = F.col("k") + 1
    marked = (k > 10) & (k < F.col("n_states")) & (next_log_spaced(k, F.lit(float(sir["N"])), F.col("n_states")) == k)
    rows = pairs.select(*keys, "_part", "k", "I", "R", "next_wait", F.coalesce(marked, F.lit(False)).alias("is_last"))
    theta, columns = _grid(low, high, points), [*keys, "k"]

    def pick(batch, scores, sums):
        last = np.flatnonzero(column(batch, "is_last"))
        return _chosen(batch.take(pa.array(last)), columns, theta, np.argmax(np.rint(sums[last] * 1e6), axis=1), sums[last])

    best = running_stream(rows, keys, ["k"], points, _density(param, dict(sir), theta), pick, _schema(rows, columns))
    upper, lower = at_interval_end(F.col("estimate"), F.lit(low), F.lit(high))
    return best.select(
        *keys, "estimate", "llh", upper.alias("is_ub_binding"), lower.alias("is_lb_binding"), (F.col("k") + 1).alias("k")
    )


def _weighted_rows(states: DataFrame, keys: Sequence[str], use_weights: bool) -> DataFrame:
    """States with a waiting time, their weight (``I``, or 1) and the range they lie in."""
    weight = F.col("I").cast("double") if use_weights else F.lit(1.0)
    return states.where(F.col("wait").isNotNull()).withColumn("_w", weight)


def weighted_llh(
    states: DataFrame,
    keys: Sequence[str],
    a: Column,
    g: Column,
    size: Column,
    betas: tuple[float, float, int],
    use_weights: bool = True,
) -> DataFrame:
    """Weighted log likelihood per key on a grid of rates ``(low, high, points)``.

    Weights are ``I``, or 1. States without a waiting time are left out. A row is scored at all rates within
    its batch; what leaves a task is one array of sums for each key.
    """
    low, high, points = betas
    beta, keys = _grid(low, high, points), list(keys)
    rows = _weighted_rows(states, keys, use_weights).select(
        *keys, "I", "R", "wait", "_w", a.cast("double").alias("_a"), g.cast("double").alias("_g"), size.cast("double").alias("_n"))

    def score(batch):
        infected, removed, wait, w, a0, g0, n = (column(batch, c).astype(np.float64) for c in ("I", "R", "wait", "_w", "_a", "_g", "_n"))
        left = 1 - (infected + removed) / n
        rate = (a0[:, None] + beta[None, :] * infected[:, None]) * left[:, None]
        return _weighted_terms(rate, (g0 * infected)[:, None], wait, w)

    def finish(heads, sums):
        where = pa.array(np.repeat(np.arange(len(sums)), points))
        return pa.RecordBatch.from_arrays([*heads.take(where).columns, pa.array(np.tile(beta, len(sums))), pa.array(sums.ravel())],
                                          [*keys, "beta", "llh"])

    return grid_sums(rows, keys, points, score, finish, f"{kinds(rows, keys)}, beta double, llh double")


def _weighted_terms(rate: np.ndarray, leaving: np.ndarray, wait: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``(ln(rate + g I) - T rate + g I) w`` of rows and points; the last ``g I`` enters with a plus sign."""
    with np.errstate(divide="ignore", invalid="ignore"):
        total = rate + leaving
        out = np.where(total > 0, np.log(total), -np.inf)
        out -= wait[:, None] * rate
        out += leaving
        out *= weight[:, None]
    return out


#: free parameters of :func:`weighted_mle` in the order of its lattice
AXES = ("N", "beta", "a", "gamma")


def weighted_mle(
    states: DataFrame,
    keys: Sequence[str],
    a: float | None = None,
    beta: float | None = None,
    gamma: float | None = None,
    size: float | None = None,
    size_max: float = 1e5,
    rate_max: float = 1e3,
    gamma_max: float = 1.0,
    use_weights: bool = True,
    points: dict[str, int] | None = None,
    levels: int = 4,
) -> DataFrame:
    """Parameters that maximise the weighted likelihood of every key; those that are given stay fixed.

    Columns: keys, N, beta, a, gamma, llh and for each parameter whether it is at the upper or lower end of its range
    (``N_is_ub``, ``N_is_lb``, ...; false for fixed ones).

    The ranges come from the key's own data. ``N`` lies between max(I + R) + 1 and ``size_max``. As
    every rate is at least ``b I (1 - C / N)`` and at least ``a (1 - C / N)``, the best ``b`` is no larger than
    ``sum w / sum w T I (1 - C / N)`` and the best ``a`` than ``sum w / sum w T (1 - C / N)``, whatever the others are: they
    are searched as shares of these bounds, or of ``rate_max`` where that is less. As written, the
    likelihood grows without bound in ``gamma``, so that needs ``gamma_max``.

    The box is searched ``levels`` times: a lattice of ``points`` values an axis (the size on a log scale), then the box
    between the neighbours of the best point. One level is one pass over the states, which meet the
    key's box in groups no larger than a range, where only the logarithms depend on both state and point: all other terms come
    from the key's sums. Likelihoods are compared to 3 digits; the smaller size,
    then the smaller rate wins among equals. States of weight zero add nothing. A key without a finite likelihood, or with no size
    above its cases, has NULL estimates.
    """
    keys, given = list(keys), {"N": size, "beta": beta, "a": a, "gamma": gamma}
    counts = {x: 1 if given[x] is not None else (points or {}).get(x, {"N": 13, "beta": 17, "a": 5, "gamma": 5}[x]) for x in AXES}
    width = int(np.prod(list(counts.values())))
    shape = tuple(counts[x] for x in AXES)
    w, c, wait, infected = F.col("_w"), F.col("I") + F.col("R"), F.col("wait"), F.col("I")
    rows = _weighted_rows(states, keys, use_weights).where(w != 0).select(*keys, "_part", "I", "R", "wait", "_w")
    stats = rows.groupBy(*keys).agg(
        (F.max(c) + 1).alias("_low"), F.sum(w).alias("_sw"),
        F.sum(w * wait * infected).alias("_bi"), F.sum(w * wait * infected * c).alias("_bic"),
        F.sum(w * wait).alias("_ai"), F.sum(w * wait * c).alias("_aic"),
        F.sum(w * infected).alias("_wi"))
    bounds = ["_low", "_sw", "_bi", "_bic", "_ai", "_aic", "_wi"]
    box = [f"_{x}_{end}" for x in AXES for end in ("lo", "hi")]
    best = [*AXES, "llh"]
    whole = cut(stats.select(*keys, *bounds, *[F.lit(0.0 if b.endswith("lo") else 1.0).alias(b) for b in box]), "boxes")
    boxes = whole.where(F.col("_low") <= (size_max if size is None else size))
    places = cut(rows.select(*keys, "_part").distinct(), "places")
    state = [*keys, *bounds, *box]

    def lattice(batch: pa.RecordBatch) -> list[np.ndarray]:
        """The parameters of every point of each row's lattice: rows x N x beta x a x gamma, with length 1 where they do not vary."""
        value = {b: column(batch, b) for b in (*bounds, *box)}
        share = {x: value[f"_{x}_lo"][:, None] + (value[f"_{x}_hi"] - value[f"_{x}_lo"])[:, None] * (np.arange(counts[x]) / max(counts[x] - 1, 1))
                 for x in AXES}
        n = (value["_low"][:, None] * (size_max / value["_low"][:, None]) ** share["N"] if size is None else np.full((batch.num_rows, 1), float(size)))
        n = n[:, :, None, None, None]
        out = [n]
        for x, plain, shrunk in (("beta", "_bi", "_bic"), ("a", "_ai", "_aic")):
            if given[x] is not None:
                out.append(np.full((1, 1, 1, 1, 1), float(given[x])))
                continue
            below = value[plain][:, None, None, None, None] - value[shrunk][:, None, None, None, None] / n
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.where(below > 0, np.minimum(value["_sw"][:, None, None, None, None] / below, rate_max), rate_max)
            s = share[x]
            out.append(most * (s[:, None, :, None, None] if x == "beta" else s[:, None, None, :, None]))
        out.append(np.full((1, 1, 1, 1, 1), float(gamma)) if gamma is not None else gamma_max * share["gamma"][:, None, None, None, :])
        return out

    def score(batch):
        i, r, w = (column(batch, c).astype(np.float64)[:, None, None, None, None] for c in ("I", "R", "_w"))
        n, b, a0, g = lattice(batch)
        out = np.empty((len(w), *shape))
        np.add((a0 + b * i) * (1 - (i + r) / n), g * i, out=out)
        np.maximum(out, 0.0, out=out)
        with np.errstate(divide="ignore", invalid="ignore"):
            np.log(out, out=out)
            out *= w
        return out.reshape(len(w), width)

    def linear(heads: pa.RecordBatch) -> np.ndarray:
        """The terms ``(g I - T rate) w`` summed over a key's states, at every point: they need no more than the key's figures."""
        n, b, a0, g = lattice(heads)
        ai, aic, bi, bic, wi = (column(heads, c)[:, None, None, None, None] for c in ("_ai", "_aic", "_bi", "_bic", "_wi"))
        values = g * wi - a0 * (ai - aic / n) - b * (bi - bic / n)
        return np.broadcast_to(values, (heads.num_rows, *shape)).reshape(heads.num_rows, width)

    def finish(heads, sums):
        sums = sums + linear(heads)
        ranked = np.where(np.isnan(sums), -np.inf, np.rint(sums * 1e3))
        at = np.unravel_index(np.argmax(ranked, axis=1), shape)
        row = np.arange(len(sums))
        finite = np.isfinite(ranked[row, np.argmax(ranked, axis=1)])
        found = [np.broadcast_to(x, (len(sums), *shape))[(row, *at)] for x in lattice(heads)]
        found.append(sums[row, np.argmax(ranked, axis=1)])
        columns = [heads.column(k) for k in (*keys, *bounds)]
        for x, place in zip(AXES, at):
            lo, hi = column(heads, f"_{x}_lo"), column(heads, f"_{x}_hi")
            step = (hi - lo) / max(counts[x] - 1, 1)
            here = lo + (hi - lo) * (place / max(counts[x] - 1, 1))
            columns += [pa.array(np.maximum(here - step, 0.0)), pa.array(np.minimum(here + step, 1.0))]
        columns += [pa.array(np.where(finite, x, np.nan), mask=~finite) for x in found]
        return pa.RecordBatch.from_arrays(columns, [*state, *best])

    schema = f"{kinds(whole, state)}, {', '.join(f'{x} double' for x in best)}"
    for _ in range(levels):
        placed = join_keys(rows, join_keys(places, boxes.select(*state), keys), [*keys, "_part"])
        boxes = cut(grid_sums(placed, keys, width, score, finish, schema, carried=[*bounds, *box]), "boxes")
    found = join_keys(whole.select(*keys), boxes, keys, "left")
    never = F.lit(False)
    ends = []
    for x, low, high in (("N", F.col("_low"), F.lit(size_max)), ("beta", F.lit(0.0), F.lit(rate_max)),
                         ("a", F.lit(0.0), F.lit(rate_max)), ("gamma", F.lit(0.0), F.lit(gamma_max))):
        upper, lower = at_interval_end(F.col(x), low, high) if given[x] is None else (never, never)
        ends += [upper.alias(f"{x}_is_ub"), lower.alias(f"{x}_is_lb")]
    return found.select(*keys, *best, *ends)
