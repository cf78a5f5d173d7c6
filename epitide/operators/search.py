"""Profile likelihoods of one series on cells of a grid: all prefixes at once, from coarse to fine.

With rate ``s m w``, where ``m = rho + (1 - rho) I / norm`` and ``w = 1 - C / N``, the best scale of the pairs so far is
``s = sum X / sum m w``, and the logarithms are a sum that depends on ``N`` alone and one that depends
on the mix ``rho`` alone. Both are running sums along the series, so a grid is weighed for every prefix
in n (G + H) logarithms. A finer grid belongs to the cell of a coarser one, and all prefixes
whose optimum lies in the same cell share its running sums.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: prefixes times grid points weighed at a time
BLOCK = 1 << 20

#: rows, or series, times grid points worked out at a time where many series are searched together: what a core's cache holds
TOGETHER = 1 << 16


@dataclass
class Pairs:
    """State after each row (infected, cases so far) and the new cases of the next one, with their running sums."""

    infected: np.ndarray
    cases: np.ndarray
    new: np.ndarray

    def __post_init__(self):
        self.sums = {"x": np.cumsum(self.new), "i": np.cumsum(self.infected), "c": np.cumsum(self.cases),
                     "ic": np.cumsum(self.infected * self.cases), "n": np.arange(1, len(self.new) + 1.0),
                     "most": np.maximum.accumulate(self.cases)}

    def logs(self, inner: np.ndarray) -> np.ndarray:
        """Running sums of X ln(inner) for every grid point; nothing where X is zero."""
        x = self.new[:, None]
        return np.cumsum(np.where(x > 0, x * np.log(np.where(inner > 0, inner, 0.0)), 0.0), axis=0)


def weigh(pairs: Pairs, ends: np.ndarray, sizes: np.ndarray, mixes: np.ndarray, norm: float):
    """(rank, scale, llh) of every prefix (its number of pairs in ``ends``), size and mix.

    The rank is the likelihood to 8 digits, minus infinity where a size is not above the cases so far or no likelihood is finite.
    """
    by_size = pairs.logs(1 - pairs.cases[:, None] / sizes)[ends - 1][:, :, None]
    by_mix = pairs.logs(mixes + (1 - mixes) * pairs.infected[:, None] / norm)[ends - 1][:, None, :]
    x, i, c, ic, n, most = (pairs.sums[k][ends - 1][:, None, None] for k in ("x", "i", "c", "ic", "n", "most"))
    size = sizes[None, :, None]
    scale = x / (mixes * (n - c / size) + (1 - mixes) * (i - ic / size) / norm)
    llh = by_size + by_mix + np.where(x > 0, x * np.log(np.where(scale > 0, scale, 0.0)), 0.0) - x
    fits = (size > most) & np.isfinite(scale) & np.isfinite(llh)
    return np.where(fits, np.rint(llh * 1e8), -np.inf), scale, llh


def log_points(low: float, high: float, points: int) -> np.ndarray:
    return low * (high / low) ** (np.arange(points) / max(points - 1, 1))


def search(pairs: Pairs, ends: np.ndarray, low: float, high: float, norm: float, sizes: int, mixes: int, fine: int, levels: int) -> dict:
    """Best N, rho, scale and llh of every prefix (NaN without a finite one), and N of the first grid and the smallest N in use there.

    The first grid has ``sizes`` log-spaced sizes from ``low`` to ``high`` and ``mixes`` even mixes (one: no mix, rho 0).
    Each of ``levels`` further grids has ``fine`` points between the neighbours of the best point, and that point.
    Among equals the smaller size, then the smaller mix wins.
    """
    out = {k: np.full(len(ends), np.nan) for k in ("N", "rho", "scale", "llh", "coarse", "least")}
    if not len(ends) or not low > 0 or not high >= low:
        return out
    ratio, step = (high / low) ** (1 / max(sizes - 1, 1)), 1 / max(mixes - 1, 1)
    cells = {(low, high, 0.0, 1.0, None, None): np.arange(len(ends))}
    with np.errstate(all="ignore"):
        for level in range(levels + 1):
            for (a, b, c, d, n0, rho0), rows in cells.items():
                if level == 0:
                    size, mix = log_points(a, b, sizes), np.arange(mixes) * step
                else:
                    size = np.unique(np.append(log_points(a, b, fine), n0))
                    mix = np.unique(np.append(c + (d - c) * (np.arange(fine) / max(fine - 1, 1)), rho0)) if mixes > 1 else np.zeros(1)
                at_once = max(1, BLOCK // (len(size) * len(mix)))
                for k in range(0, len(rows), at_once):
                    part = rows[k:k + at_once]
                    rank, scale, llh = weigh(pairs, ends[part], size, mix, norm)
                    flat = rank.reshape(len(part), -1)
                    best = np.argmax(flat, axis=1)
                    row = np.arange(len(part))
                    found = np.isfinite(flat[row, best])
                    g, h = np.unravel_index(best, rank.shape[1:])
                    for name, value in (("N", size[g]), ("rho", mix[h]), ("scale", scale[row, g, h]), ("llh", llh[row, g, h])):
                        out[name][part] = np.where(found, value, np.nan)
                    if level == 0:
                        usable = np.isfinite(rank).any(axis=2)
                        out["coarse"][part] = out["N"][part]
                        out["least"][part] = np.where(found, size[np.argmax(usable, axis=1)], np.nan)
            if level == levels:
                break
            cells, r = {}, ratio
            for p in np.flatnonzero(np.isfinite(out["N"])):
                n, rho = out["N"][p], out["rho"][p]
                box = (max(n / r, pairs.sums["most"][ends[p] - 1]), min(n * r, high), max(rho - step, 0.0), min(rho + step, 1.0), n, rho)
                cells.setdefault(box, []).append(p)
            cells = {box: np.array(rows) for box, rows in cells.items()}
            ratio, step = ratio ** (2 / max(fine - 1, 1)), 2 * step / max(fine - 1, 1)
    return out


@dataclass
class Stack:
    """The pairs of many whole series one after another, ``starts`` where each begins; no series is empty. Figures of a series: arrays of that length."""

    infected: np.ndarray
    cases: np.ndarray
    new: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def __post_init__(self):
        self.counts = np.diff(np.append(self.starts, len(self.new)))
        sums = {"x": self.new, "i": self.infected, "c": self.cases, "ic": self.infected * self.cases}
        self.sums = {k: np.add.reduceat(v, self.starts) for k, v in sums.items()}
        self.most = np.maximum.reduceat(self.cases, self.starts)

    def logs(self, inner: np.ndarray) -> np.ndarray:
        """Sums of X ln(inner), grid points x rows, for every series (rows) and grid point (columns)."""
        terms = np.where(self.new > 0, self.new * np.log(np.where(inner > 0, inner, 0.0)), 0.0)
        return np.add.reduceat(terms, self.starts, axis=1).T

    def weigh(self, sizes: np.ndarray, mixes: np.ndarray, above: bool):
        """(rank, scale, llh) of every series, size and mix as in :func:`weigh`; each series has its own sizes and mixes."""
        by_size = self.logs(1 - self.cases / np.repeat(sizes.T, self.counts, axis=1))[:, :, None]
        mix = np.repeat(mixes.T, self.counts, axis=1)
        by_mix = self.logs(mix + (1 - mix) * (self.infected / np.repeat(self.norm, self.counts)))[:, None, :]
        x, i, c, ic = (self.sums[k][:, None] for k in ("x", "i", "c", "ic"))
        plain, shrunk = self.counts[:, None] - c / sizes, (i - ic / sizes) / self.norm[:, None]
        rho = mixes[:, None, :]
        scale = x[:, :, None] / (rho * plain[:, :, None] + (1 - rho) * shrunk[:, :, None])
        x = x[:, :, None]
        llh = by_size + by_mix + np.where(x > 0, x * np.log(np.where(scale > 0, scale, 0.0)), 0.0) - x
        fits = np.isfinite(scale) & np.isfinite(llh)
        if above:
            fits &= (sizes > self.most[:, None])[:, :, None]
        return np.where(fits, np.rint(llh * 1e8), -np.inf), scale, llh

    def blocks(self, points: int, grid: int) -> Iterator[slice]:
        """Runs of series with about ``TOGETHER`` rows times points and series times grid points; a longer series is alone."""
        ends, first = self.starts + self.counts, 0
        rows, series = max(1, TOGETHER // points), max(1, TOGETHER // grid)
        while first < len(ends):
            last = min(max(int(np.searchsorted(ends, self.starts[first] + rows, side="right")), first + 1), first + series)
            yield slice(first, last)
            first = last

    def part(self, which: slice) -> Stack:
        begin, end = self.starts[which.start], self.starts[which.stop - 1] + self.counts[which.stop - 1]
        return Stack(self.infected[begin:end], self.cases[begin:end], self.new[begin:end], self.starts[which] - begin,
                     self.low[which], self.high[which], self.norm[which])


def search_together(stack: Stack, sizes: int, mixes: int, fine: int, levels: int, above: bool = True) -> dict:
    """:func:`search` of the whole of every series, many series at a time.

    ``above``: only sizes above a series' cases are in use, and a series whose ``low`` is above its ``high`` has no size.
    """
    parts = [_search_part(stack.part(b), sizes, mixes, fine, levels, above) for b in stack.blocks(sizes + mixes, sizes * mixes)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("N", "rho", "scale", "llh", "coarse", "least")}


def _search_part(stack: Stack, sizes: int, mixes: int, fine: int, levels: int, above: bool) -> dict:
    n, row = len(stack.starts), np.arange(len(stack.starts))
    out = {k: np.full(n, np.nan) for k in ("N", "rho", "scale", "llh", "coarse", "least")}
    with np.errstate(all="ignore"):
        low, high = stack.low[:, None], stack.high[:, None]
        ratio, step = (stack.high / stack.low) ** (1 / max(sizes - 1, 1)), 1 / max(mixes - 1, 1)
        size, mix = log_points(low, high, sizes), np.tile(np.arange(mixes) * step, (n, 1))
        usable = (stack.low > 0) & (stack.high >= stack.low) if above else np.ones(n, dtype=bool)
        for level in range(levels + 1):
            rank, scale, llh = stack.weigh(size, mix, above)
            flat = rank.reshape(n, -1)
            best = np.argmax(flat, axis=1)
            found = usable & np.isfinite(flat[row, best])
            g, h = np.unravel_index(best, rank.shape[1:])
            for name, value in (("N", size[row, g]), ("rho", mix[row, h]), ("scale", scale[row, g, h]), ("llh", llh[row, g, h])):
                out[name] = np.where(found, value, np.nan)
            if level == 0:
                out["coarse"] = out["N"]
                out["least"] = np.where(found, size[row, np.argmax(np.isfinite(rank).any(axis=2), axis=1)], np.nan)
            if level == levels:
                break
            best_size, best_mix = out["N"][:, None], out["rho"][:, None]
            size = log_points(np.maximum(best_size / ratio[:, None], stack.most[:, None]), np.minimum(best_size * ratio[:, None], high), fine)
            size = np.sort(np.append(size, best_size, axis=1), axis=1)
            if mixes > 1:
                a, b = np.maximum(best_mix - step, 0.0), np.minimum(best_mix + step, 1.0)
                mix = np.sort(np.append(a + (b - a) * (np.arange(fine) / max(fine - 1, 1)), best_mix, axis=1), axis=1)
            else:
                mix = np.zeros((n, 1))
            ratio, step = ratio ** (2 / max(fine - 1, 1)), 2 * step / max(fine - 1, 1)
    return out
