"""Terms of the diffusion models as column expressions.

Spark raises an error on division by zero and gives NULL for ``ln(0)``; the expressions
here say in each case what is meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INF = float("-inf")


def safe_ln(x: Column) -> Column:
    """Natural logarithm, minus infinity where ``x`` is not positive."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(MINUS_INF))


def cumulative_infected(infected: Column, removed: Column) -> Column:
    return infected + removed


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def new_case_rate(a: Column, b: Column, infected: Column, removed: Column, size: Column) -> Column:
    """Expected new cases of the next step: ``(a + b I)(1 - (I + R) / N)``."""
    return (a + b * infected) * (F.lit(1.0) - (infected + removed) / size)


def count_term(rate: Column, weight_log: Column, weight_rate: Column) -> Column:
    """``w1 ln(rate) - w2 rate``. A zero ``w1`` adds nothing, whatever the rate."""
    return F.when(weight_log == 0, F.lit(0.0)).otherwise(weight_log * safe_ln(rate)) - weight_rate * rate


def waiting_rate(alpha: Column, beta: Column, gamma: Column, size: Column, infected: Column, removed: Column) -> Column:
    """Rate of the next event, infection or removal."""
    return (infected * beta + alpha) * (size - infected - removed) / size + gamma * infected


def waiting_logpdf(rate: Column, wait: Column) -> Column:
    """Log density of an exponential waiting time; minus infinity for a rate that is not positive."""
    return F.when(rate > 0, F.ln(rate) - rate * wait).otherwise(F.lit(MINUS_INF))


def fisher_bound(size: Column, beta: Column, gamma: Column, x: Column) -> Column:
    """Upper bound of the information that the case number ``x`` holds on the size; NULL at ``x = N``."""
    left = size - x
    return F.try_divide(x * x, left * size * size * (left + size * gamma / beta))


def sample_threshold(size: Column, beta: Column, gamma: Column, thresh: float = 1.0) -> Column:
    """First case number at which the summed bound allows an error below ``sqrt(thresh)``.

    With ``v = x^2 / ((N - x)(N - x + N gamma / beta))`` the condition
    ``1 / (sum fisher) / N^2 < sqrt(thresh)`` is ``sum v > 1 / sqrt(thresh)``. As
    ``v >= x^2 / (N^2 (1 + gamma / beta))``, the sum over ``1..m`` is at least
    ``m^3 / (3 N^2 (1 + gamma / beta))``; the first crossing is thus no later than the
    cube root below, and only about ``N^(2/3)`` terms are folded, inside the row. The answer
    is 1 when no case number up to N crosses, and ``x = N`` counts as crossed.
    """
    level = 1.0 / thresh**0.5
    odds = gamma / beta
    latest = F.ceil(F.pow(F.lit(3.0 * level) * size * size * (odds + 1), F.lit(1 / 3))) + 1
    last = F.least(F.floor(size), latest)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("found"))

    def step(state: Column, x: Column) -> Column:
        left = size - x
        grown = state["total"] + F.coalesce(
            F.try_divide((x * x).cast("double"), left * (left + size * odds)), F.lit(float("inf"))
        )
        return F.struct(
            grown.alias("total"),
            F.when((state["found"] == 0) & (grown > level), x).otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, step, lambda s: s["found"])
    return F.when(size.isNull() | beta.isNull() | (beta <= 0), F.lit(None).cast("long")).when(
        size < 1, F.lit(1).cast("long")
    ).otherwise(F.greatest(found, F.lit(1).cast("long")))


def at_grid_end(estimate: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(upper, lower): does the estimate touch an end of its grid, within 1e-6?"""
    return estimate >= high - 1e-6, estimate <= low + 1e-6


def at_interval_end(estimate: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(upper, lower): is the estimate within 1/100,000 of the range of an end?"""
    margin = (high - low) / 1e5
    return estimate >= high - margin, estimate <= low + margin


def log_spaced(total: Column, samples: Column) -> Column:
    """Array of whole numbers up to ``total``, evenly spaced on a log scale, without repeats.

    All of ``1..total`` when ``samples`` is not below ``total``. The 1e-9 keeps the last
    point at ``total`` whatever the rounding of exp and ln.
    """
    n = samples.cast("int")
    step = F.ln(total.cast("double")) / samples
    spaced = F.array_distinct(
        F.transform(F.sequence(F.lit(0), n), lambda j: F.floor(F.exp(j * step) + F.lit(1e-9)).cast("long"))
    )
    return F.when(samples >= total, F.sequence(F.lit(1).cast("long"), total.cast("long"))).otherwise(spaced)


def next_log_spaced(k: Column, total: Column, samples: Column) -> Column:
    """The smallest point of :func:`log_spaced` that is not below ``k``; NULL beyond ``total``."""
    step = F.ln(total.cast("double")) / samples
    near = F.ceil(F.ln(k.cast("double")) / step)

    def point(j: Column) -> Column:
        j = F.least(F.greatest(j, F.lit(0)), samples.cast("long"))
        return F.floor(F.exp(j * step) + F.lit(1e-9)).cast("long")

    spaced = F.coalesce(*[F.when(point(near + d) >= k, point(near + d)) for d in (-1, 0, 1)])
    return F.when(k > total, F.lit(None).cast("long")).when(samples >= total, k.cast("long")).otherwise(spaced)


def log_grid(low: Column, high: Column, points: int) -> Column:
    """Array of ``points`` values from ``low`` to ``high``, evenly spaced on a log scale."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda g: low * F.pow(high / low, g / F.lit(float(max(points - 1, 1)))),
    )
