"""When has a series enough data? Crossing tables, distributions and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitide.functions.model import ratio, sample_threshold
from epitide.operators.series import first_crossing, observed_peak
from epitide.operators.spread import exact_median, join_keys, lay_out, running
from epitide.session import cut


def final_results(final: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final estimates with the case numbers needed for an error below 1 and below ``sqrt(0.5)``."""
    size, beta, gamma = F.col("N"), F.col("beta"), F.col("gamma")
    return final.select(
        *keys,
        sample_threshold(size, beta, gamma).alias("m_star"),
        sample_threshold(size, beta, gamma, 0.5).alias("m_star_50"),
        size.alias("Ntrue"),
        "beta",
        "gamma",
    )


def estimates_peaks_data(final: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each observed row with the final estimate and the peak of its series."""
    peaks = observed_peak(series, keys)
    return join_keys(join_keys(final, peaks, keys), series, keys)


def quarter_crossing(joined: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First rows at which the cases pass a quarter of the size, and the sample threshold."""
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = joined.withColumns({"m": F.sum("dS").over(upto), "_pos": F.row_number().over(along)})
    grown = m.withColumn("_grown", F.col("m") - F.min("m").over(Window.partitionBy(*keys)))
    return grown.groupBy(*keys, "peak_t").agg(
        first_crossing(F.col("_grown") > F.col("Ntrue") / 4, F.col("_pos")).alias("const_frac_t"),
        first_crossing(F.col("_grown") > F.col("m_star"), F.col("_pos")).alias("mstar_t"),
    )


def data_agg_leftovers(series: DataFrame, ensemble: DataFrame, left: DataFrame, keys: Sequence[str],
                       after_year: int | None = 2010) -> DataFrame:
    """Observed rows with the ensemble figures of their season and what the last one left over."""
    kept = series if after_year is None else series.where(F.col("year") > after_year)
    return join_keys(join_keys(kept, ensemble, keys), left, keys)


def crossing_report(joined: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First rows at which the cases, less the leftover, pass the thresholds, and the peak row."""
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumns(
        {"m": F.sum("dS").over(upto) - F.col("m_leftover"), "_pos": F.row_number().over(along)}
    )
    m, pos = F.col("m"), F.col("_pos")
    return placed.groupBy(*keys).agg(
        first_crossing(m > F.col("m_star"), pos).alias("m_star_t"),
        first_crossing(m > F.col("m_star_50"), pos).alias("m_star_50_t"),
        F.coalesce(first_crossing(m > F.col("m_peak") / 4, pos), F.lit(52)).alias("m_peak_t"),
        F.max_by(pos, F.struct(F.col("dS"), -pos)).alias("peak_t"),
    )


def median_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact median of ``a / b`` over all rows."""
    rows = df.select(F.lit(1).alias("_every"), ratio(F.col(a), F.col(b)).alias("median_ratio"))
    return exact_median(rows, ["_every"], ["median_ratio"]).drop("_every")


def share_of_total(df: DataFrame, count: str = "n", name: str = "share") -> DataFrame:
    """Each row's part of the total over all rows; the total is one aggregated number.

    ``df`` is cut first: what leads to it is worked out once, not once more for the total.
    """
    df = cut(df, "counts")
    total = df.agg(F.sum(count).alias("_total")).scalar()
    return df.withColumn(name, F.col(count) / total)


def joint_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of rows per pair of values, and whole percents (half to even) as a fraction."""
    counts = cut(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("_total")).scalar()
    return counts.select(a, b, "n", (F.bround(F.col("n") * 100 / total) / 100).alias("pct"))


def hist_share(df: DataFrame, value: Column, binwidth: float = 1.0) -> DataFrame:
    """Histogram with bins centred on multiples of the width and closed on the right; share of all."""
    bins = df.where(value.isNotNull()).groupBy((F.ceil(value / binwidth - 0.5) * binwidth).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_of_total(bins, "n", "share")


def ecdf(df: DataFrame, value: str, by: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Empirical distribution: each distinct value with the share of rows not above it.

    Equal values are counted first, map-side. ``whole`` says that the values are numbers of
    weeks, of which there are few; otherwise the running counts go by ranges of values, so
    that a distribution over very many values is not put on one task. The rows are the same; a NULL
    group is a group.
    """
    by = list(by)
    base = df.where(F.col(value).isNotNull())
    group = by or ["_every"]
    if not by:
        base = base.withColumn("_every", F.lit(1))
    counts = base.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_cnt"))
    if whole:
        along = Window.partitionBy(*group).orderBy(value)
        upto = F.sum("_cnt").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = counts.withColumns({"_upto": upto, "_n": F.sum("_cnt").over(Window.partitionBy(*group))})
    else:
        counts = cut(counts, "counts")
        laid = lay_out(counts, group, [value], size=counts.count())
        ranked = running(laid, group, [value], sums={"_upto": F.col("_cnt")}, totals={"_n": F.col("_cnt")})
    return ranked.select(*by, value, (F.col("_upto") / F.col("_n")).alias("ecdf"))
