"""The check of every registered query as DuckDB SQL over the views of ``sqlcheck.views``."""

from sqlcheck.views import with_views

_FOLD = """
    SELECT region, year, yw, week, "dS", round("I", 6) AS "I",
           round(0.24 * coalesce(sum("I") OVER (PARTITION BY region, year ORDER BY yw
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "R"
    FROM (SELECT b.region, b.year, b.yw, b.week, b."dS", sum(a."dS" * pow(1 - 0.24, b.t - a.t)) AS "I"
          FROM placed AS b JOIN placed AS a ON a.region = b.region AND a.year = b.year AND a.t <= b.t
          GROUP BY b.region, b.year, b.yw, b.week, b."dS")"""

_SERIES = 'SELECT region, year, week, yw, "dS", "Nmax" FROM series'

_WEIGHTED = """
    SELECT user_id, round(beta, 6) AS beta,
           round(sum(((CASE WHEN lam + 0.1 * "I" > 0 THEN ln(lam + 0.1 * "I") ELSE '-inf'::DOUBLE END)
                      - wait * lam + 0.1 * "I") * {weight}), 2) AS llh
    FROM (SELECT *, (0.0 + beta * "I") * (1 - ("I" + "R") / 1000.0) AS lam
          FROM states, (SELECT g * (3.0 / 999) AS beta FROM range(1000) AS r(g)) WHERE wait IS NOT NULL)
    GROUP BY user_id, beta"""


def _bass(start: str, keys: str, prefixes: bool, levels: int = 2, sizes: int = 40, mixes: int = 21, fine: int = 15) -> str:
    """Bass fits searched on inside the cell of the best size and mix. ``start`` defines steps: keys, t, x, m, high and i, c of the row before."""
    ends = f"SELECT {keys}, t AS e FROM steps WHERE t > 1" if prefixes else f"SELECT {keys}, max(t) AS e FROM steps GROUP BY {keys} HAVING max(t) > 1"
    low, norm = ("arg_min(c, t)", "coalesce(nullif(arg_min(i, t), 0), 1)") if prefixes else ("max(c)", "coalesce(nullif(avg(i), 0), 1)")
    ctes = [start, f"ends AS ({ends})",
            f"fit AS (SELECT {keys}, t, x, i, c FROM steps WHERE c IS NOT NULL)",
            f"bounds AS (SELECT {keys}, {low} + 1 AS low, {norm} AS norm FROM fit GROUP BY {keys})",
            f"tops AS (SELECT {keys}, max(high) AS high FROM steps GROUP BY {keys})",
            f"""sums AS (
                SELECT {keys}, e, low, high, norm, sum(x) AS sx, sum(i) AS si, sum(c) AS sc, sum(i * c) AS sic, count(*) AS n, max(c) AS most
                FROM ends JOIN fit USING ({keys}) JOIN bounds USING ({keys}) JOIN tops USING ({keys}) WHERE t <= e GROUP BY {keys}, e, low, high, norm)""",
            f"cells0 AS (SELECT *, pow(high / low, 1.0 / {sizes - 1}) AS ratio, 1.0 / {mixes - 1} AS step FROM sums)"]
    for l in range(levels + 1):
        if l == 0:
            grids = (f"SELECT {keys}, e, low * pow(high / low, g / {sizes - 1}.0) AS size FROM cells0, range({sizes}) AS r(g)",
                     f"SELECT {keys}, e, k / {mixes - 1}.0 AS rho FROM cells0, range({mixes}) AS r(k)")
        else:
            grids = (f"SELECT {keys}, e, lo * pow(hi / lo, g / {fine - 1}.0) AS size FROM cells{l}, range({fine}) AS r(g) UNION SELECT {keys}, e, size FROM cells{l}",
                     f"SELECT {keys}, e, mlo + (mhi - mlo) * (k / {fine - 1}.0) AS rho FROM cells{l}, range({fine}) AS r(k) UNION SELECT {keys}, e, rho FROM cells{l}")
        ctes += [f"""
        bysize{l} AS (
            SELECT {keys}, e, size, sum(CASE WHEN x > 0 THEN x * ln(1 - c / size) ELSE 0 END) AS lw
            FROM ({grids[0]}) JOIN sums USING ({keys}, e) JOIN fit USING ({keys}) WHERE t <= e AND size > most GROUP BY {keys}, e, size)""",
                 f"""
        bymix{l} AS (
            SELECT {keys}, e, rho, sum(CASE WHEN x <= 0 THEN 0 WHEN rho + (1 - rho) * i / norm > 0 THEN x * ln(rho + (1 - rho) * i / norm) ELSE '-inf'::DOUBLE END) AS lm
            FROM ({grids[1]}) JOIN sums USING ({keys}, e) JOIN fit USING ({keys}) WHERE t <= e GROUP BY {keys}, e, rho)""",
                 f"""
        tried{l} AS (
            SELECT *, lw + lm + CASE WHEN sx > 0 THEN sx * ln(scale) ELSE 0 END - sx AS llh FROM (
                SELECT *, sx / nullif(rho * (n - sc / size) + (1 - rho) * (si - sic / size) / norm, 0) AS scale
                FROM cells{l} AS q JOIN (SELECT {keys}, e, size AS size, lw FROM bysize{l}) USING ({keys}, e) JOIN bymix{l} USING ({keys}, e))
            WHERE scale IS NOT NULL AND (sx = 0 OR scale > 0) AND lm > '-inf'::DOUBLE)""" if l == 0 else f"""
        tried{l} AS (
            SELECT *, lw + lm + CASE WHEN sx > 0 THEN sx * ln(scale) ELSE 0 END - sx AS llh FROM (
                SELECT *, sx / nullif(rho * (n - sc / size) + (1 - rho) * (si - sic / size) / norm, 0) AS scale
                FROM (SELECT * EXCLUDE (size, rho) FROM cells{l}) JOIN bysize{l} USING ({keys}, e) JOIN bymix{l} USING ({keys}, e))
            WHERE scale IS NOT NULL AND (sx = 0 OR scale > 0) AND lm > '-inf'::DOUBLE)""",
                 f"""
        best{l} AS (
            SELECT * FROM (SELECT *, min(size) OVER (PARTITION BY {keys}, e) AS least,
                row_number() OVER (PARTITION BY {keys}, e ORDER BY round(llh, 8) DESC, size, rho) AS pick FROM tried{l}) WHERE pick = 1)""",
                 f"""
        cells{l + 1} AS (
            SELECT {keys}, e, low, high, norm, sx, si, sc, sic, n, most, size, rho, greatest(size / ratio, most) AS lo, least(size * ratio, high) AS hi,
                   greatest(rho - step, 0.0) AS mlo, least(rho + step, 1.0) AS mhi, pow(ratio, 2.0 / {fine - 1}) AS ratio, 2 * step / {fine - 1} AS step
            FROM best{l})"""]
    return f"""WITH {", ".join(ctes)}
        SELECT {keys}, CAST(s.t AS INTEGER) AS t, round(b.size, 4) AS "N", round(b.scale * b.rho, 4) AS a, round(b.scale * (1 - b.rho) / b.norm, 4) AS beta,
               0.0::DOUBLE AS gamma, round(b.llh, 4) AS llh, s.m, f.size >= f.high - 1e-6 AS is_ub_binding, f.size <= f.least + 1e-6 AS is_lb_binding
        FROM ends AS q JOIN steps AS s USING ({keys}) LEFT JOIN best{levels} AS b USING ({keys}, e) LEFT JOIN best0 AS f USING ({keys}, e)
        WHERE s.t = q.e"""


def _search(points: dict[str, int], given: dict[str, float], levels: int = 4, rate_max: float = 1000.0, gamma_max: float = 1.0) -> str:
    """Search of the weighted likelihood: a lattice in a box, then the box between the neighbours of the best point."""
    def most(plain, shrunk):
        return f"CASE WHEN {plain} - {shrunk} / n > 0 THEN least(sw / ({plain} - {shrunk} / n), {rate_max}) ELSE {rate_max}::DOUBLE END"

    box = ", ".join(f"lo_{x}, hi_{x}" for x in points)
    ctes = ["""
        rows AS (SELECT user_id, "I" AS i, "R" AS r, wait FROM states WHERE wait IS NOT NULL AND "I" <> 0),
        bounds AS (
            SELECT user_id, max(i + r) + 1 AS low, sum(i) AS sw, sum(i * wait * i) AS bi, sum(i * wait * i * (i + r)) AS bic,
                   sum(i * wait) AS ai, sum(i * wait * (i + r)) AS aic FROM rows GROUP BY user_id)""",
            f"""
        box0 AS (SELECT user_id, {", ".join(f"0.0::DOUBLE AS lo_{x}, 1.0::DOUBLE AS hi_{x}" for x in points)} FROM bounds WHERE low <= 1e5)"""]
    for level in range(levels):
        shares = ", ".join(f"lo_{x} + (hi_{x} - lo_{x}) * (j_{x} / {max(m - 1, 1)}.0::DOUBLE) AS s_{x}" for x, m in points.items())
        lattice = ", ".join(f"range({m}) AS r{x}(j_{x})" for x, m in points.items())
        rate = {"beta": f"s_beta * {most('bi', 'bic')}", "a": f"s_a * {most('ai', 'aic')}", "gamma": f"{gamma_max} * s_gamma"}
        picked = ", ".join(f"{given[x]}::DOUBLE AS v_{x}" if x in given else f"{rate[x]} AS v_{x}" for x in rate)
        term = "((CASE WHEN lam + v_gamma * i > 0 THEN ln(lam + v_gamma * i) ELSE '-inf'::DOUBLE END) - wait * lam + v_gamma * i) * i"
        step = ", ".join(f"greatest(s_{x} - (hi_{x} - lo_{x}) / {max(m - 1, 1)}, 0.0) AS lo_{x}, least(s_{x} + (hi_{x} - lo_{x}) / {max(m - 1, 1)}, 1.0) AS hi_{x}"
                         for x, m in points.items())
        ctes += [f"""
        lattice{level} AS (
            SELECT *, {picked} FROM (
                SELECT *, low * pow(1e5 / low, s_N) AS n FROM (
                    SELECT b.*, {", ".join(f"j_{x}" for x in points)}, {box}, {shares} FROM box{level} AS x JOIN bounds AS b USING (user_id), {lattice}))),
        score{level} AS (
            SELECT user_id, {", ".join(f"j_{x}" for x in points)}, sum({term}) AS llh
            FROM (SELECT l.*, i, wait, (v_a + v_beta * i) * (1 - (i + r) / n) AS lam FROM lattice{level} AS l JOIN rows USING (user_id))
            GROUP BY ALL),
        best{level} AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(llh, 3) DESC, {", ".join(f"j_{x}" for x in points)}) AS pick
                FROM lattice{level} JOIN score{level} USING (user_id, {", ".join(f"j_{x}" for x in points)})) WHERE pick = 1),
        box{level + 1} AS (SELECT user_id, {step} FROM best{level})"""]
    ends = {"N": ("bounds.low", "1e5"), "beta": ("0", rate_max), "a": ("0", rate_max), "gamma": ("0", gamma_max)}
    name = {"N": "n", "beta": "v_beta", "a": "v_a", "gamma": "v_gamma"}
    flags = ", ".join(
        f'false AS "{x}_is_ub", false AS "{x}_is_lb"' if x in given else
        f'{name[x]} >= {hi} - ({hi} - {lo}) / 1e5 AS "{x}_is_ub", {name[x]} <= {lo} + ({hi} - {lo}) / 1e5 AS "{x}_is_lb"' for x, (lo, hi) in ends.items())
    return f"""WITH {",".join(ctes)}
        SELECT user_id, round(n, 4) AS "N", round(v_beta, 4) AS beta, round(v_a, 4) AS a, round(v_gamma, 4) AS gamma, round(llh, 2) AS llh, {flags}
        FROM bounds LEFT JOIN best{levels - 1} AS b USING (user_id)"""


_MEANS = """SELECT region, year, t, round(avg(peak_t), {d}) AS peak_t, round(avg("peak_I"), {d}) AS "peak_I"
            FROM stitched_peaks GROUP BY region, year, t"""

_ASKED = """
    SELECT DISTINCT CAST(CASE WHEN y > 1996 THEN y - 1960 ELSE y END AS INTEGER) AS id
    FROM (SELECT year(o_orderdate) + {shift} AS y FROM orders UNION ALL SELECT year - 1959 + {shift} FROM ili)"""
_SEASON_IDS = """
    WITH asked AS (""" + _ASKED + """),
    valid AS (SELECT id FROM asked WHERE id IN (SELECT year - 1960 FROM ili))
    SELECT id FROM valid
    UNION ALL SELECT max(year - 1960) FROM ili WHERE NOT EXISTS (SELECT 1 FROM valid) HAVING count(*) > 0"""

_QUARTER_LONG = """(SELECT region, year, 'const_frac_t' AS var, const_frac_t AS val FROM quarters
                    UNION ALL SELECT region, year, 'mstar_t', mstar_t FROM quarters)"""

SQL = {
    # sources and sinks
    "scan_reviews_csv": "SELECT id, reviewer_id, rating, ts FROM reviews",
    "scan_ili_csv": "SELECT region, year, week, ilitotal, total_patients FROM ili",
    "scan_skip_preamble": """
        SELECT week, total_patients, weighted_ili, num_of_providers FROM ili_raw
        UNION ALL SELECT 'Region ' || week, num_of_providers, NULL, NULL FROM ili_raw WHERE CAST(week AS INTEGER) % 10 = 0
        UNION ALL SELECT 'Region ' || week, NULL, NULL, NULL FROM ili_raw WHERE CAST(week AS INTEGER) % 10 = 0""",
    "scan_many_files": """SELECT week, "dS", "Nmax", 'year=' || year || '/region=' || region AS fname FROM series""",
    "keys_from_path": 'SELECT week, "dS", "Nmax", region, year FROM series',
    "typed_read": 'SELECT week, "dS", "Nmax" FROM series',
    "type_convert": """SELECT TRY_CAST(week AS INTEGER) AS week, total_patients, TRY_CAST(weighted_ili AS DOUBLE) AS weighted_ili,
                       TRY_CAST(num_of_providers AS DOUBLE) AS num_of_providers FROM ili_raw""",
    "write_buckets": 'SELECT id, week, "dS", "Nmax" FROM weekly',
    "read_key": """SELECT id, week, "dS", "Nmax" FROM weekly WHERE id = '7'""",
    "write_csv_header": 'SELECT id, week, "dS", "Nmax" FROM weekly',
    "write_by_key": _SERIES,
    "param_query": 'SELECT week, "dS", "Nmax" FROM series WHERE region = 1 AND year = 1997',
    "param_query_weekly": """SELECT week, "dS", "Nmax" FROM weekly WHERE id = '7'""",
    # projections and filters
    "season_rekey": """SELECT region, year, week, CASE WHEN week < 32 THEN year ELSE year + 1 END AS season,
                       CASE WHEN week < 32 THEN week + 20 ELSE week - 32 END AS season_week FROM ili""",
    "region_filter": "SELECT region, year, week, ilitotal, total_patients FROM ili WHERE region = 'Region 3'",
    "season_filter": _SERIES + " WHERE year = 1998",
    "id_filter": """SELECT id, week, "dS", "Nmax" FROM weekly WHERE id = '7'""",
    "const_column": """SELECT 'National' AS region, year, week, ilitotal, 1e5::DOUBLE AS "Nmax" FROM ili""",
    "rename_select_drop": 'SELECT region, year, week AS peak_t, "dS" AS "peak_dS" FROM series',
    "year_filter": _SERIES + " WHERE year > 1996",
    "horizon_filter": 'SELECT region, year, seed, t, "I", "R", wait FROM trajectories WHERE t > 40',
    "year_shift": 'SELECT region, year + 1 AS year, seed, t, "I", "R", wait FROM trajectories',
    "label_case": """
        SELECT region, year, 'weeks until the error bound is one' AS var, m_star_t AS val FROM crossings
        UNION ALL SELECT region, year, 'weeks until a quarter of the peak size', m_peak_t FROM crossings
        UNION ALL SELECT region, year, 'peak_t', peak_t FROM crossings""",
    "unpivot_measures": """
        SELECT region, year, yw, 'dS' AS var, "dS" AS val FROM series
        UNION ALL SELECT region, year, yw, 'Nmax', "Nmax" FROM series""",
    "prefix_points": "SELECT region, year, t FROM placed WHERE t > 1",
    "prefix_points_thinned": """
        SELECT DISTINCT region, year, t FROM (
            SELECT p.region, p.year, j,
                   coalesce(min(p.t) FILTER (WHERE p.total > 1 AND p.m > 0
                                             AND ln(greatest(p.m, 1e-9)) / ln(greatest(p.total, 1.5)) >= 0.4 + 0.6 * j / 9 - 1e-12), 1) AS t
            FROM placed AS p, range(10) AS r(j) WHERE p.n > 10 GROUP BY p.region, p.year, j
            UNION ALL SELECT region, year, 0, t FROM placed WHERE n <= 10)
        WHERE t > 1""",
    "season_ids": _SEASON_IDS.format(shift=0),
    "season_ids_fallback": _SEASON_IDS.format(shift=500),
    # joins
    "fit_vs_data": """
        SELECT s.region, s.year, s.week, v.var, round(CASE WHEN v.var = 'dS' THEN s."dS" ELSE m.i END, 6) AS val
        FROM series AS s
        JOIN (SELECT region, year, t, avg("I") AS i FROM trajectories GROUP BY region, year, t) AS m
             ON m.region = s.region AND m.year = s.year AND m.t = s.week,
             (VALUES ('dS'), ('I')) AS v(var)""",
    "estimates_peaks_data": """
        SELECT region, year, m_star, m_star_50, round("Ntrue", 4) AS "Ntrue", round(beta, 4) AS beta, gamma,
               peak_t, "peak_dS", week, yw, "dS", "Nmax"
        FROM results JOIN peaks USING (region, year) JOIN series USING (region, year)""",
    "trajectories_with_estimate": """
        SELECT region, year, seed, t, "I", "R", wait, m_star, m_star_50, round("Ntrue", 4) AS "Ntrue",
               round(beta, 4) AS beta, gamma
        FROM trajectories JOIN results USING (region, year)""",
    "data_agg_leftovers": """
        SELECT s.region, s.year, s.week, s.yw, s."dS", s."Nmax", round(e."Ntrue", 4) AS "Ntrue", e.m_star, e.m_star_50,
               round(e.m_star_t, 4) AS m_star_t, round(e.m_star_50_t, 4) AS m_star_50_t,
               round(e.m_peak_t, 4) AS m_peak_t, round(e.m_peak, 4) AS m_peak, round(e.m_tot, 4) AS m_tot,
               round(l.m_leftover, 4) AS m_leftover
        FROM series AS s JOIN ensemble AS e ON e.region = s.region AND e.year = s.year
        JOIN leftover AS l ON l.region = s.region AND l.year = s.year
        WHERE s.year > 1996""",
    "available_semi": """
        SELECT id, reviewer_id, rating, ts FROM reviews WHERE id IN (
            SELECT id FROM (SELECT id, ts - min(ts) OVER (PARTITION BY id) AS s FROM reviews)
            GROUP BY id HAVING count(*) FILTER (WHERE s < 126144000) > 10 AND max(s) > 126144000)""",
    "prefix_range_join": """
        SELECT p.region, p.year, p.t, o.step, o."I", o."R"
        FROM prefixes AS p JOIN observed AS o ON o.region = p.region AND o.year = p.year AND o.step <= p.t""",
    "key_grid": """
        SELECT CAST(y AS INTEGER) AS year, CAST(r AS INTEGER) AS region, k AS type
        FROM range((SELECT min(year) FROM ili), (SELECT max(year) + 1 FROM ili)) AS a(y),
             range(1, (SELECT max(CAST(substr(region, 8) AS INTEGER)) + 1 FROM ili)) AS b(r),
             (VALUES ('estimates'), ('estimates_true_N')) AS c(k)""",
    "column_append": """
        SELECT region, year, t, round(e."N", 4) AS "N", round(e.beta, 4) AS beta, e.m, p.peak_t, p."peak_I"
        FROM estimates AS e JOIN (""" + _MEANS.format(d=4) + """) AS p USING (region, year, t)""",
    "last_N_lookup": """
        SELECT s.region, s.year, s.week, s.yw, s."dS", s."Nmax", round(f."N", 4) AS "N"
        FROM series AS s JOIN final AS f ON f.region = s.region AND f.year = s.year""",
    # aggregations
    "weekly_counts": 'SELECT id, week, "dS", "Nmax" FROM weekly',
    "valid_products": """
        SELECT id, count(*) FILTER (WHERE s < 126144000) AS reviews_4y, max(s) AS last_review_ts
        FROM (SELECT id, ts - min(ts) OVER (PARTITION BY id) AS s FROM reviews)
        GROUP BY id HAVING reviews_4y > 10 AND last_review_ts > 126144000""",
    "mean_trajectory": 'SELECT region, year, t, round(avg("I"), 6) AS "I" FROM trajectories GROUP BY region, year, t',
    "replicate_summary": """
        SELECT region, year, round("Ntrue", 4) AS "Ntrue", m_star, m_star_50, seed, m_star_t, m_star_50_t, m_peak_t,
               m_peak, m_tot FROM summary""",
    "ensemble_summary": """
        SELECT region, year, round("Ntrue", 4) AS "Ntrue", m_star, m_star_50, round(m_star_t, 4) AS m_star_t,
               round(m_star_50_t, 4) AS m_star_50_t, round(m_peak_t, 4) AS m_peak_t, round(m_peak, 4) AS m_peak,
               round(m_tot, 4) AS m_tot FROM ensemble""",
    "leftover": "SELECT region, year, round(m_leftover, 6) AS m_leftover FROM leftover",
    "observed_peak": 'SELECT region, year, peak_t, "peak_dS" FROM peaks',
    "actual_peak": 'SELECT region, year, "actual_peak_I", actual_peak_t FROM actual',
    "median_over_replicates": """
        SELECT region, year, t, round(median(peak_t), 6) AS peak_t, round(median("peak_I"), 6) AS "peak_I",
               CAST(median(seed) AS DOUBLE) AS seed FROM stitched_peaks GROUP BY region, year, t""",
    "mean_over_replicates": _MEANS.format(d=6),
    "final_estimate": """
        SELECT region, year, t, round("N", 4) AS "N", round(beta, 4) AS beta, gamma, a, round(llh, 4) AS llh, m,
               is_ub_binding, is_lb_binding FROM final""",
    "first_crossing": """
        SELECT region, year, seed, CASE WHEN count(m_star) > 0 THEN coalesce(min(t) FILTER (WHERE "I" + "R" > m_star), 1) END AS m_star_t,
               min(t) FILTER (WHERE "I" > "Ntrue" / 50) AS high_t,
               CASE WHEN count("Ntrue") > 0 THEN coalesce(min(t) FILTER (WHERE "I" > "Ntrue" / 50), 52) END AS high_or_52_t
        FROM trajectories JOIN results USING (region, year) GROUP BY region, year, seed""",
    "crossing_report": "SELECT region, year, m_star_t, m_star_50_t, m_peak_t, peak_t FROM crossings",
    "quarter_crossing": "SELECT region, year, peak_t, const_frac_t, mstar_t FROM quarters",
    "joint_share": """
        SELECT m_star_t, m_peak_t, count(*) AS n,
               round_even(count(*) * 100.0 / (SELECT count(*) FROM crossings), 0) / 100 AS pct
        FROM crossings GROUP BY m_star_t, m_peak_t""",
    "hist_share": """
        SELECT CAST(ceil(m_peak_t - m_star_t - 0.5) AS DOUBLE) AS bin, count(*) AS n,
               round(count(*) / (SELECT count(*) FROM crossings), 6) AS share
        FROM crossings GROUP BY bin""",
    "median_ratio": "SELECT round(median(mstar_t / const_frac_t), 6) AS median_ratio FROM quarters",
    "series_bounds": """
        SELECT region, year, max(m) AS lower, max("Nmax") AS "Nmax" FROM placed GROUP BY region, year""",
    # windows
    "ts_since_first": "SELECT id, reviewer_id, rating, ts - min(ts) OVER (PARTITION BY id) AS ts FROM reviews",
    "season_nmax": _SERIES,
    "running_total": 'SELECT region, year, week, yw, "dS", "Nmax", m FROM placed',
    "lag_diff": """
        SELECT region, year, seed, t, "I", "R", wait,
               "I" - lag("I") OVER (PARTITION BY region, year, seed ORDER BY t) AS "dS" FROM trajectories""",
    "offset_running_total": """
        SELECT region, year, week, yw, "dS", "Nmax", m, m - min(m) OVER (PARTITION BY region, year) AS m_offset
        FROM placed""",
    "ecdf": f"""
        SELECT DISTINCT var, val, round(cume_dist() OVER (PARTITION BY var ORDER BY val), 6) AS ecdf FROM {_QUARTER_LONG}""",
    "ecdf_by_year": f"""
        SELECT DISTINCT year, var, val, round(cume_dist() OVER (PARTITION BY year, var ORDER BY val), 6) AS ecdf
        FROM {_QUARTER_LONG}""",
    "cum_mean": 'SELECT region, year, week, yw, "dS", "Nmax", round(m / t, 6) AS "mean_dS" FROM placed',
    "share_of_total": """
        SELECT region, year, sum("dS") AS n, round(sum("dS") / (SELECT sum("dS") FROM series), 6) AS share
        FROM series GROUP BY region, year""",
    "next_state_pair": 'SELECT user_id, k, "I", "R", next_wait FROM waits',
    "lagged_fit_pairs": """
        SELECT region, year, step, "I", "R", "X" FROM (
            SELECT *, lead("dS") OVER (PARTITION BY region, year ORDER BY step) AS "X" FROM observed)
        WHERE "X" IS NOT NULL""",
    # order, sampling, sets
    "order_series": _SERIES + " ORDER BY region, year, week, yw",
    "sample_products": """
        SELECT id, count(*) FILTER (WHERE s < 126144000) AS reviews_4y, max(s) AS last_review_ts
        FROM (SELECT id, ts - min(ts) OVER (PARTITION BY id) AS s FROM reviews)
        GROUP BY id HAVING reviews_4y > 10 AND last_review_ts > 126144000
        ORDER BY md5(id || '-42'), id LIMIT 100""",
    "log_spaced_points": """
        SELECT DISTINCT id, total,
               CAST(CASE WHEN total <= 12 THEN j ELSE floor(exp(j * (ln(total) / 12)) + 1e-9) END AS BIGINT) AS point
        FROM (SELECT id, count(*) AS total FROM reviews GROUP BY id), range(13) AS r(j)
        WHERE total > 12 OR j BETWEEN 1 AND total""",
    "region_order": """
        SELECT region, year, week, ilitotal, total_patients, CAST(substr(region, 8) AS INTEGER) AS rank
        FROM ili ORDER BY rank, year, week""",
    "append_runs": """
        SELECT region, year, t, round(avg("I"), 6) AS "I", 'predicted' AS dataset FROM trajectories GROUP BY region, year, t
        UNION ALL SELECT region, year, step, "I", 'actual' FROM observed""",
    "drop_empty_runs": """
        SELECT region, year, seed, count(*) AS steps, sum("I") AS total FROM trajectories
        WHERE t > 40 GROUP BY region, year, seed HAVING count(*) > 0""",
    # scalar functions
    "to_num": """
        SELECT week, TRY_CAST(regexp_replace(total_patients, '[%><, ]', '', 'g') AS DOUBLE) AS total_patients,
               TRY_CAST(regexp_replace(weighted_ili, '[%><, ]', '', 'g') AS DOUBLE) AS weighted_ili,
               TRY_CAST(regexp_replace(num_of_providers, '[%><, ]', '', 'g') AS DOUBLE) AS num_of_providers
        FROM ili_raw""",
    "clean_names": """
        SELECT week, total_patients, weighted_ili, num_of_providers, weighted_ili AS weighted_ili_1 FROM ili_raw""",
    "mmwr_week_start": """
        SELECT region, year, week,
               CAST(make_date(year, 1, 4) - CAST(dayofweek(make_date(year, 1, 4)) AS INTEGER) + 7 * (week - 1) AS DATE)
                   AS week_start FROM ili""",
    "int_div_week": "SELECT id, reviewer_id, ts, ts // 604800 AS week FROM reviews",
    "fisher_bound": """
        SELECT region, year, seed, t,
               round(x * x / (("Ntrue" - x) * ("Ntrue" - x + "Ntrue" * gamma / beta)), 5) AS fisher_n2
        FROM (SELECT *, "I" + "R" AS x FROM trajectories JOIN results USING (region, year))""",
    "sample_threshold": """
        SELECT region, year, m_star, m_star_50, round("Ntrue", 4) AS "Ntrue", round(beta, 4) AS beta, gamma FROM results""",
    "cumulative_infected": 'SELECT region, year, seed, t, "I", "R", wait, "I" + "R" AS "C" FROM trajectories',
    "ratio": """
        SELECT region, year, round(m_star_t / peak_t, 6) AS ratio, m_peak_t - m_star_t AS lead FROM crossings""",
    "log10_axis": """
        SELECT DISTINCT log_n, round(cume_dist() OVER (ORDER BY log_n), 6) AS ecdf
        FROM (SELECT round(log10("N"), 6) AS log_n FROM final)""",
    "coalesce_default": """
        SELECT region, year, seed, t,
               coalesce("I" - lag("I") OVER (PARTITION BY region, year, seed ORDER BY t), 52) AS "dS" FROM trajectories""",
    "bound_flags": """
        SELECT region, year, t, is_ub_binding, is_lb_binding,
               "N" >= high - (high - low) / 1e5 AS interval_ub, "N" <= low + (high - low) / 1e5 AS interval_lb
        FROM estimates JOIN (SELECT region, year, max(m) AS low, max("Nmax") AS high FROM placed GROUP BY region, year)
             USING (region, year)""",
    # state and fits
    "state_fold": f'SELECT region, year, yw, "dS", "I", "R" FROM ({_FOLD})',
    "state_fold_ranges": f'SELECT region, year, yw, "dS", "I", "R" FROM ({_FOLD})',
    "state_fold_full_recovery": 'SELECT region, year, yw, "dS", "I", "R" FROM observed',
    "actual_trajectories": f'SELECT region, year, week AS t, "I", "R", "dS" FROM ({_FOLD})',
    "poisson_llh": """
        SELECT p.region, p.year,
               round(sum("X" * ln(f.beta * "I" * (1 - ("I" + "R") / f."N")) - f.beta * "I" * (1 - ("I" + "R") / f."N")), 4) AS llh
        FROM pairs AS p JOIN final AS f ON f.region = p.region AND f.year = p.year GROUP BY p.region, p.year""",
    "exponential_llh": """
        SELECT region, year, round(sum(ln(lam) - "X" * lam), 3) AS llh
        FROM (SELECT p.region, p.year, "X", (0.5 + f.beta * "I") * (1 - ("I" + "R") / f."N") AS lam
              FROM pairs AS p JOIN final AS f ON f.region = p.region AND f.year = p.year)
        GROUP BY region, year""",
    "profile_fit_sir": """
        SELECT region, year, t, round("N", 4) AS "N", round(beta, 4) AS beta, gamma, a, round(llh, 4) AS llh, m,
               is_ub_binding, is_lb_binding FROM coarse""",
    "profile_fit_sir_refined": """
        SELECT region, year, t, round("N", 4) AS "N", round(beta, 4) AS beta, gamma, a, round(llh, 4) AS llh, m,
               is_ub_binding, is_lb_binding FROM estimates""",
    "fit_known_N": """
        SELECT region, year, t, round("N", 4) AS "N", round(beta, 4) AS beta, 1.68::DOUBLE AS gamma, 0.0::DOUBLE AS a,
               round(sum(CASE WHEN "X" = 0 THEN 0 ELSE "X" * ln(beta * "I" * (1 - ("I" + "R") / "N")) END
                         - beta * "I" * (1 - ("I" + "R") / "N")), 4) AS llh, m
        FROM (SELECT e.region, e.year, e.t, q.m, f."N", p."I", p."R", p."X",
                     sum(p."X") OVER w / sum(p."I" * (1 - (p."I" + p."R") / f."N")) OVER w AS beta
              FROM prefixes AS e
              JOIN placed AS q ON q.region = e.region AND q.year = e.year AND q.t = e.t
              JOIN final AS f ON f.region = e.region AND f.year = e.year
              JOIN pairs AS p ON p.region = e.region AND p.year = e.year AND p.t <= e.t
              WINDOW w AS (PARTITION BY e.region, e.year, e.t))
        GROUP BY region, year, t, "N", beta, m""",
    "profile_fit_bass": """
        WITH counted AS (
            SELECT id, row_number() OVER s AS t, "dS" AS x, "Nmax", sum("dS") OVER s AS m
            FROM weekly WINDOW s AS (PARTITION BY id ORDER BY week)),
        folded AS (
            SELECT b.id, b.t, b.x, b.m, b."Nmax", sum(a.x * pow(0.9, b.t - a.t)) AS i
            FROM counted AS b JOIN counted AS a ON a.id = b.id AND a.t <= b.t GROUP BY ALL),
        steps AS (
            SELECT id, t, x, lag(i) OVER s AS i, lag(m) OVER s AS c,
                   max(t) OVER (PARTITION BY id) AS n, max(m) OVER (PARTITION BY id) AS total,
                   max("Nmax") OVER (PARTITION BY id) AS high
            FROM folded WINDOW s AS (PARTITION BY id ORDER BY t)),
        fit_rows AS (
            SELECT *, avg(i) OVER (PARTITION BY id) AS mean_i, max(c) OVER (PARTITION BY id) + 1 AS low
            FROM steps WHERE c IS NOT NULL),
        tried AS (
            SELECT id, n, total, high, low, mean_i, g, size, rho,
                   sum(x) AS sx, sum(mix * w) AS mw, sum(x * ln(mix * w)) AS xln
            FROM (SELECT *, rho + (1 - rho) * i / mean_i AS mix, 1 - c / size AS w
                  FROM (SELECT f.*, g, k / 20.0 AS rho, low * pow(high / low, g / 39.0) AS size
                        FROM fit_rows AS f, range(40) AS a(g), range(21) AS b(k)))
            GROUP BY id, n, total, high, low, mean_i, g, size, rho),
        ranked AS (
            SELECT *, xln + sx * ln(sx / mw) - sx AS llh,
                   row_number() OVER (PARTITION BY id
                       ORDER BY round(xln + sx * ln(sx / mw) - sx, 8) DESC, size, rho) AS pick
            FROM tried)
        SELECT id, CAST(n AS INTEGER) AS t, round(size, 4) AS "N", round(sx / mw * rho, 4) AS a,
               round(sx / mw * (1 - rho) / mean_i, 4) AS beta, 0.0::DOUBLE AS gamma, round(llh, 4) AS llh,
               CAST(total AS BIGINT) AS m, size >= high - 1e-6 AS is_ub_binding, size <= low + 1e-6 AS is_lb_binding
        FROM ranked WHERE pick = 1""",
    "profile_fit_bass_refined": _bass("""counted AS (
            SELECT id, row_number() OVER s AS t, CAST("dS" AS DOUBLE) AS x, "Nmax", CAST(sum("dS") OVER s AS BIGINT) AS m
            FROM weekly WINDOW s AS (PARTITION BY id ORDER BY week)),
        folded AS (
            SELECT b.id, b.t, b.x, b.m, b."Nmax", sum(a.x * pow(0.9, b.t - a.t)) AS i
            FROM counted AS b JOIN counted AS a ON a.id = b.id AND a.t <= b.t GROUP BY ALL),
        steps AS (SELECT id, t, x, m, "Nmax" AS high, lag(i) OVER s AS i, CAST(lag(m) OVER s AS DOUBLE) AS c
                  FROM folded WINDOW s AS (PARTITION BY id ORDER BY t))""", "id", False),
    "profile_fit_bass_prefixes": _bass("""folded AS (
            SELECT b.region, b.year, b.t, b."dS" AS x, b.m, b."Nmax", sum(a."dS" * pow(0.9, b.t - a.t)) AS i
            FROM placed AS b JOIN placed AS a ON a.region = b.region AND a.year = b.year AND a.t <= b.t GROUP BY ALL),
        steps AS (SELECT region, year, t, x, m, "Nmax" AS high, lag(i) OVER s AS i, lag(m) OVER s AS c
                  FROM folded WINDOW s AS (PARTITION BY region, year ORDER BY t))""", "region, year", True),
    "interarrival_llh": """
        SELECT user_id, k, round(CASE WHEN lam > 0 THEN ln(lam) - lam * next_wait ELSE '-inf'::DOUBLE END, 6) AS llh
        FROM (SELECT *, (0.0 + 0.3 * "I") * (1000.0 - "I" - "R") / 1000.0 + 0.1 * "I" AS lam FROM waits)""",
    "grid_search_mle": """
        SELECT user_id, k, round(theta, 6) AS estimate, theta >= 3.0 - 1e-6 AS is_ub_binding,
               theta <= 1e-6 AS is_lb_binding, round(llh, 6) AS llh
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY round(mean, 8) DESC, theta) AS pick
              FROM (SELECT *, avg(llh) OVER (PARTITION BY user_id, theta ORDER BY k) AS mean FROM waits_by_rate))
        WHERE pick = 1""",
    "log_prefix_mle": """
        WITH sized AS (SELECT user_id, count(*) AS n FROM states GROUP BY user_id),
        points AS (
            SELECT DISTINCT user_id, k FROM (
                SELECT user_id, n, CAST(CASE WHEN n >= 1000 THEN j + 1 ELSE floor(exp(j * (ln(1000) / n)) + 1e-9) END AS BIGINT) AS k
                FROM sized, range(1001) AS r(j) WHERE j <= n)
            WHERE k > 10 AND k < n),
        upto AS (SELECT user_id, k, theta, sum(llh) OVER (PARTITION BY user_id, theta ORDER BY k) AS llh FROM waits_by_rate),
        tried AS (
            SELECT p.user_id, p.k, w.theta, w.llh FROM points AS p JOIN upto AS w ON w.user_id = p.user_id AND w.k = p.k - 1)
        SELECT user_id, round(theta, 6) AS estimate, round(llh, 2) AS llh, theta >= 3.0 - 3e-5 AS is_ub_binding,
               theta <= 3e-5 AS is_lb_binding, k
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY round(llh, 6) DESC, theta) AS pick FROM tried)
        WHERE pick = 1""",
    "grid_search_gamma": """
        WITH tried AS (
            SELECT user_id, k, theta, CASE WHEN lam > 0 THEN ln(lam) - lam * next_wait ELSE '-inf'::DOUBLE END AS llh
            FROM (SELECT *, (0.0 + 0.3 * "I") * (1000.0 - "I" - "R") / 1000.0 + theta * "I" AS lam
                  FROM waits, (SELECT g * (1.0 / 999) AS theta FROM range(1000) AS r(g))))
        SELECT user_id, k, round(theta, 6) AS estimate, theta >= 1.0 - 1e-6 AS is_ub_binding,
               theta <= 1e-6 AS is_lb_binding, round(llh, 6) AS llh
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY round(mean, 8) DESC, theta) AS pick
              FROM (SELECT *, avg(llh) OVER (PARTITION BY user_id, theta ORDER BY k) AS mean FROM tried))
        WHERE pick = 1""",
    "weighted_llh": _WEIGHTED.format(weight='"I"'),
    "unweighted_llh": _WEIGHTED.format(weight="1"),
    # replicates and peaks
    "stitched_series": 'SELECT region, year, t, seed, step, clock, "I" FROM stitched',
    "stitched_peak": 'SELECT region, year, t, seed, peak_t, "peak_I" FROM stitched_peaks',
    "peak_report": """
        SELECT region, year, t, round(e."N", 4) AS "N", round(e.beta, 4) AS beta, e.gamma, e.a, round(e.llh, 4) AS llh, e.m,
               p.peak_t, p."peak_I", p.seed, a."actual_peak_I", a.actual_peak_t
        FROM estimates AS e
        JOIN (SELECT region, year, t, round(median(peak_t), 4) AS peak_t, round(median("peak_I"), 4) AS "peak_I",
                     CAST(median(seed) AS DOUBLE) AS seed
              FROM stitched_peaks GROUP BY region, year, t) AS p USING (region, year, t)
        JOIN actual AS a USING (region, year)""",
    "take_while_active": """
        SELECT region, year, seed, t, "I", "R", wait FROM trajectories AS a
        WHERE NOT EXISTS (SELECT 1 FROM trajectories AS b WHERE b.region = a.region AND b.year = a.year
                          AND b.seed = a.seed AND b.t <= a.t AND b."I" <= 1)""",
    "index_steps": """
        SELECT region, year, seed, week, CAST("I" AS BIGINT) AS "I", CAST(t AS INTEGER) AS t
        FROM (SELECT *, row_number() OVER (PARTITION BY region, year, seed ORDER BY week) AS t
              FROM (SELECT region, year, CAST(l_suppkey % 5 + 1 AS INTEGER) AS seed, week, count(*) AS "I"
                    FROM visits GROUP BY ALL))""",
}

_SAMPLED = f"SELECT id FROM ({SQL['sample_products']})"
_FITTED = f"SELECT * FROM ({SQL['profile_fit_bass']}) WHERE id IN ({_SAMPLED})"
_SHARE = "count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share"

SQL |= {
    "clean_surveillance": """
        SELECT region, year, week, ilitotal * 1000.0::DOUBLE AS ilitotal, total_patients * 1000.0::DOUBLE AS total_patients,
               CASE WHEN ilitotal > 0 THEN CAST(ilitotal % 100 AS DOUBLE) END AS unweighted_ili,
               CAST(regexp_extract(region, '[0-9]+') AS INTEGER) AS region_rank,
               CAST(make_date(year, 1, 4) - CAST(dayofweek(make_date(year, 1, 4)) AS INTEGER) + 7 * (week - 1) AS DATE)
                   AS week_start FROM ili""",
    "cleaned_season_series": _SERIES,
    "season_report": SQL["crossing_report"],
    "fit_products": _FITTED,
    "ecdf_product_size": f"""
        SELECT DISTINCT log_n, round(cume_dist() OVER (ORDER BY log_n), 6) AS ecdf
        FROM (SELECT round(log10("N"), 4) AS log_n FROM ({SQL['profile_fit_bass_refined']}) WHERE "N" IS NOT NULL)""",
    "peak_reports": f"""
        SELECT e.region, e.year, e.t, round(e."N", 4) AS "N", round(e.beta, 4) AS beta, e.gamma, e.a, round(e.llh, 4) AS llh, e.m,
               p.peak_t, p."peak_I", p.seed, o."actual_peak_I", o.actual_peak_t, e.type
        FROM (SELECT region, year, t, "N", beta, gamma, a, llh, m, 'estimates' AS type FROM estimates
              UNION ALL SELECT region, year, t, "N", beta, gamma, a, llh, m, 'estimates_true_N' FROM ({SQL['fit_known_N']})) AS e
        JOIN (SELECT region, year, t, round(median(peak_t), 4) AS peak_t, round(median("peak_I"), 4) AS "peak_I",
                     CAST(median(seed) AS DOUBLE) AS seed
              FROM stitched_peaks GROUP BY region, year, t) AS p USING (region, year, t)
        JOIN actual AS o USING (region, year)""",
    "hist_product_size": f"""
        SELECT CAST(ceil(log10("N") - 0.5) AS DOUBLE) AS bin, {_SHARE} FROM ({_FITTED}) WHERE "N" IS NOT NULL GROUP BY 1""",
    "hist_m_star_t": f"""
        SELECT CAST(ceil(m_star_t - 0.5) AS DOUBLE) AS bin, {_SHARE} FROM crossings WHERE m_star_t IS NOT NULL GROUP BY 1""",
    "hist_ratio_to_peak": f"""
        SELECT ceil(m_star_t / peak_t / 0.5 - 0.5) * 0.5 AS bin, {_SHARE} FROM crossings
        WHERE m_star_t IS NOT NULL AND peak_t <> 0 GROUP BY 1""",
    "weighted_mle": _search({"N": 13, "beta": 17, "a": 1, "gamma": 1}, {"a": 0.0, "gamma": 0.1}),
    "weighted_mle_free": _search({"N": 7, "beta": 7, "a": 5, "gamma": 5}, {}),
}

for _name in ("fit_vs_data", "estimates_peaks_data", "trajectories_with_estimate", "data_agg_leftovers", "prefix_range_join", "column_append",
              "last_N_lookup", "profile_fit_sir_refined", "fit_known_N", "poisson_llh", "stitched_series", "stitched_peak", "peak_report"):
    SQL[f"{_name}_null_key"] = f"SELECT * REPLACE (nullif(region, 1) AS region) FROM ({with_views(SQL[_name])})"
SQL["available_semi_null_key"] = f"SELECT * REPLACE (nullif(id, '1') AS id) FROM ({with_views(SQL['available_semi'])})"
