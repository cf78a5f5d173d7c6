"""The same input tables as DuckDB SQL, and a helper that puts them before a query."""

VIEWS = {
    "reviews": """
        SELECT CAST(l_partkey AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS reviewer_id,
               CAST(l_linenumber AS BIGINT) AS rating, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts
        FROM lineitem""",
    "weekly": """
        SELECT id, ts_week AS week, count(*) AS "dS", 1e5::DOUBLE AS "Nmax"
        FROM (SELECT id, (ts - min(ts) OVER (PARTITION BY id)) // 604800 AS ts_week FROM reviews)
        GROUP BY id, ts_week""",
    "visits": """
        SELECT CAST(n_regionkey + 1 AS INTEGER) AS region, CAST(isoyear(l_shipdate) AS INTEGER) AS year,
               CAST(week(l_shipdate) AS INTEGER) AS week, l_suppkey, l_returnflag
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "ili": """
        SELECT 'Region ' || region AS region, year, week,
               count(*) FILTER (WHERE l_returnflag = 'R') AS ilitotal, count(*) AS total_patients
        FROM visits GROUP BY region, year, week""",
    "ili_raw": """
        SELECT CAST(l_suppkey AS VARCHAR) AS week, format('{:,}', n * 1000) AS total_patients,
               CAST(n % 7 AS VARCHAR) || ' %' AS weighted_ili,
               CASE WHEN n % 5 = 0 THEN 'X' ELSE CAST(n AS VARCHAR) END AS num_of_providers
        FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)""",
    "series": """
        SELECT CAST(substr(region, 8) AS INTEGER) AS region,
               CASE WHEN week < 32 THEN year ELSE year + 1 END AS year,
               CASE WHEN week < 32 THEN week + 20 ELSE week - 32 END AS week,
               year * 100 + week AS yw, CAST(ilitotal AS DOUBLE) AS "dS",
               CAST((SELECT sum(total_patients) FROM ili AS o WHERE o.region = i.region AND o.year = i.year) AS DOUBLE)
                   AS "Nmax"
        FROM ili AS i""",
    # positions, state for gamma >= 1 (I = dS), running totals, counts of the row before
    "placed": """
        SELECT region, year, week, yw, "dS", "Nmax",
               CAST(row_number() OVER s AS INTEGER) AS t, count(*) OVER (PARTITION BY region, year) AS n,
               sum("dS") OVER s AS m,
               sum("dS") OVER (PARTITION BY region, year) AS total
        FROM series WINDOW s AS (PARTITION BY region, year ORDER BY yw)""",
    "observed": """
        SELECT region, year, t AS step, t, week, yw, "dS", "dS" AS "I", m - "dS" AS "R" FROM placed""",
    "prefixes": """
        SELECT region, year, t FROM placed WHERE t > 1""",
    "pairs": """
        SELECT b.region, b.year, b.t, a."I", a."R", b."dS" AS "X"
        FROM observed AS b JOIN observed AS a ON a.region = b.region AND a.year = b.year AND a.t = b.t - 1""",
    "sizes": """
        SELECT region, year, low * pow(high / low, g / 199.0) AS "N", high
        FROM (SELECT region, year, min("dS") FILTER (WHERE t = 1) + 1 AS low, max("Nmax") AS high
              FROM placed GROUP BY region, year), range(200) AS r(g)""",
    "scored": """
        SELECT region, year, t, "N", high, beta,
               sum(CASE WHEN "X" = 0 THEN 0 ELSE "X" * ln(beta * "I" * (1 - c / "N")) END
                   - beta * "I" * (1 - c / "N")) AS llh
        FROM (
            SELECT p.region, p.year, e.t, s."N", s.high, p."I", p."X", p."I" + p."R" AS c,
                   sum(p."X") OVER w / nullif(sum(p."I" * (1 - (p."I" + p."R") / s."N")) OVER w, 0) AS beta,
                   max(p."I" + p."R") OVER w AS cmax,
                   max(CASE WHEN p."X" > 0 AND p."I" = 0 THEN 1 ELSE 0 END) OVER w AS spoiled
            FROM prefixes AS e
            JOIN pairs AS p ON p.region = e.region AND p.year = e.year AND p.t <= e.t
            JOIN sizes AS s ON s.region = e.region AND s.year = e.year
            WINDOW w AS (PARTITION BY e.region, e.year, e.t, s."N"))
        WHERE "N" > cmax AND spoiled = 0 AND beta IS NOT NULL
        GROUP BY region, year, t, "N", high, beta""",
    "coarse": """
        SELECT e.region, e.year, e.t, b."N", b.beta, 1.68::DOUBLE AS gamma, 0.0::DOUBLE AS a, b.llh, p.m,
               b."N" >= b.high - 1e-6 AS is_ub_binding, b."N" <= b.least + 1e-6 AS is_lb_binding
        FROM prefixes AS e JOIN placed AS p USING (region, year, t)
        LEFT JOIN (SELECT *, min("N") OVER (PARTITION BY region, year, t) AS least,
                          row_number() OVER (PARTITION BY region, year, t ORDER BY round(llh, 8) DESC, "N") AS pick
                   FROM scored) AS b
             ON b.region = e.region AND b.year = e.year AND b.t = e.t AND b.pick = 1""",
    "estimates": """
        WITH framed AS (
            SELECT e.*, p.cmax, greatest(e."N" / s.ratio, p.cmax) AS lo, least(e."N" * s.ratio, s.high) AS hi
            FROM coarse AS e
            JOIN (SELECT region, year, max(high) AS high, pow(max(high) / min("N"), 1 / 199.0) AS ratio
                  FROM sizes GROUP BY region, year) AS s ON s.region = e.region AND s.year = e.year
            JOIN (SELECT region, year, t, max("I" + "R") OVER (PARTITION BY region, year ORDER BY t) AS cmax
                  FROM pairs) AS p ON p.region = e.region AND p.year = e.year AND p.t = e.t
            WHERE e."N" IS NOT NULL),
        fine AS (
            SELECT region, year, t, m, is_ub_binding, is_lb_binding, cmax, lo * pow(hi / lo, g / 20.0) AS size
            FROM framed, range(21) AS r(g) WHERE lo * pow(hi / lo, g / 20.0) > cmax
            UNION SELECT region, year, t, m, is_ub_binding, is_lb_binding, cmax, "N" FROM framed),
        rated AS (
            SELECT f.region, f.year, f.t, f.m, f.is_ub_binding, f.is_lb_binding, f.size, p."I", p."R", p."X",
                   sum(p."X") OVER w / sum(p."I" * (1 - (p."I" + p."R") / f.size)) OVER w AS beta
            FROM fine AS f JOIN pairs AS p ON p.region = f.region AND p.year = f.year AND p.t <= f.t
            WINDOW w AS (PARTITION BY f.region, f.year, f.t, f.size)),
        tried AS (
            SELECT region, year, t, m, is_ub_binding, is_lb_binding, size, beta,
                   sum(CASE WHEN "X" = 0 THEN 0 ELSE "X" * ln(beta * "I" * (1 - ("I" + "R") / size)) END
                       - beta * "I" * (1 - ("I" + "R") / size)) AS llh
            FROM rated GROUP BY ALL)
        SELECT region, year, t, size AS "N", beta, 1.68::DOUBLE AS gamma, 0.0::DOUBLE AS a,
               llh, m, is_ub_binding, is_lb_binding
        FROM (SELECT *, row_number() OVER (PARTITION BY region, year, t ORDER BY round(llh, 8) DESC, size) AS pick FROM tried)
        WHERE pick = 1
        UNION ALL
        SELECT region, year, t, "N", beta, gamma, a, llh, m, is_ub_binding, is_lb_binding FROM coarse WHERE "N" IS NULL""",
    "final": """
        SELECT * FROM estimates AS e
        WHERE t = (SELECT max(t) FROM prefixes AS p WHERE p.region = e.region AND p.year = e.year)""",
    "information": """
        SELECT region, year, "N", beta, x,
               sum(x * x / (("N" - x) * ("N" - x + "N" * gamma / beta))) OVER (
                   PARTITION BY region, year ORDER BY x) AS total
        FROM final, range(1, 1000000) AS r(x) WHERE x <= floor("N")""",
    "results": """
        SELECT f.region, f.year,
               CASE WHEN f."N" IS NOT NULL THEN coalesce(min(i.x) FILTER (WHERE i.total > 1), 1) END AS m_star,
               CASE WHEN f."N" IS NOT NULL THEN coalesce(min(i.x) FILTER (WHERE i.total > 1 / sqrt(0.5)), 1) END AS m_star_50,
               f."N" AS "Ntrue", f.beta, f.gamma
        FROM final AS f LEFT JOIN information AS i USING (region, year)
        GROUP BY f.region, f.year, f."N", f.beta, f.gamma""",
    "peaks": """
        SELECT region, year, week AS peak_t, "dS" AS "peak_dS" FROM (
            SELECT *, row_number() OVER (PARTITION BY region, year ORDER BY "dS" DESC, week, yw) AS pick FROM series)
        WHERE pick = 1""",
    "trajectories": """
        SELECT region, year, seed, CAST(row_number() OVER s AS INTEGER) AS t, "I",
               coalesce(sum("I") OVER (PARTITION BY region, year, seed ORDER BY week
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "R",
               1.0::DOUBLE AS wait
        FROM (SELECT region, year, CAST(l_suppkey % 5 + 1 AS INTEGER) AS seed, week, CAST(count(*) AS DOUBLE) AS "I"
              FROM visits GROUP BY ALL)
        WINDOW s AS (PARTITION BY region, year, seed ORDER BY week)""",
    "continuations": """
        SELECT e.region, e.year, e.t, j.seed,
               CAST(row_number() OVER (PARTITION BY e.region, e.year, e.t, j.seed ORDER BY j.t) AS INTEGER) AS step, j."I", j."R", j.wait
        FROM prefixes AS e JOIN trajectories AS j ON j.region = e.region AND j.year = e.year AND j.t > e.t""",
    "stitched": """
        SELECT o.region, o.year, e.t, CAST(s.seed AS INTEGER) AS seed, o.step, CAST(o.step AS DOUBLE) AS clock, o."I"
        FROM prefixes AS e JOIN observed AS o ON o.region = e.region AND o.year = e.year AND o.step <= e.t,
             range(1, 6) AS s(seed)
        UNION ALL
        SELECT region, year, t, seed, t + step,
               CAST(t + sum(wait) OVER (PARTITION BY region, year, t, seed ORDER BY step) AS DOUBLE), "I"
        FROM continuations""",
    "stitched_peaks": """
        SELECT region, year, t, seed, clock AS peak_t, "I" AS "peak_I" FROM (
            SELECT *, row_number() OVER (PARTITION BY region, year, t, seed ORDER BY "I" DESC, step) AS pick FROM stitched)
        WHERE pick = 1""",
    "actual": """
        SELECT region, year, "I" AS "actual_peak_I", step AS actual_peak_t FROM (
            SELECT *, row_number() OVER (PARTITION BY region, year ORDER BY "I" DESC, step) AS pick FROM observed)
        WHERE pick = 1""",
    "summary": """
        SELECT region, year, "Ntrue", m_star, m_star_50, seed,
               CASE WHEN count(m_star) > 0 THEN coalesce(min(t) FILTER (WHERE "I" + "R" > m_star), 1) END AS m_star_t,
               CASE WHEN count(m_star_50) > 0 THEN coalesce(min(t) FILTER (WHERE "I" + "R" > m_star_50), 1) END AS m_star_50_t,
               min(t) FILTER (WHERE "I" = top) AS m_peak_t,
               min("I" + "R") FILTER (WHERE "I" = top) AS m_peak,
               sum("I") AS m_tot
        FROM (SELECT *, max("I") OVER (PARTITION BY region, year, seed) AS top
              FROM trajectories JOIN results USING (region, year))
        GROUP BY ALL""",
    "ensemble": """
        SELECT region, year, "Ntrue", m_star, m_star_50, avg(m_star_t) AS m_star_t, avg(m_star_50_t) AS m_star_50_t,
               avg(m_peak_t) AS m_peak_t, avg(m_peak) AS m_peak, avg(m_tot) AS m_tot
        FROM summary GROUP BY region, year, "Ntrue", m_star, m_star_50""",
    "leftover": """
        SELECT region, year + 1 AS year, avg(n) AS m_leftover FROM (
            SELECT region, year, seed, sum("I") AS n FROM trajectories WHERE t > 40 GROUP BY region, year, seed)
        GROUP BY region, year""",
    "season_data": """
        SELECT s.*, e."Ntrue", e.m_star, e.m_star_50, e.m_peak, l.m_leftover
        FROM series AS s JOIN ensemble AS e USING (region, year) JOIN leftover AS l USING (region, year)
        WHERE s.year > 1996""",
    "crossings": """
        SELECT region, year,
               CASE WHEN count(m_star) > 0 THEN coalesce(min(pos) FILTER (WHERE m > m_star), 1) END AS m_star_t,
               CASE WHEN count(m_star_50) > 0 THEN coalesce(min(pos) FILTER (WHERE m > m_star_50), 1) END AS m_star_50_t,
               CASE WHEN count(m_peak) > 0 THEN coalesce(min(pos) FILTER (WHERE m > m_peak / 4), 1) END AS m_peak_t,
               min(pos) FILTER (WHERE "dS" = top) AS peak_t
        FROM (SELECT *, CAST(row_number() OVER s AS INTEGER) AS pos, sum("dS") OVER s - m_leftover AS m,
                     max("dS") OVER (PARTITION BY region, year) AS top
              FROM season_data WINDOW s AS (PARTITION BY region, year ORDER BY week, yw))
        GROUP BY region, year""",
    "quarters": """
        SELECT region, year, peak_t,
               CASE WHEN count("Ntrue") > 0 THEN coalesce(min(pos) FILTER (WHERE m - least > "Ntrue" / 4), 1) END AS const_frac_t,
               CASE WHEN count(m_star) > 0 THEN coalesce(min(pos) FILTER (WHERE m - least > m_star), 1) END AS mstar_t
        FROM (SELECT *, min(m) OVER (PARTITION BY region, year) AS least
              FROM (SELECT *, CAST(row_number() OVER s AS INTEGER) AS pos, sum("dS") OVER s AS m
                    FROM results JOIN peaks USING (region, year) JOIN series USING (region, year)
                    WINDOW s AS (PARTITION BY region, year ORDER BY week, yw)))
        GROUP BY region, year, peak_t""",
    "states": """
        SELECT user_id, k, CAST(1 + k - removed AS DOUBLE) AS "I", CAST(removed AS DOUBLE) AS "R",
               CAST(secs - lag(secs) OVER (PARTITION BY user_id ORDER BY k) AS DOUBLE) AS wait
        FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, row_number() OVER s AS k,
                     sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) OVER s AS removed
              FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "waits": """
        SELECT a.user_id, a.k, a."I", a."R", b.wait AS next_wait
        FROM states AS a JOIN states AS b ON a.user_id = b.user_id AND b.k = a.k + 1""",
    "waits_by_rate": """
        SELECT user_id, k, theta, CASE WHEN lam > 0 THEN ln(lam) - lam * next_wait ELSE '-inf'::DOUBLE END AS llh
        FROM (SELECT *, (0.0 + theta * "I") * (1000.0 - "I" - "R") / 1000.0 + 0.1 * "I" AS lam
              FROM waits, (SELECT g * (3.0 / 999) AS theta FROM range(1000) AS r(g)))""",
}


def with_views(query: str) -> str:
    """Put the views that ``query`` needs, and those they need, before it."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s+AS\b)", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = query.strip()
    return f"WITH {ctes}\n{body}" if not body.upper().startswith("WITH ") else f"WITH {ctes},\n{body[5:]}"
