"""Parameterised SQL texts. Values are bound with named markers, never pasted into the text;
``{ili}`` and ``{reviews}`` are DataFrames handed to ``spark.sql``."""

SEASON_SQL = """
SELECT season_week AS week, CAST(ilitotal AS DOUBLE) AS dS, CAST(calendar_total AS DOUBLE) AS Nmax
FROM (
    SELECT ilitotal,
           sum(total_patients) OVER (PARTITION BY region, year) AS calendar_total,
           if(week < :start, week + 52 - :start, week - :start) AS season_week,
           if(week < :start, year, year + 1) AS season
    FROM {ili}
    WHERE region = concat('Region ', :region)
)
WHERE season = :season
"""

WEEKLY_SQL = """
SELECT (ts - (SELECT min(ts) FROM {reviews} WHERE id = :id)) DIV :week_seconds AS week,
       count(*) AS dS, CAST(:nmax AS DOUBLE) AS Nmax
FROM {reviews}
WHERE id = :id
GROUP BY ALL
"""
