"""Weeks, seasons and surveillance calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: seconds in a week, and in four years of 365 days
WEEK_SECONDS = 7 * 24 * 60 * 60
FOUR_YEARS_SECONDS = 4 * 365 * 24 * 60 * 60

#: a season starts in this calendar week
SEASON_START = 32
WEEKS_BEFORE_START = 52 - SEASON_START


def whole_weeks(seconds: Column) -> Column:
    """Complete weeks in a number of seconds."""
    return F.call_function("div", seconds, F.lit(WEEK_SECONDS))


def season_year(year: Column, week: Column) -> Column:
    """The year in which the season of a calendar week ends."""
    return F.when(week < SEASON_START, year).otherwise(year + 1)


def season_week(week: Column) -> Column:
    """Weeks since the start of the season."""
    return F.when(week < SEASON_START, week + WEEKS_BEFORE_START).otherwise(week - SEASON_START)


def mmwr_week_start(year: Column, week: Column) -> Column:
    """First day (Sunday) of a surveillance week; week 1 is the one that holds 4 January."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    first_sunday = F.date_sub(fourth, F.dayofweek(fourth) - 1)
    return F.date_add(first_sunday, ((week - 1) * 7).cast("int"))


def season_id(year: Column) -> Column:
    """Calendar years to season numbers; small values are season numbers already."""
    return F.when(year > 1996, year - 1960).otherwise(year)
