"""Schemas of the input and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STR, _INT, _LONG, _DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# event log, one row per review; ts is in epoch seconds
REVIEWS = _schema(id=_STR, reviewer_id=_STR, rating=_LONG, ts=_LONG)

# surveillance table, one row per region and calendar week
ILI = _schema(region=_STR, year=_INT, week=_INT, ilitotal=_LONG, total_patients=_LONG)

# weekly count series of one key, the key being part of the path
SERIES = _schema(week=_INT, dS=_DBL, Nmax=_DBL)

# numeric columns of the surveillance download that arrive as text
MESSY_NUMBERS = [
    "weighted_ili",
    "unweighted_ili",
    "age_0_4",
    "age_25_49",
    "age_25_64",
    "age_5_24",
    "age_50_64",
    "age_65",
    "ilitotal",
    "num_of_providers",
    "total_patients",
]

# keys of a season series and the order of its rows
KEYS = ["region", "year"]
ORDER = ["yw"]

# recovery rate of the surveillance fits
GAMMA = 1.68
