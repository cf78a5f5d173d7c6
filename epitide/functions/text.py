"""Cleaning of text columns and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_num(col: Column | str) -> Column:
    """Text to double without ``% > < ,`` and blanks; NULL where no number is left."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, "[%><, ]", "").try_cast("double")


def clean_numbers(df: DataFrame, columns) -> DataFrame:
    """Apply :func:`to_num` to those of ``columns`` that ``df`` has."""
    return df.withColumns({c: to_num(c) for c in columns if c in df.columns})


def clean_name(name: str) -> str:
    """Lower case, punctuation and blanks to single ``_``, none at the ends, no leading ``x_``."""
    name = re.sub(r"[\W_]+", "_", name.lower()).strip("_")
    return name.removeprefix("x_")


def unique_names(names: list[str]) -> list[str]:
    """Give repeated names the first free suffix ``_1``, ``_2``, ..."""
    taken, out = set(names), []
    seen: set[str] = set()
    for name in names:
        if name in seen:
            n = 1
            while f"{name}_{n}" in taken:
                n += 1
            name = f"{name}_{n}"
            taken.add(name)
        seen.add(name)
        out.append(name)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns with :func:`clean_name`, made unique. Only names are touched."""
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def convert_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to a declared schema; values that do not fit become NULL."""
    return df.select(
        *[F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) if f.name in df.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def relabel(col: Column, labels: dict[str, str]) -> Column:
    """Replace the given labels of a category and leave all others as they are."""
    out = None
    for old, new in labels.items():
        out = F.when(col == old, new) if out is None else out.when(col == old, new)
    return out.otherwise(col) if out is not None else col


def region_number(col: Column | str) -> Column:
    """``'Region 7'`` to 7, the order of the regions."""
    return F.regexp_extract(col, r"(\d+)$", 1).try_cast("int")


def region_label(number: Column) -> Column:
    return F.concat(F.lit("Region "), number.cast("string"))
