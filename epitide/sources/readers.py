"""Readers of event logs, surveillance tables and keyed series files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epitide.functions.text import clean_names
from epitide.schemas import REVIEWS, SERIES
from epitide.sources.writers import bucket


def read_reviews(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Headerless event log with its fixed schema. A malformed line is an error, or NULLs with ``PERMISSIVE``."""
    return spark.read.schema(REVIEWS).options(header=False, escape='"', mode=mode).csv(path)


def read_csv_header(
    spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """CSV with header, the columns of ``schema`` taken by name from files that may have more.

    The names come from the first line read; a missing name is an error, and so is a file whose
    header differs from it. A malformed number is an error, or NULL with mode ``PERMISSIVE``.
    Give a schema: without one the files are read twice to infer it.
    """
    reader = spark.read.options(header=True, escape='"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    kinds = {f.name: f.dataType for f in schema}
    names = reader.csv(path).columns
    if missing := [n for n in kinds if n not in names]:
        raise ValueError(f"no column {', '.join(missing)} in {path}: {', '.join(names)}")
    full = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return reader.schema(full).options(enforceSchema=False, mode=mode).csv(path).select(*kinds)


def read_skip_preamble(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV with a title line above its header, as text columns with clean names.

    ``names`` are the columns as the header spells them. The first line of every file goes by its position,
    whatever it holds: Spark's reader takes it for a header, which it skips where a file begins and nowhere
    else, however the file is split. A line that spells the header in all its columns is a header. Every other line
    stays, also one that looks like a title or lacks columns.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    lines = spark.read.schema(schema).options(header=True, enforceSchema=True, escape='"').csv(path)
    header = reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.lit(n)) for n in names])
    return clean_names(lines.where(~header))


def keys_from_path(path: Column) -> tuple[Column, Column]:
    """(year, region) from ``.../2014/3.csv`` or ``.../year=2014/region=3/part-0.csv``."""
    pattern = r"/(?:year=)?(\d+)/(?:region=)?(\d+)(?:\.csv|/[^/]*)$"
    return (
        F.regexp_extract(path, pattern, 1).try_cast("int"),
        F.regexp_extract(path, pattern, 2).try_cast("int"),
    )


def read_many(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files that match a glob as one table, with the file's path in ``fname``.

    Columns go by name and all files need one header, see :func:`read_csv_header`. Keys without a
    file simply do not match; no list of expected files is needed.
    """
    return read_csv_header(spark, pattern, schema).select("*", F.col("_metadata.file_path").alias("fname"))


def read_keyed_series(spark: SparkSession, pattern: str, schema: T.StructType = SERIES) -> DataFrame:
    """Keyed series files as one table with ``region`` and ``year`` columns."""
    rows = read_many(spark, pattern, schema)
    year, region = keys_from_path(F.col("fname"))
    return rows.withColumns({"region": region, "year": year}).drop("fname")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All keys of a table from :func:`epitide.sources.writers.write_buckets`."""
    return spark.read.parquet(path).drop("_buckets", "_bucket")


def read_key(spark: SparkSession, path: str, **key) -> DataFrame:
    """The rows of one key: one folder is read, and of its files the row groups whose key range holds it.

    Give the columns in the order they were written by; None is a key.
    """
    rows = spark.read.parquet(path)
    kinds = {k: rows.schema[k].dataType for k in key}
    wanted = {k: F.lit(value).cast(kinds[k]) for k, value in key.items()}
    here = F.col("_bucket") == bucket(list(wanted.values()), F.col("_buckets"))
    for k, value in wanted.items():
        here = here & (F.col(k).isNull() if key[k] is None else F.col(k) == value)
    return rows.where(here).drop("_buckets", "_bucket")
