"""Sinks. Every write is distributed; no step gathers the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.options(header=header, escape='"').csv(path)
    return path


def write_by_key(df: DataFrame, path: str, keys: Sequence[str] = ("year", "region"), fmt: str = "csv") -> str:
    """One folder per key.

    The rebalance hint brings the rows of a key together, so small keys get one file, and
    lets adaptive execution split the partitions of large keys over several tasks.
    """
    df.hint("rebalance", *keys).write.partitionBy(*keys).options(header=True, escape='"').format(fmt).save(path)
    return path


def bucket(keys: Sequence[Column], buckets: Column) -> Column:
    return F.pmod(F.hash(*keys), buckets)


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """Parquet in ``buckets`` folders by the hash of the key, for any number of keys.

    Every file is sorted by key, so its footers hold narrow key ranges. The rebalance hint lets adaptive execution
    cut a folder with a large key into several files. The number of buckets is part of the path, where
    :func:`epitide.sources.readers.read_key` finds it.
    """
    placed = df.withColumn("_bucket", bucket([F.col(k) for k in keys], F.lit(buckets)))
    (placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *keys)
     .write.partitionBy("_bucket").parquet(f"{path.rstrip('/')}/_buckets={buckets}"))
    return path


def write_with_preamble(df: DataFrame, path: str, title: str, names: list[str]) -> str:
    """CSV text files, each with a title line above its header, as the surveillance download has them."""
    def quoted(value):
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    above = [title, ",".join(f'"{n}"' for n in names)]

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(above)], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    lines = df.select(
        F.concat_ws(",", *[F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in df.columns]).alias("value")
    )
    lines.mapInArrow(headed, "value string").write.text(path)
    return path
